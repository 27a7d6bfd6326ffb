"""Comparing discovered URLs with the known ones, and auditing sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.urls import (
    PRODUCT_PARTS,
    comparable_url,
    is_disambiguated,
    is_product_url,
)
from shelfline.operators.search import containing
from shelfline.schemas import PRODUCTS, align_schema, epoch, product_id
from shelfline.session import pinned

# Targets compared in one pass over the URLs; longer lists take several passes.
_TARGETS_PER_PASS = 128


def product_urls_of(urls: DataFrame, allow: list[str] | None = None, deny: list[str] | None = None) -> DataFrame:
    """URLs that look like product pages; duplicates stay."""
    return urls.filter(is_product_url(F.col("url"), allow, deny))


def distinct_urls(urls: DataFrame) -> DataFrame:
    """Each URL once, with ``n``, how often it was listed (combined before the shuffle)."""
    return urls.groupBy("url").agg(F.count("*").alias("n"))


def new_urls(discovered: DataFrame, products: DataFrame) -> DataFrame:
    """Discovered URLs that are not tracked yet, each once, with ``n`` listings."""
    return distinct_urls(discovered).join(products.select("url"), "url", "left_anti")


def orphaned_urls(discovered: DataFrame, products: DataFrame) -> DataFrame:
    """Tracked URLs that are no longer listed."""
    return products.select("url").join(distinct_urls(discovered), "url", "left_anti")


def discovery_counts(discovered: DataFrame, products: DataFrame) -> DataFrame:
    """Listed, tracked, new and orphaned URLs in one row.

    Listings count with their duplicates. One outer join of unique keys answers all four.
    """
    listed = distinct_urls(discovered).withColumnRenamed("n", "_listed")
    tracked = products.groupBy("url").agg(F.lit(True).alias("_tracked"))
    return listed.join(tracked, "url", "full_outer").agg(
        F.coalesce(F.sum("_listed"), F.lit(0)).alias("listed"),
        F.count("_tracked").alias("tracked"),
        F.coalesce(F.sum(F.when(F.col("_tracked").isNull(), F.col("_listed"))), F.lit(0)).alias("new"),
        F.count_if(F.col("_listed").isNull()).alias("orphaned"),
    )


def new_product_rows(urls: DataFrame, now: Column) -> DataFrame:
    """Product rows for new URLs: no metadata yet, never checked, active."""
    rows = urls.select(
        product_id(F.col("url")).alias("id"),
        "url",
        now.alias("first_seen_at"),
        epoch().alias("last_checked_at"),
        F.lit(True).alias("is_active"),
    )
    return align_schema(rows, PRODUCTS)


def audit_counts(listed: DataFrame, allow: list[str] | None = None, deny: list[str] | None = None) -> DataFrame:
    """Per sitemap document: URLs, product URLs and numbered slugs; the NULL row is the total.

    ``listed`` has ``loc`` and ``url``; a NULL URL marks a document without any.
    """
    product = F.coalesce(is_product_url(F.col("url"), allow, deny), F.lit(False))
    return listed.rollup("loc").agg(
        F.count("url").alias("urls"),
        F.count_if(product).alias("product_urls"),
        F.count_if(product & is_disambiguated(F.col("url"))).alias("numbered"),
    )


def _slug(target: str) -> str:
    marker = PRODUCT_PARTS[0]
    scheme, found, rest = target.partition("://")
    host, _, path = rest.partition("/")
    if found and scheme in ("http", "https") and ("/" + path).startswith(marker):
        target = ("/" + path)[len(marker) :]
    return target.removesuffix("/")


def url_variants(urls: DataFrame, targets: list[str]) -> DataFrame:
    """For each target the best kind of match and the URLs found that way.

    Stage 1 is equality without case and closing slash, stage 2 containment of the target's slug,
    stage 3 containment of the slug without its number. Targets are constants of the plan, so every
    URL is compared where it lies and nothing is joined pairwise. Result: ``target``, ``stage``,
    ``url``.
    """
    if not targets:
        raise ValueError("no target URLs given")
    found = None
    for at in range(0, len(targets), _TARGETS_PER_PASS):
        entries = []
        for target in targets[at : at + _TARGETS_PER_PASS]:
            slug = _slug(target).lower()
            head, _, number = slug.rpartition("-")
            base = head if head and number.isascii() and number.isdigit() else None
            entries.append(
                F.struct(
                    F.lit(target).alias("target"),
                    F.lit(target.lower().removesuffix("/")).alias("whole"),
                    F.lit(slug).alias("slug"),
                    F.lit(base).cast("string").alias("base"),
                )
            )
        lowered = F.lower("url")
        staged = F.transform(
            F.array(*entries),
            lambda t: F.struct(
                t["target"].alias("target"),
                F.when(comparable_url(F.col("url")) == t["whole"], 1)
                .when(F.contains(lowered, t["slug"]), 2)
                .when(F.contains(lowered, t["base"]), 3)
                .alias("stage"),
            ),
        )
        part = urls.select("url", F.inline(F.filter(staged, lambda s: s["stage"].isNotNull())))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("target").agg(F.min("stage").alias("stage"))
    return found.join(F.broadcast(best), ["target", "stage"], "left_semi").select(
        "target", "stage", "url"
    )


def match_targets(urls: DataFrame, targets: DataFrame) -> DataFrame:
    """``url_variants`` for a table of targets (column ``target``), however many.

    Equality is a join by the comparable form. Slugs, and then slugs without their number, meet the URLs through an index
    of substrings on the rarest one each of them has (see ``search.containing``). Stages follow each other: only targets
    without a match go on to the next, so a common head is not paired with the URLs of targets that are known already.
    What a stage found is pinned, and the plan holds none of the targets. Repeated targets and URLs count once; an empty
    slug contains nothing.
    """
    slug = F.lower(F.regexp_replace("target", f"^https?://[^/]*{PRODUCT_PARTS[0]}", ""))
    parts = targets.filter(F.col("target").isNotNull()).select("target").distinct().select(
        "target",
        comparable_url(F.col("target")).alias("whole"),
        F.regexp_replace(slug, "/$", "").alias("slug"),
    )
    base = F.when(F.col("slug").rlike("^.+-[0-9]+$"), F.regexp_replace("slug", "-[0-9]+$", ""))
    open_targets = pinned(parts.withColumn("base", base))
    forms = urls.select("url").distinct().select("url", comparable_url(F.col("url")).alias("whole"), F.lower("url").alias("token"))
    known = pinned(forms)
    found = pinned(open_targets.join(known, "whole").select("target", F.lit(1).alias("stage"), "url"))
    vocabulary = known.filter("token IS NOT NULL").select("token").distinct()
    for stage, column in ((2, "slug"), (3, "base")):
        open_targets = open_targets.join(found.select("target").distinct(), "target", "left_anti")
        looked_up = open_targets.filter(F.col(column) != "").select("target", F.col(column).alias("candidate"))
        pairs = containing(vocabulary, looked_up.select("candidate").distinct())
        held = pairs.join(looked_up, "candidate").join(known, "token").select("target", F.lit(stage).alias("stage"), "url")
        found = found.unionByName(pinned(held))
    return found


def equal_urls(urls: DataFrame) -> DataFrame:
    """How many URLs share each comparable form."""
    return urls.groupBy(comparable_url(F.col("url")).alias("comparable")).agg(F.count("*").alias("n"))
