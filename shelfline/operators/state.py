"""Folding observations into one current row per product URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.schemas import METADATA, PRODUCTS, align_schema, epoch, product_id

UPSERT = "upsert"
GONE = "404"


def _event_summary(events: DataFrame, key: str, ts: str, metadata: list[str]) -> DataFrame:
    """Per key: everything a fold needs, as one aggregation that is combined before the shuffle."""
    is_upsert = F.col("kind") == UPSERT
    order = F.struct(ts, *(["attempt"] if "attempt" in events.columns else []))
    upsert_order = F.when(is_upsert, order)
    dated_order = F.when(is_upsert & F.col("published_date").isNotNull(), order)
    dated = F.struct("published_date", F.col(ts).alias("at"))
    return events.groupBy(key).agg(
        F.count_if(is_upsert).alias("upserts"),
        F.min(F.when(is_upsert, F.col(ts))).alias("first_upsert"),
        F.max(F.when(is_upsert, F.col(ts))).alias("last_upsert"),
        F.max(F.when(~is_upsert, F.col(ts))).alias("last_gone"),
        F.max(ts).alias("last_ts"),
        (F.max_by("kind", order) == UPSERT).alias("ends_active"),
        F.max_by(F.struct(*metadata, dated.alias("dated")), upsert_order).alias("newest"),
        F.min_by(dated, dated_order).alias("first_dated"),
    )


def fold_state(
    events: DataFrame,
    key: str = "url",
    ts: str = "observed_at",
    metadata: list[str] | None = None,
) -> DataFrame:
    """Current product rows from a complete event log.

    ``events`` has a ``kind`` column (``upsert`` or ``404``), the metadata columns and
    ``published_date``. A 404 of a product that is not known yet has no effect. A product with one
    effective event counts as never checked. Metadata follow the newest upsert even where it is
    NULL; the first publication date is kept for good, the latest follows the newest upsert.
    """
    metadata = METADATA if metadata is None else metadata
    return _new_rows(_event_summary(_with_date(events), key, ts, metadata), key, metadata)


def _new_rows(summary: DataFrame, key: str, metadata: list[str]) -> DataFrame:
    """Product rows of keys that were not known before."""
    checked_again = (F.col("upserts") > 1) | (F.col("last_gone") > F.col("first_upsert"))
    latest = F.col("newest.dated")
    return summary.filter("upserts > 0").select(
        key,
        *[F.col(f"newest.{c}").alias(c) for c in metadata],
        F.col("first_upsert").alias("first_seen_at"),
        F.when(checked_again, F.col("last_ts")).otherwise(epoch()).alias("last_checked_at"),
        F.col("ends_active").alias("is_active"),
        F.col("first_dated.published_date").alias("published_first"),
        latest["published_date"].alias("published_latest"),
        F.col("first_dated.at").alias("published_first_scraped_at"),
        F.when(latest["published_date"].isNotNull(), latest["at"]).alias("published_latest_scraped_at"),
    )


def _with_date(events: DataFrame) -> DataFrame:
    if "published_date" in events.columns:
        return events
    return events.withColumn("published_date", F.lit(None).cast("date"))


def mark_late(events: DataFrame, products: DataFrame, ts: str = "observed_at") -> DataFrame:
    """Adds ``is_late``: not newer than the newest stored observation of the product.

    That is its check time, or its first sight where it was observed once. Products are reduced to the
    URLs of the batch first, so a small batch doesn't shuffle the stored table.
    """
    touched = products.join(events.select("url").distinct(), "url", "left_semi")
    known = touched.select("url", F.greatest("last_checked_at", "first_seen_at").alias("_checked"))
    late = F.coalesce(F.col(ts) <= F.col("_checked"), F.lit(False))
    return events.join(known, "url", "left").withColumn("is_late", late).drop("_checked")


def reject_stale(events: DataFrame, products: DataFrame, ts: str = "observed_at") -> DataFrame:
    """The events that are not late, see ``mark_late``."""
    return mark_late(events, products, ts).filter(~F.col("is_late")).drop("is_late")


def fold_into(products: DataFrame, events: DataFrame, ts: str = "observed_at") -> DataFrame:
    """Stored product rows brought up to date with a batch of newer events.

    The batch is reduced to one row per URL first. Stored rows take the reduced batch by a left
    join, so a batch that is small enough is broadcast and the product table is not shuffled; only
    the URLs are compared to find the new products.
    """
    summary = _event_summary(_with_date(events), "url", ts, METADATA)
    touched = F.col("last_ts").isNotNull()
    upserted = F.coalesce(F.col("upserts"), F.lit(0)) > 0
    latest = F.col("newest.dated")
    first_from_batch = F.col("published_first").isNull() & F.col("first_dated").isNotNull()

    def newer(name: str, value: Column, changed: Column) -> Column:
        return F.when(changed, value).otherwise(F.col(name)).alias(name)

    known = align_schema(products, PRODUCTS).join(summary, "url", "left").select(
        "id",
        "url",
        *[newer(c, F.col(f"newest.{c}"), upserted) for c in METADATA],
        "first_seen_at",
        newer("last_checked_at", F.col("last_ts"), touched),
        newer("is_active", F.col("ends_active"), touched),
        newer("published_first", F.col("first_dated.published_date"), first_from_batch),
        newer("published_latest", latest["published_date"], upserted),
        newer("published_first_scraped_at", F.col("first_dated.at"), first_from_batch),
        newer(
            "published_latest_scraped_at",
            F.when(latest["published_date"].isNotNull(), latest["at"]),
            upserted,
        ),
    )
    stored = products.select("url").join(summary.select("url"), "url", "left_semi")
    unknown = summary.join(stored, "url", "left_anti")
    added = _new_rows(unknown, "url", METADATA).withColumn("id", product_id(F.col("url")))
    return known.unionByName(align_schema(added, PRODUCTS))
