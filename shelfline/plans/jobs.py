"""The jobs a catalogue operator runs, composed from the operators.

Every job takes DataFrames and returns DataFrames; ``now`` is always a parameter.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shelfline.operators import alerts, attempts, catalog, chunks, discover, merge, quality, search, series, state
from shelfline.operators.intervals import closed_rows, coalesced_intervals, open_rows, strict_intervals
from shelfline.schemas import HISTORY, PRODUCTS, align_schema, history_id, product_id
from shelfline.session import pinned
from shelfline.sources.sitemaps import resolve_sitemap
from shelfline.sources.worklists import choose_urls


class Discovery(NamedTuple):
    products: DataFrame
    new: DataFrame
    orphaned: DataFrame
    counts: DataFrame


class Settled(NamedTuple):
    """Observations after retries: one per crawl, with outcome and lateness, and the rows left out with a reason."""

    rows: DataFrame
    unusable: DataFrame

    def rejected(self) -> DataFrame:
        late = self.rows.filter("is_late").withColumn("reason", F.lit("late"))
        return self.unusable.unionByName(late.select(*self.unusable.columns))


class Update(NamedTuple):
    products: DataFrame
    history: DataFrame
    counters: DataFrame
    rejected: DataFrame
    counts: dict[str, int]

    def require_prices(self, limit: int = quality.NULL_PRICE_LIMIT) -> None:
        """The gate of a run, to be passed once its results are stored."""
        quality.require_prices(self.counts["null_price"], limit)


class Merge(NamedTuple):
    products: DataFrame
    history: DataFrame
    counts: DataFrame


def discover_urls(entry: DataFrame, stored: DataFrame, products: DataFrame, now: Column) -> Discovery:
    """Compare the product URLs of stored sitemaps with the tracked ones and add the new ones."""
    found = discover.product_urls_of(resolve_sitemap(entry, stored))
    new = discover.new_urls(found, products)
    return Discovery(
        align_schema(products, PRODUCTS).unionByName(discover.new_product_rows(new, now)),
        new,
        discover.orphaned_urls(found, products),
        discover.discovery_counts(found, products),
    )


def plan_crawl(
    products: DataFrame,
    limit: int | None = chunks.MAX_URLS,
    workers: int = chunks.WORKERS,
    include_inactive: bool = False,
    override: str | None = None,
    chunk_path: str | None = None,
) -> DataFrame:
    """(url, chunk): an explicit list, else a chunk file, else the stalest URLs, in balanced consecutive chunks.

    A chunk file may be long and has no order of its own: it is numbered by URL. The limit is for the stalest URLs
    only, None takes all; any limit is planned by the same steps, none of them in one task, and what it leaves out is
    counted by ``crawl_backlog``.
    """
    spark = products.sparkSession
    if chunk_path and not override:
        listed = choose_urls(spark, products, chunk_path=chunk_path)
        return chunks.balanced_chunks(listed, [F.col("url").asc()], workers).select("url", "chunk")
    if override:
        # a literal list keeps its own order
        listed = choose_urls(spark, products, override).withColumn(
            "_place", F.monotonically_increasing_id()
        )
        return chunks.limited_chunks(listed, [F.col("_place")], workers).select("url", "chunk")
    pool = _crawlable(products, include_inactive).select("url", "last_checked_at")
    if limit is not None:
        pool = chunks.oldest_rows(pool, "last_checked_at", limit)
    order = [F.col("last_checked_at").asc(), F.col("url").asc()]
    return chunks.balanced_chunks(pool, order, workers, limit).select("url", "chunk")


def _crawlable(products: DataFrame, include_inactive: bool) -> DataFrame:
    chosen = products if include_inactive else products.filter("is_active")
    return chosen.filter(F.col("last_checked_at").isNotNull())


def crawl_backlog(products: DataFrame, limit: int | None = chunks.MAX_URLS, include_inactive: bool = False) -> DataFrame:
    """One row: URLs that could be crawled, those a plan with this limit takes, and those it leaves for later runs."""
    total = F.count("*")
    taken = total if limit is None else F.least(total, F.lit(limit).cast("long"))
    return _crawlable(products, include_inactive).agg(total.alias("waiting"), taken.alias("planned"), (total - taken).alias("left_out"))


def update_history(
    history: DataFrame,
    observations: DataFrame,
    mode: str = "strict",
    sizing: DataFrame | None = None,
    segments: int | None = None,
) -> DataFrame:
    """Stored history continued with newer observations (product_id, observed_at, price, ...).

    Closed intervals, and open ones of products that the batch doesn't touch, pass through unsorted: only
    the open interval of each product of the batch takes part, as its first observation. ``sizing`` as for
    ``strict_intervals``.
    """
    build = strict_intervals if mode == "strict" else coalesced_intervals
    columns = ["product_id", "price", "currency", "original_price"]
    touched = observations.select("product_id").distinct()
    stored_open = align_schema(open_rows(history), HISTORY)
    carried = stored_open.join(touched, "product_id", "left_semi").select(
        *columns, F.col("start_ts").alias("observed_at"), F.lit(True).alias("_stored")
    )
    fresh = observations.select(*columns, "observed_at", F.lit(False).alias("_stored"))
    intervals = build(carried.unionByName(fresh), carried="_stored", segments=segments, sizing=sizing)
    continued = intervals.withColumn("id", history_id(F.col("product_id"), F.col("start_ts")))
    untouched = stored_open.join(touched, "product_id", "left_anti").select(*HISTORY.names)
    past = align_schema(closed_rows(history), HISTORY).unionByName(untouched)
    return past.unionByName(align_schema(continued, HISTORY))


def settle(
    observations: DataFrame, products: DataFrame, attempt_keys: list[str] | None = None
) -> Settled:
    """Attempts settled within each crawl, classified, and marked late against the stored products.

    A crawl is a URL and a ``run_id``; rows without one are crawls of their own time. Rows that can't be used
    are kept aside with a reason, see ``attempts.split_unusable``.
    """
    usable, unusable = attempts.split_unusable(observations)
    keys = ["url", "_crawl"] if attempt_keys is None else attempt_keys
    crawls = usable.withColumn("_crawl", attempts.crawl_key(usable))
    settled = attempts.classify(attempts.resolve_attempts(crawls, keys)).drop("_crawl")
    return Settled(state.mark_late(settled, products), unusable)


def fold_settled(products: DataFrame, history: DataFrame, settled: DataFrame, mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """(products, history) brought up to date with settled observations; late ones change nothing.

    A 404 makes a known product inactive, challenge pages and other pages change nothing.
    """
    kind = (
        F.when(F.col("outcome") == "inactive", state.GONE)
        .when(F.col("outcome").isin("priced", "null_price"), state.UPSERT)
    )
    events = settled.filter(~F.col("is_late")).withColumn("kind", kind).filter(F.col("kind").isNotNull())
    priced = events.filter(F.col("kind") == state.UPSERT).withColumn("product_id", product_id(F.col("url")))
    return state.fold_into(products, events), update_history(history, priced, mode)


def apply_observations(
    products: DataFrame,
    history: DataFrame,
    observations: DataFrame,
    attempt_keys: list[str] | None = None,
    mode: str = "strict",
) -> Update:
    """Fold a batch of page observations into product state and price history.

    The batch is settled once and pinned in the shared folder; its counters are taken in flight by that pass, so
    ``counts`` is known when this returns. ``rejected`` has every row that was left out, with the reason.
    """
    settled = settle(observations, products, attempt_keys)
    counted = Observation("settled")
    rows = pinned(settled.rows.observe(counted, *quality.outcome_metrics()))
    new_products, new_history = fold_settled(products, history, rows, mode)
    return Update(
        new_products,
        new_history,
        quality.run_counters(rows.filter(~F.col("is_late"))),
        Settled(rows, settled.unusable).rejected(),
        counted.get,
    )


def merge_deltas(
    products: DataFrame, history: DataFrame, delta_products: DataFrame, delta_history: DataFrame
) -> Merge:
    """Merge the change sets of parallel shards; running it again changes nothing."""
    touched = merge.touched_products(products, delta_products)
    actions = merge.history_actions(history, delta_history, touched)
    return Merge(
        merge.merged_products(products, touched),
        merge.merged_history(history, actions),
        merge.merge_counts(touched),
    )


def catalog_view(
    products: DataFrame,
    history: DataFrame,
    query: str = "",
    sort: str | None = None,
    include_inactive: bool = False,
    only_in_stock: bool = True,
    favorites: DataFrame | None = None,
    previous: DataFrame | None = None,
) -> tuple[DataFrame, list[Column]]:
    """The filtered catalogue and the order it is shown in; see ``catalog.page`` and ``total``.

    A search text orders by relevance whatever sort is chosen, and does so even when it has no
    tokens to filter by. ``previous``: see ``catalog.current_and_previous``.
    """
    rows = catalog.with_derived(catalog.current_and_previous(products, history, previous))
    rows = catalog.filter_catalog(rows, include_inactive, only_in_stock, favorites)
    if not query.strip():
        return rows, catalog.sort_order(sort)
    # the catalogue does not carry descriptions into the search
    fields = {f: f for f in ("name", "sku", "category", "url")}
    return search.search(rows, query, fields), search.relevance_order() + catalog.base_order()


def price_chart(products: DataFrame, history: DataFrame, url: str, days: int, now: Column) -> DataFrame:
    """Chart points of one product."""
    return series.price_series(catalog.history_of(products, history, url), days, now)


def sitemap_audit(
    entry: DataFrame, stored: DataFrame, targets: list[str] | DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(counts per sitemap document, best matches of each target among the product URLs).

    A few targets may be a list, any number a table with a column ``target``.
    """
    listed = resolve_sitemap(entry, stored)
    found = discover.product_urls_of(listed)
    match = discover.match_targets if isinstance(targets, DataFrame) else discover.url_variants
    return discover.audit_counts(listed), match(found, targets)


def watch_report(watchlist: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(price change since each product was added, alerts to deliver)."""
    return alerts.change_since_added(watchlist, rows), alerts.price_alerts(watchlist, rows)
