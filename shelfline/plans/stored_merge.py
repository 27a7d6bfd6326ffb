"""Merging shards into stored tables, rewriting only the files that hold touched products.

``products``, ``history`` and ``previous`` (the newest closed price of each product) lie in buckets of products under a
manifest per merge (``sources.buckets``). A merge reads
three columns of all products to find the touched ones, then only the buckets of those. Buckets without a touched
product keep their files; a merge that touches nothing writes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.operators import merge
from shelfline.operators.intervals import latest_closed
from shelfline.schemas import HISTORY, PREVIOUS, PRODUCTS, align_schema
from shelfline.session import pinned
from shelfline.sources import buckets as store

TABLES = {"products": ("id", PRODUCTS), "history": ("product_id", HISTORY), "previous": ("product_id", PREVIOUS)}


def newest(spark: SparkSession, base: str) -> store.Manifest:
    return store.read_manifest(spark, base, max(store.committed_batches(spark, base), default=-1))


def read_table(spark: SparkSession, base: str, table: str, manifest: store.Manifest, only: set[int] | None = None) -> DataFrame:
    return store.read_buckets(spark, base, table, TABLES[table][1], manifest, only)


def create(products: DataFrame, history: DataFrame, base: str, buckets: int = store.BUCKETS) -> store.Manifest:
    """The stored tables as of batch 0."""
    spark = products.sparkSession
    before = store.read_manifest(spark, base, -1)
    versions = _rewrite(products, base, "products", buckets, 0, set(), before)
    versions |= _rewrite_history(history, base, buckets, 0, set(range(buckets)), before)
    made = store.Manifest(0, versions, {"buckets": buckets})
    store.commit(spark, base, made)
    return made


def _rewrite(rows: DataFrame, base: str, table: str, buckets: int, batch: int, where: set[int], before: store.Manifest) -> dict:
    key, schema = TABLES[table]
    return store.rewrite_buckets(align_schema(rows, schema), base, table, F.col(key), buckets, batch, where, before)


def _rewrite_history(history: DataFrame, base: str, buckets: int, batch: int, where: set[int], before: store.Manifest) -> dict:
    """Buckets of the history, then those of the view of previous prices, read from the buckets just written."""
    versions = _rewrite(history, base, "history", buckets, batch, where, before)
    written = read_table(history.sparkSession, base, "history", store.Manifest(batch, versions, {}), where)
    return versions | _rewrite(latest_closed(written), base, "previous", buckets, batch, where, before)


def _buckets_of(rows: DataFrame, buckets: int) -> set[int]:
    """At most one number per bucket reaches the driver."""
    return {r[0] for r in rows.select(store.bucket_of(F.col("product_id"), buckets)).distinct().collect()}


def merge_stored(spark: SparkSession, base: str, delta_products: DataFrame, delta_history: DataFrame) -> store.Manifest:
    """Merge the change sets of parallel shards into the stored tables; running it again changes nothing."""
    before = newest(spark, base)
    if before.batch < 0:
        raise ValueError(f"no stored tables in {base}")
    buckets, batch = before.counters["buckets"], before.batch + 1
    touched = pinned(merge.touched_products(read_table(spark, base, "products", before), delta_products))
    changed = _buckets_of(touched, buckets)
    if not changed:
        return before
    products = read_table(spark, base, "products", before, changed)
    history = read_table(spark, base, "history", before, changed)
    actions = pinned(merge.history_actions(history, delta_history, touched))
    acted = actions.filter(F.col("action") != "none")
    rewritten = _buckets_of(acted, buckets)
    new_history = merge.merged_history(read_table(spark, base, "history", before, rewritten), acted)
    versions = _rewrite(merge.merged_products(products, touched), base, "products", buckets, batch, changed, before)
    # an extension may move or reopen the newest closed interval, so the view follows from the rewritten buckets whole
    versions |= _rewrite_history(new_history, base, buckets, batch, rewritten, before)
    done = store.Manifest(batch, versions, {"buckets": buckets, "merged": touched.count(), "acted": acted.count()})
    store.commit(spark, base, done)
    store.remove_superseded(spark, base)
    return done
