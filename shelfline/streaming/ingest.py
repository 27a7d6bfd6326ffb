"""Folding observations into the stored tables as they arrive.

Layout below a base folder (see ``sources.buckets``): ``products``, ``open`` (open price intervals) and ``previous``
(the newest closed price of each product) are bucketed by product and rewritten where a batch touches them; ``closed/batch=N`` has the intervals that batch N closed,
``rejected/batch=N`` the rows it left out with a reason and ``settled/batch=N`` the observations it folded. Closed
history is never rewritten, and neither are buckets that a batch does not touch. A batch starts from the manifest
before its own number and is done when its manifest is written, so repeating it after a failure gives the same tables.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfline.operators import quality
from shelfline.operators.intervals import closed_rows, newer_closed, open_rows
from shelfline.plans.jobs import fold_settled, settle
from shelfline.schemas import HISTORY, OBSERVATIONS, PREVIOUS, PRODUCTS, product_id
from shelfline.sources import buckets as store

# Files taken into one micro-batch; each batch commits, so this is also the progress interval.
FILES_PER_BATCH = 50

REJECTED = T.StructType([*OBSERVATIONS.fields, T.StructField("reason", T.StringType())])
REASONS = ("no_url", "no_time", "retry_limit", "late")


class Run(NamedTuple):
    """What a run that took the arrived files has done: its last batch and the counters of its batches."""

    last_batch: int
    counters: dict[str, int]


def observation_stream(
    spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH
) -> DataFrame:
    return (
        spark.readStream.schema(OBSERVATIONS)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def last_batch(spark: SparkSession, base: str) -> int:
    """Number of the newest committed batch, read from storage; -1 before the first."""
    return max(store.committed_batches(spark, base), default=-1)


def _state_before(spark: SparkSession, base: str, batch: int) -> store.Manifest:
    earlier = [b for b in store.committed_batches(spark, base) if b < batch]
    return store.read_manifest(spark, base, max(earlier, default=-1))


def products_after(spark: SparkSession, base: str, batch: int) -> DataFrame:
    """Products after one of the newest batches (``buckets.KEPT_BATCHES``)."""
    return store.read_buckets(spark, base, "products", PRODUCTS, store.read_manifest(spark, base, batch))


def open_after(spark: SparkSession, base: str, batch: int) -> DataFrame:
    return store.read_buckets(spark, base, "open", HISTORY, store.read_manifest(spark, base, batch))


def previous_after(spark: SparkSession, base: str, batch: int) -> DataFrame:
    """The newest closed price of each product after a batch; with ``open_after`` all that a catalogue page reads of history."""
    return store.read_buckets(spark, base, "previous", PREVIOUS, store.read_manifest(spark, base, batch))


def _appended(spark: SparkSession, base: str, table: str, schema: T.StructType, batch: int) -> DataFrame:
    """Rows that committed batches up to ``batch`` appended; the filter prunes folders."""
    done = [b for b in store.committed_batches(spark, base) if b <= batch]
    if not done:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))
    numbered = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(numbered).parquet(f"{base}/{table}").filter(F.col("batch") <= done[-1])


def history_after(spark: SparkSession, base: str, batch: int) -> DataFrame:
    """All intervals after a batch."""
    closed = _appended(spark, base, "closed", HISTORY, batch).drop("batch")
    return closed.unionByName(open_after(spark, base, batch))


def rejected_after(spark: SparkSession, base: str, batch: int) -> DataFrame:
    """All rows left out up to a batch, with ``reason`` and ``batch``."""
    return _appended(spark, base, "rejected", REJECTED, batch)


def counters_of(spark: SparkSession, base: str, after: int = -1) -> DataFrame:
    """(batch, outcome, n) of the committed batches after a number: outcomes of settled rows and rejects by reason."""
    done = [b for b in store.committed_batches(spark, base) if b > after]
    rows = [(b, c, n) for b in done for c, n in store.read_manifest(spark, base, b).counters.items()]
    return spark.createDataFrame(rows, "batch long, outcome string, n long")


def fold_batch(
    spark: SparkSession,
    base: str,
    observations: DataFrame,
    batch: int,
    attempt_keys: list[str] | None = None,
    mode: str = "strict",
    n_buckets: int = store.BUCKETS,
) -> dict[str, int]:
    """Apply one micro-batch, write what it changes and commit; returns its counters.

    The settled rows are written first and read back: one pass over the input gives them, and the counters are taken
    in flight by that pass.
    """
    before = _state_before(spark, base, batch)
    whose = F.coalesce(product_id(F.col("url")), F.lit(0))
    arrived = observations.withColumn("_bucket", store.bucket_of(whose, n_buckets))
    touched = {r["_bucket"] for r in arrived.select("_bucket").distinct().collect()}
    products = store.read_buckets(spark, base, "products", PRODUCTS, before, touched)

    settled = settle(observations, products, attempt_keys)
    counted = Observation("settled")
    settled.rows.observe(counted, *quality.outcome_metrics()).write.mode("overwrite").parquet(f"{base}/settled/batch={batch}")
    rows = spark.read.schema(settled.rows.schema).parquet(f"{base}/settled/batch={batch}")

    left_out = settled._replace(rows=rows).rejected().select(*REJECTED.names)
    dropped = Observation("rejected")
    by_reason = [F.count_if(F.col("reason") == r).alias(r) for r in REASONS]
    left_out.observe(dropped, *by_reason).write.mode("overwrite").parquet(f"{base}/rejected/batch={batch}")

    opened = store.read_buckets(spark, base, "open", HISTORY, before, touched)
    new_products, new_history = fold_settled(products, opened, rows, mode)
    new_history = new_history.persist()
    try:
        closed = closed_rows(new_history)
        closed.write.mode("overwrite").parquet(f"{base}/closed/batch={batch}")
        versions = store.rewrite_buckets(new_products, base, "products", F.col("id"), n_buckets, batch, touched, before)
        versions |= store.rewrite_buckets(open_rows(new_history), base, "open", F.col("product_id"), n_buckets, batch, touched, before)
        previous = newer_closed(store.read_buckets(spark, base, "previous", PREVIOUS, before, touched), closed)
        versions |= store.rewrite_buckets(previous, base, "previous", F.col("product_id"), n_buckets, batch, touched, before)
    finally:
        new_history.unpersist()
    counters = {k: int(n) for k, n in (counted.get | dropped.get).items()}
    store.commit(spark, base, store.Manifest(batch, versions, counters))
    store.remove_superseded(spark, base)
    return counters


def start_ingest(
    observations: DataFrame,
    base: str,
    attempt_keys: list[str] | None = None,
    mode: str = "strict",
    available_now: bool = False,
    n_buckets: int = store.BUCKETS,
) -> StreamingQuery:
    """Start folding a stream of observations into the tables under ``base``.

    Offsets are kept in ``base/offsets``; with ``available_now`` the query takes what has arrived
    and stops.
    """

    def fold(frame: DataFrame, batch: int) -> None:
        fold_batch(frame.sparkSession, base, frame, batch, attempt_keys, mode, n_buckets)

    writer = observations.writeStream.foreachBatch(fold).option(
        "checkpointLocation", f"{base}/offsets"
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_ingest(
    observations: DataFrame,
    base: str,
    attempt_keys: list[str] | None = None,
    mode: str = "strict",
    null_price_limit: int | None = None,
    n_buckets: int = store.BUCKETS,
) -> Run:
    """Take what has arrived and stop; with a limit, fail afterwards if the run met too many null prices.

    As in a crawl that ends with an alarm, the tables are stored before the gate is asked, so a rerun goes on
    from there.
    """
    spark = observations.sparkSession
    before = last_batch(spark, base)
    start_ingest(observations, base, attempt_keys, mode, True, n_buckets).awaitTermination()
    counters: dict[str, int] = {}
    for row in counters_of(spark, base, before).collect():
        counters[row["outcome"]] = counters.get(row["outcome"], 0) + row["n"]
    if null_price_limit is not None:
        quality.require_prices(counters.get("null_price", 0), null_price_limit)
    return Run(last_batch(spark, base), counters)
