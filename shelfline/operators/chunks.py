"""Dividing an ordered work list into balanced consecutive chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.session import use_checkpoint_dir

# Parallel workers and URLs of one run.
WORKERS = 4
MAX_URLS = 12_000

# Parts an interval of the order key is counted in, and rows a selection may bring along beyond those asked for.
HISTOGRAM_PARTS = 1024
SPARE_ROWS = 10_000


def chunk_of(position: str, total: str, chunks: int) -> F.Column:
    """Chunk number of a 0-based position; the first ``total % chunks`` chunks get one more."""
    base = F.floor(F.col(total) / chunks)
    extra = F.pmod(F.col(total), F.lit(chunks))
    in_longer = F.col(position) < (base + 1) * extra
    longer = F.floor(F.col(position) / (base + 1))
    # with fewer rows than chunks there are no shorter chunks to fill
    shorter = extra + F.floor(F.try_divide(F.col(position) - (base + 1) * extra, base))
    return F.when(in_longer, longer).otherwise(shorter).cast("int")


def limited_chunks(df: DataFrame, order: list, chunks: int = WORKERS) -> DataFrame:
    """Adds ``chunk`` (from 0) to a list that is literally written down, in one task."""
    return df.withColumn("chunk", F.ntile(chunks).over(Window.orderBy(*order)) - 1)


def oldest_rows(df: DataFrame, ts: str, limit: int) -> DataFrame:
    """At least the ``limit`` rows with the smallest ``ts`` and few others: a filter on ``ts``, found by counting.

    The interval of the column is counted in equal parts, and the part that holds the ``limit``-th row is counted
    again, until it adds no more than ``SPARE_ROWS`` rows or is a single instant. A pass aggregates one column to a few
    counts, so there is no sort and no task that gathers rows, whatever the limit; rows of one instant are never split.
    """
    key = F.unix_micros(F.col(ts))
    edge = df.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(ts).alias("n")).first()
    if edge.n <= limit or limit <= 0:
        return df.filter(F.col(ts).isNotNull()) if limit > 0 else df.filter(F.lit(False))
    low, high, before = edge.low, edge.high, 0
    while True:
        width = -((low - high - 1) // HISTOGRAM_PARTS)
        part = F.floor((key - low) / width)
        counts = df.filter(key.between(low, high)).groupBy(part.cast("int").alias("part")).agg(F.count("*").alias("n"))
        for row in sorted(counts.collect()):
            if before + row.n >= limit:
                low, high = low + row.part * width, min(high, low + (row.part + 1) * width - 1)
                inside = row.n
                break
            before += row.n
        if before + inside <= limit + SPARE_ROWS or low == high:
            return df.filter(key <= high)


def numbered(df: DataFrame, order: list) -> DataFrame:
    """Adds ``position`` (from 0) and ``total`` over the whole ordered table, in parallel.

    Rows are range-partitioned and sorted, so each carries its partition and its place in it; the
    result is checkpointed to pin that layout, and the partition sizes (one row each) give the
    offsets. Equal leading keys are split as well, because the range covers the full ordering.
    """
    use_checkpoint_dir(df.sparkSession)
    place = F.monotonically_increasing_id()
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", place)
        .withColumns(
            {
                "_part": F.shiftright("_place", 33).cast("int"),
                "_in_part": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)),
            }
        )
        .drop("_place")
        .checkpoint()
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    w = Window.orderBy("_part")
    offsets = sizes.select(
        "_part",
        (F.sum("_size").over(w) - F.col("_size")).alias("_offset"),
        F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn("position", F.col("_offset") + F.col("_in_part"))
        .drop("_part", "_in_part", "_offset")
    )


def balanced_chunks(
    df: DataFrame, order: list, chunks: int = WORKERS, limit: int | None = None
) -> DataFrame:
    """Adds ``chunk`` (from 0) to a table of any size, or to its first ``limit`` rows, in parallel."""
    rows = numbered(df, order)
    if limit is not None:
        rows = rows.filter(F.col("position") < limit)
        rows = rows.withColumn("total", F.least("total", F.lit(limit)))
    return rows.withColumn("chunk", chunk_of("position", "total", chunks)).drop("position", "total")


def chunk_manifest(planned: DataFrame, chunks: int = WORKERS) -> DataFrame:
    """Rows per chunk, chunks without rows included."""
    sizes = planned.groupBy("chunk").agg(F.count("*").alias("n"))
    every = planned.sparkSession.range(chunks).select(F.col("id").cast("int").alias("chunk"))
    return every.join(sizes, "chunk", "left").select("chunk", F.coalesce("n", F.lit(0)).alias("n"))
