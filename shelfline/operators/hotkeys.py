"""Cutting the ordered rows of very frequent keys into consecutive slices.

A window over a key sorts all rows of that key in one task. When one product holds a large share
of the table that task is the job. ``slice_hot_keys`` gives each row a slice number: 0 for
ordinary keys, and for frequent keys the position among quantile cuts of the ordering time, so
that a window over (key, slice) stays small. What crosses a slice border has to be carried over
by the caller; ``operators.intervals`` does so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = "_slice"
HOT = "_hot"

# A key is cut when it has more rows than HOT_ROWS and more than 1/MAX_SLICES of the table. At
# most MAX_SLICES keys can qualify. Together they want fewer than 2 * MAX_SLICES slices, and rounding
# the stride gives each at most twice what it wants, so fewer than 4 * MAX_SLICES cuts are kept
# whatever the size of the data.
HOT_ROWS = 1_000_000
MAX_SLICES = 1024
_ACCURACY = 10_000


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def hot_cuts(
    df: DataFrame, key: str, ts: str, hot_rows: int = HOT_ROWS, max_slices: int = MAX_SLICES
) -> list[tuple[object, list[int]]]:
    """(key, ascending cut points in microseconds) of every frequent key; usually empty.

    Counting is a pre-aggregated pass over the key column alone, and only when a frequent key
    exists a second one sketches the quantiles of its times.
    """
    counts = df.groupBy(key).count()
    top = counts.agg(F.sum("count").alias("total"), F.max("count").alias("most")).first()
    if top["total"] is None:
        return []
    threshold = max(hot_rows, top["total"] // max_slices)
    if top["most"] <= threshold:
        return []
    hot = counts.filter((F.col("count") > threshold) & F.col(key).isNotNull())
    steps = [i / max_slices for i in range(1, max_slices)]
    sketched = (
        df.join(F.broadcast(hot), key)
        .groupBy(key)
        .agg(
            F.percentile_approx(_micros(ts), steps, _ACCURACY).alias("cuts"),
            F.max("count").alias("count"),
        )
        .collect()
    )
    bounds = []
    for row in sketched:
        wanted = -(-row["count"] // threshold)
        stride = max(1, max_slices // wanted)
        bounds.append((row[key], sorted(set(row["cuts"][stride - 1 :: stride]))))
    return bounds


def slice_hot_keys(
    df: DataFrame,
    key: str,
    ts: str,
    hot_rows: int = HOT_ROWS,
    max_slices: int = MAX_SLICES,
    sizing: DataFrame | None = None,
) -> tuple[DataFrame, bool]:
    """``df`` with ``_slice`` and ``_hot`` columns, and whether any key was cut at all.

    The slice number never decreases along ``ts`` within a key, and rows of equal time share one.
    ``sizing`` may give a cheaper table with the same key and time columns, such as the raw rows
    ``df`` was derived from; where the cuts lie affects only the balance of the slices.
    """
    measured = df if sizing is None else sizing
    bounds = hot_cuts(measured.select(key, ts), key, ts, hot_rows, max_slices)
    if not bounds:
        return df.withColumns({SLICE: F.lit(0), HOT: F.lit(False)}), False
    schema = T.StructType(
        [T.StructField(key, df.schema[key].dataType), T.StructField("_cuts", T.ArrayType(T.LongType()))]
    )
    cuts = df.sparkSession.createDataFrame(bounds, schema)
    marked = df.join(F.broadcast(cuts), key, "left")
    # largest number of cuts that lie at or before the row, found by halving steps
    size = F.size("_cuts")
    halvings = [1 << i for i in reversed(range(max_slices.bit_length()))]
    position = F.aggregate(
        F.array(*[F.lit(h) for h in halvings]),
        F.lit(0),
        lambda acc, step: F.when(
            (acc + step <= size) & (F.get(F.col("_cuts"), acc + step - 1) <= _micros(ts)), acc + step
        ).otherwise(acc),
    )
    return (
        marked.withColumns(
            {
                SLICE: F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(position),
                HOT: F.col("_cuts").isNotNull(),
            }
        ).drop("_cuts"),
        True,
    )
