"""Segments of an ordered table: keys that fill more than one segment are cut at segment borders.

A window over a key sorts all rows of that key in one task. ``segmented`` takes the quantiles of the whole
ordering (key, time, ties, values) as borders, as a range partitioning does; a key inside one segment stays
whole, a key that spans several is cut where the borders fall, inside equal times as well. So a segment is a fair
share of the table whatever the key, and no number of rows is compared with anything. Each slice of a cut key can
then be summarised, and ``operators.intervals`` scans the summaries to correct the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE = "_slice"
CUT = "_cut"

# Borders are read off a random sample of about SAMPLE_ROWS rows a segment, so the driver holds some
# SAMPLE_ROWS * MAX_SEGMENTS sort keys at most. The sample decides the balance of the slices, not the results.
SAMPLE_ROWS = 16
MAX_SEGMENTS = 4096


def _borders(df: DataFrame, key: str, order: list[str], segments: int) -> DataFrame | None:
    """(key, ascending sort keys at which it is cut) of every key that holds several borders; fewer than ``segments`` rows."""
    rows = df.select(key, *order)
    wanted, total = SAMPLE_ROWS * segments, rows.count()
    sampled = rows.sample(min(1.0, wanted / total), seed=11).collect() if total else []
    if len(sampled) < 2:
        return None
    local = df.sparkSession.createDataFrame(sampled, rows.schema)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.struct(*order).alias("at"))))
    stride = max(1, len(sampled) // segments)
    picked = F.filter(ordered, lambda _, i: (i > 0) & (i % stride == 0))
    cuts = (
        local.agg(F.explode(picked).alias("border"))
        .groupBy(F.col("border.key").alias(key))
        .agg(F.array_sort(F.collect_set("border.at")).alias("_borders"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    found = cuts.collect()
    return df.sparkSession.createDataFrame(found, cuts.schema) if found else None


def _position(borders: Column, at: Column, most: int) -> Column:
    """Number of borders at or before a sort key, by halving steps."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda found, step: F.when(
            (found + step <= F.size(borders)) & (F.get(borders, found + step - 1) <= at), found + step
        ).otherwise(found),
    )


def segmented(
    df: DataFrame, key: str, order: list[str], segments: int | None = None, sizing: DataFrame | None = None
) -> tuple[DataFrame, bool]:
    """``df`` with ``_slice`` (0, and for cut keys ascending along ``order``) and ``_cut``, and whether any key is cut.

    ``segments`` is the number of shuffle partitions unless given. ``sizing`` may be a cheaper table to sample,
    such as the raw rows ``df`` was derived from; it needs the key and a leading part of ``order``. Rows that
    agree in the key and all of ``order`` share a slice. A NULL key is cut like any other.
    """
    if segments is None:
        segments = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segments = max(2, min(segments, MAX_SEGMENTS))
    measured = df if sizing is None else sizing
    shared = []
    for name in order:
        if name not in measured.columns:
            break
        shared.append(name)
    measured = measured.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in (key, *shared)])
    cuts = _borders(measured, key, shared, segments)
    if cuts is None:
        return df.withColumns({SLICE: F.lit(0), CUT: F.lit(False)}), False
    cuts = cuts.withColumnRenamed(key, "_cut_key")
    marked = df.join(F.broadcast(cuts), F.col(key).eqNullSafe(F.col("_cut_key")), "left")
    position = _position(F.col("_borders"), F.struct(*shared), segments)
    sliced = F.when(F.col("_borders").isNull(), F.lit(0)).otherwise(position)
    return marked.withColumns({SLICE: sliced, CUT: F.col("_borders").isNotNull()}).drop("_borders", "_cut_key"), True
