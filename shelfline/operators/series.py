"""Price series for charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.dates import days_before, other_day
from shelfline.operators.hotkeys import HOT_ROWS, MAX_SLICES, SLICE, slice_hot_keys

# Days on a sparkline, and the ranges a chart offers.
SPARKLINE_DAYS = 7
CHART_DAYS = [7, 30, 365, 1825]


def overlapping(history: DataFrame, days: int, now: Column) -> DataFrame:
    """Intervals that overlap the last ``days`` days; plain comparisons that reach the scan."""
    since = days_before(now, days)
    return history.filter(
        (F.col("product_id") > 0)
        & (F.col("end_ts").isNull() | (F.col("end_ts") >= since))
        & (F.col("start_ts") <= now)
    )


def chart_points(history: DataFrame, days: int, now: Column, key: str = "product_id") -> DataFrame:
    """One or two points per interval: its start, and its end when that is on another day.

    Both are clamped to the range; intervals without a price give no points. Points of a product
    are ordered by ``(start_ts, point)``.
    """
    start = F.greatest(F.col("start_ts"), days_before(now, days))
    end = F.least(F.coalesce("end_ts", now), now)
    points = F.array(
        F.struct(F.lit(0).alias("point"), start.alias("point_ts")),
        F.struct(F.lit(1).alias("point"), end.alias("point_ts")),
    )
    shown = F.filter(points, lambda p: (p["point"] == 0) | other_day(start, end))
    return (
        history.filter(F.col("price").isNotNull())
        .select(key, "price", "start_ts", F.inline(shown))
        .select(key, "start_ts", "point", "point_ts", "price")
    )


def price_series(history: DataFrame, days: int, now: Column) -> DataFrame:
    return chart_points(overlapping(history, days, now), days, now)


def sparklines(
    shown: DataFrame, history: DataFrame, now: Column, days: int = SPARKLINE_DAYS
) -> DataFrame:
    """Points for the products of one page, in a single join instead of a query per product.

    A page comes out of a limit, so the planner knows that it is small and broadcasts it; a larger
    selection is joined by shuffling.
    """
    wanted = shown.select(F.col("id").alias("product_id"))
    recent = overlapping(history, days, now)
    return chart_points(recent.join(wanted, "product_id", "left_semi"), days, now)


def packed_series(
    points: DataFrame,
    key: str = "product_id",
    hot_rows: int = HOT_ROWS,
    max_slices: int = MAX_SLICES,
) -> DataFrame:
    """Parallel arrays ``labels`` and ``prices`` per product.

    A product with more points than one row should hold comes as several rows with ascending
    ``part``; everything else is a single row with part 0.
    """
    sliced, _ = slice_hot_keys(points, key, "start_ts", hot_rows, max_slices)
    ordered = F.array_sort(F.collect_list(F.struct("start_ts", "point", "point_ts", "price")))
    return (
        sliced.groupBy(key, F.col(SLICE).alias("part"))
        .agg(ordered.alias("points"))
        .select(
            key,
            "part",
            F.transform("points", lambda p: F.date_format(p["point_ts"], "yyyy-MM-dd")).alias("labels"),
            F.transform("points", lambda p: p["price"]).alias("prices"),
        )
    )
