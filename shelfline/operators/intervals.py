"""Price intervals from ordered observations, and reductions over stored intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.operators.segments import CUT, SLICE, segmented

PRICE_KEY = ("price", "currency", "original_price")


def _run_columns(df: DataFrame, key: str, ts: str, value: Column, order: list) -> DataFrame:
    """Number the runs of equal values of each (key, slice) and the rows inside each run.

    All windows share one partitioning and one ordering, so they cost one shuffle and one sort.
    """
    w = Window.partitionBy(key, SLICE).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.withColumn("_value", value)
        .withColumns(
            {
                "_previous": F.lag(F.struct("_value")).over(w),
                "_pos": F.row_number().over(w),
                "_next_ts": F.lead(ts).over(w),
                "_next_carried": F.lead("_carried").over(w),
            }
        )
        .withColumn(
            "_changed",
            F.col("_carried")
            | F.col("_previous").isNull()
            | ~F.col("_previous._value").eqNullSafe(F.col("_value")),
        )
        .withColumns(
            {
                "_run": F.sum(F.col("_changed").cast("int")).over(so_far),
                "_run_start": F.max(F.when(F.col("_changed"), F.col("_pos"))).over(so_far),
            }
        )
        .withColumn("_in_run", F.col("_pos") - F.col("_run_start") + 1)
        .drop("_previous")
    )


def _carry(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """What each slice of a cut key inherits from its neighbours: a scan over the summaries of the slices.

    One row per (key, slice): fewer than two rows a segment in all (see ``segments``).
    """
    start = F.struct(F.col(ts).alias("ts"), F.col("_carried").alias("carried"))
    per_slice = (
        rows.groupBy(key, SLICE)
        .agg(
            F.min_by("_value", "_pos").alias("first_value"),
            F.max_by("_value", "_pos").alias("last_value"),
            F.min_by("_carried", "_pos").alias("first_carried"),
            F.min_by(ts, "_pos").alias("first_ts"),
            F.max("_run").alias("runs"),
            F.max_by("_in_run", "_pos").alias("last_run"),
            F.min_by(start, F.when(F.col("_run") == 2, F.col("_pos"))).alias("second_start"),
            F.min_by(start, "_pos").alias("first_start"),
        )
    )
    w = Window.partitionBy(key).orderBy(SLICE)
    later = w.rowsBetween(1, Window.unboundedFollowing)
    joined = (
        per_slice.withColumn(
            "_joins",
            ~F.col("first_carried")
            & F.lag(F.lit(True), 1, False).over(w)
            & F.lag("last_value").over(w).eqNullSafe(F.col("first_value")),
        )
        .withColumn("_head", ~(F.col("_joins") & (F.col("runs") == 1)))
        .withColumn("_stretch", F.sum(F.col("_head").cast("int")).over(w))
        .withColumn(
            "_start_here",
            F.when(F.col("_joins"), F.col("second_start")).otherwise(F.col("first_start")),
        )
    )
    tail = Window.partitionBy(key, "_stretch").orderBy(SLICE)
    return (
        joined.withColumn("_tail", F.sum("last_run").over(tail))
        .select(
            key,
            SLICE,
            F.col("_joins").alias("_slice_joins"),
            F.when(F.col("_joins"), F.lag("_tail").over(w)).otherwise(0).alias("_before"),
            F.lead("first_ts").over(w).alias("_slice_next_ts"),
            F.lead("first_carried").over(w).alias("_slice_next_carried"),
            F.first("_start_here", ignorenulls=True).over(later).alias("_slice_next_start"),
        )
    )


def _ordered_runs(
    observations: DataFrame,
    key: str,
    ts: str,
    value_cols: tuple[str, ...],
    tie_cols: tuple[str, ...],
    carried: str | None,
    segments: int | None,
    sizing: DataFrame | None,
) -> tuple[DataFrame, list[str], bool]:
    """Rows with their runs inside each slice and, if any key is cut, what their slice inherits; their ordering; whether any is cut."""
    flagged = observations.withColumn(
        "_carried", F.coalesce(F.col(carried), F.lit(False)) if carried else F.lit(False)
    ).withColumn("_fresh", ~F.col("_carried"))
    order = list(dict.fromkeys([ts, "_fresh", *tie_cols, *value_cols]))
    sliced, any_cut = segmented(flagged, key, order, segments, sizing)
    value = F.struct(*value_cols)
    rows = _run_columns(sliced, key, ts, value, order)
    if any_cut:
        inherited = _carry(_run_columns(sliced.filter(CUT), key, ts, value, order), key, ts)
        inherited = inherited.withColumnsRenamed({key: "_slice_key", SLICE: "_slice_at"})
        same = F.col(key).eqNullSafe(F.col("_slice_key")) & (F.col(SLICE) == F.col("_slice_at")) & F.col(CUT)
        rows = rows.join(F.broadcast(inherited), same, "left").drop("_slice_key", "_slice_at")
    return rows, order, any_cut


def _intervals(
    observations: DataFrame,
    mode: str,
    key: str,
    ts: str,
    value_cols: tuple[str, ...],
    tie_cols: tuple[str, ...],
    carried: str | None,
    segments: int | None,
    sizing: DataFrame | None,
) -> DataFrame:
    rows, order, any_cut = _ordered_runs(observations, key, ts, value_cols, tie_cols, carried, segments, sizing)
    if any_cut:
        inherited = F.when(F.col("_run") == 1, F.coalesce("_before", F.lit(0))).otherwise(0)
        rows = rows.withColumns(
            {
                "_in_run": F.col("_in_run") + inherited,
                # the last row of a slice is followed by the first row of the next one
                "_next_carried": F.coalesce("_next_carried", "_slice_next_carried"),
                "_next_ts": F.coalesce("_next_ts", "_slice_next_ts"),
            }
        )
    if mode == "strict":
        # every second observation of a run only closes the interval the one before it opened
        kept = rows.filter(F.col("_in_run") % 2 == 1)
        # an interval carried over from stored history that is followed by a newer one stays as is
        end = F.when(~F.coalesce("_next_carried", F.lit(False)), F.col("_next_ts"))
    else:
        kept = rows.filter(F.col("_in_run") == 1)
        w = Window.partitionBy(key, SLICE).orderBy(*order)
        next_start, next_carried = F.lead(ts).over(w), F.lead("_carried").over(w)
        if any_cut:
            next_start = F.coalesce(next_start, F.col("_slice_next_start.ts"))
            next_carried = F.coalesce(next_carried, F.col("_slice_next_start.carried"))
        end = F.when(~F.coalesce(next_carried, F.lit(False)), next_start)
    return kept.select(
        key, *[c for c in value_cols if c != key], F.col(ts).alias("start_ts"), end.alias("end_ts")
    )


def strict_intervals(
    observations: DataFrame,
    key: str = "product_id",
    ts: str = "observed_at",
    value_cols: tuple[str, ...] = PRICE_KEY,
    tie_cols: tuple[str, ...] = (),
    carried: str | None = None,
    segments: int | None = None,
    sizing: DataFrame | None = None,
) -> DataFrame:
    """Validity intervals as they are recorded observation by observation.

    An observation equal to the open interval closes it; the next one opens a new interval even
    at the same value; a different value closes the open interval and opens its own. So inside a
    run of equal values the odd observations open and every following observation closes.

    ``carried`` names a boolean column that marks rows which are stored open intervals rather
    than observations; they keep their start and simply come first. Observations of one time follow
    ``tie_cols``, then their values. ``segments`` and ``sizing`` say into how many fair shares the ordered
    table is cut and which cheaper table tells where (see ``segments``).
    """
    return _intervals(
        observations, "strict", key, ts, value_cols, tie_cols, carried, segments, sizing
    )


def coalesced_intervals(
    observations: DataFrame,
    key: str = "product_id",
    ts: str = "observed_at",
    value_cols: tuple[str, ...] = PRICE_KEY,
    tie_cols: tuple[str, ...] = (),
    carried: str | None = None,
    segments: int | None = None,
    sizing: DataFrame | None = None,
) -> DataFrame:
    """One interval per run of equal values; the last one stays open."""
    return _intervals(
        observations, "coalesced", key, ts, value_cols, tie_cols, carried, segments, sizing
    )


def mark_changes(
    observations: DataFrame,
    key: str = "product_id",
    ts: str = "observed_at",
    value_cols: tuple[str, ...] = PRICE_KEY,
    tie_cols: tuple[str, ...] = (),
    segments: int | None = None,
    sizing: DataFrame | None = None,
) -> DataFrame:
    """Observations with ``changed``: the value differs from the one before (NULLs are equal)."""
    rows, _, any_cut = _ordered_runs(observations, key, ts, value_cols, tie_cols, None, segments, sizing)
    changed = F.col("_changed")
    if any_cut:
        continues = F.coalesce("_slice_joins", F.lit(False)) & (F.col("_pos") == 1)
        changed = changed & ~continues
    return rows.select(*observations.columns, changed.alias("changed"))


def open_rows(history: DataFrame) -> DataFrame:
    return history.filter(F.col("end_ts").isNull())


def closed_rows(history: DataFrame) -> DataFrame:
    return history.filter(F.col("end_ts").isNotNull())


def _whole_row(history: DataFrame, key: str) -> Column:
    return F.struct(*[c for c in history.columns if c != key])


def _latest(history: DataFrame, key: str, tie_cols: tuple[str, ...]) -> DataFrame:
    newest = F.max_by(_whole_row(history, key), F.struct("start_ts", *tie_cols)).alias("_row")
    return history.groupBy(key).agg(newest).select(key, "_row.*").select(*history.columns)


def latest_record(
    history: DataFrame, key: str = "product_id", tie_cols: tuple[str, ...] = ()
) -> DataFrame:
    """The newest interval of each product, open or not (a reduction, combined before the shuffle)."""
    return _latest(history, key, tie_cols)


def latest_open(
    history: DataFrame, key: str = "product_id", tie_cols: tuple[str, ...] = ()
) -> DataFrame:
    """The newest open interval of each product."""
    return _latest(open_rows(history), key, tie_cols)


def latest_closed(history: DataFrame, key: str = "product_id", price: str = "price") -> DataFrame:
    """Price, end and start of the most recently closed interval of each product: the rows of a kept view.

    Of intervals that share start and end the dearest counts.
    """
    newest = F.max(F.struct(F.col("end_ts").alias("closed_at"), F.col("start_ts").alias("opened_at"), F.col(price).alias("prev_price")))
    return closed_rows(history).groupBy(key).agg(newest.alias("_newest")).select(key, "_newest.prev_price", "_newest.closed_at", "_newest.opened_at")


def newer_closed(kept: DataFrame, closed: DataFrame, key: str = "product_id") -> DataFrame:
    """The view ``latest_closed`` continued with newly closed intervals; closed history isn't read again.

    The newest of two is associative and idempotent, so batches may come in any order and may be repeated.
    """
    newest = F.max(F.struct("closed_at", "opened_at", "prev_price")).alias("_newest")
    both = kept.unionByName(latest_closed(closed, key).select(*kept.columns))
    return both.groupBy(key).agg(newest).select(key, "_newest.prev_price", "_newest.closed_at", "_newest.opened_at")


def previous_price(history: DataFrame, key: str = "product_id", price: str = "price") -> DataFrame:
    """Price of the most recently closed interval of each product; may be NULL."""
    return latest_closed(history, key, price).select(key, "prev_price")
