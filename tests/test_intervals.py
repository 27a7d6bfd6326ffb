import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from simulators import coalesce_prices, record_prices

from shelfline.operators.intervals import (
    closed_rows,
    coalesced_intervals,
    latest_closed,
    latest_open,
    latest_record,
    mark_changes,
    newer_closed,
    previous_price,
    strict_intervals,
)
from shelfline.operators.segments import segmented
from shelfline.plans.jobs import update_history
from shelfline.schemas import HISTORY

T0 = datetime(2024, 1, 1)
OBS = "product_id bigint, observed_at timestamp, price double, currency string, original_price double"


def at(n):
    return T0 + timedelta(minutes=n)


def random_log(seed, products=25, longest=60, hot=0):
    rng = random.Random(seed)
    log = {}
    for p in range(1, products + 1):
        n = hot if p == 1 and hot else rng.randint(1, longest)
        changes = rng.choice([0.1, 0.5, 0.9])
        price, rows = 10.0, []
        for i in range(n):
            if rng.random() < changes:
                price = rng.choice([10.0, 20.0, 30.0, None])
            rows.append((i * 3 + rng.randint(0, 2), (price, "CRC", rng.choice([None, None, 40.0]) if changes > 0.5 else None)))
        log[p] = rows
    return log


def frame(spark, log):
    rows = [
        (p, at(ts), v[0], v[1], v[2]) for p, observations in log.items() for ts, v in observations
    ]
    random.Random(7).shuffle(rows)
    return spark.createDataFrame(rows, OBS)


def found(df):
    return sorted(
        (
            (r["product_id"], (r["price"], r["currency"], r["original_price"]), r["start_ts"], r["end_ts"])
            for r in df.collect()
        ),
        key=lambda r: (r[0], r[2]),
    )


def expected(log, model):
    return [
        (p, v, at(s), None if e is None else at(e))
        for p, observations in sorted(log.items())
        for v, s, e in model(observations)
    ]


def simple(spark, prices, build):
    log = {1: [(i, (float(p), "CRC", None)) for i, p in enumerate(prices)]}
    return found(build(frame(spark, log)))


@pytest.mark.parametrize(
    ("prices", "rows", "still_open"),
    [([15], 1, 1), ([15, 15], 1, 0), ([15, 18], 2, 1), ([15, 15, 15], 2, 1), ([1, 1, 2, 2], 2, 0)],
)
def test_strict_small(spark, prices, rows, still_open):
    out = simple(spark, prices, strict_intervals)
    assert len(out) == rows
    assert sum(r[3] is None for r in out) == still_open


def test_coalesced_small(spark):
    out = simple(spark, [5, 5, 5, 6, 6, 5], coalesced_intervals)
    assert [(r[1][0], r[3] is None) for r in out] == [(5.0, False), (6.0, False), (5.0, True)]


def test_original_price_change_opens_an_interval(spark):
    log = {1: [(0, (15000.0, "CRC", None)), (1, (15000.0, "CRC", 16000.0))]}
    assert len(found(strict_intervals(frame(spark, log)))) == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_strict_equals_the_model(spark, seed):
    log = random_log(seed)
    assert found(strict_intervals(frame(spark, log))) == expected(log, record_prices)


@pytest.mark.parametrize("seed", [4, 5])
def test_coalesced_equals_the_model(spark, seed):
    log = random_log(seed)
    assert found(coalesced_intervals(frame(spark, log))) == expected(log, coalesce_prices)


@pytest.mark.parametrize("seed", [6, 7])
@pytest.mark.parametrize("segments", [8, 64, 4096])
def test_sliced_hot_product_equals_the_model(spark, seed, segments):
    log = random_log(seed, products=6, longest=10, hot=400)
    rows = frame(spark, log).cache()
    hot = {"segments": segments}
    assert found(strict_intervals(rows, **hot)) == expected(log, record_prices)
    assert found(coalesced_intervals(rows, **hot)) == expected(log, coalesce_prices)
    whole = mark_changes(rows, segments=2).collect()
    assert sorted(map(str, mark_changes(rows, **hot).collect())) == sorted(map(str, whole))


def test_long_equal_run_crosses_many_slices(spark):
    for n in (300, 301):
        log = {1: [(i, (10.0, "CRC", None)) for i in range(n)], 2: [(0, (1.0, "CRC", None))]}
        rows = frame(spark, log)
        hot = {"segments": 32}
        assert found(strict_intervals(rows, **hot)) == expected(log, record_prices)
        assert found(coalesced_intervals(rows, **hot)) == expected(log, coalesce_prices)


@pytest.mark.parametrize("mode", ["strict", "coalesced"])
@pytest.mark.parametrize("cut", [7, 60])
def test_history_continued_in_two_batches_equals_one(spark, mode, cut):
    log = random_log(11)
    early = {p: [r for r in rows if r[0] < cut] for p, rows in log.items()}
    late = {p: [r for r in rows if r[0] >= cut] for p, rows in log.items()}
    empty = spark.createDataFrame([], HISTORY)
    for hot in ({}, {"segments": 16}):
        first = update_history(empty, frame(spark, early), mode, **hot)
        both = update_history(first, frame(spark, late), mode, **hot)
        model = record_prices if mode == "strict" else coalesce_prices
        assert found(both) == expected(log, model)


def test_older_open_intervals_stay_open(spark):
    stored = spark.createDataFrame(
        [(1, 1, 5.0, None, "CRC", at(0), None), (2, 1, 6.0, None, "CRC", at(1), None)], HISTORY
    )
    fresh = spark.createDataFrame([(1, at(5), 7.0, "CRC", None)], OBS)
    for mode in ("strict", "coalesced"):
        out = found(update_history(stored, fresh, mode))
        assert [(r[1][0], r[3]) for r in out] == [(5.0, None), (6.0, at(5)), (7.0, None)]


def test_reductions(spark):
    rows = [
        (1, 1, 5.0, None, "CRC", at(0), at(1)),
        (2, 1, None, None, "CRC", at(1), at(3)),
        (3, 1, 7.0, None, "CRC", at(3), None),
        (4, 2, 8.0, None, "CRC", at(0), at(9)),
    ]
    history = spark.createDataFrame(rows, HISTORY)
    assert {r["product_id"]: r["id"] for r in latest_record(history).collect()} == {1: 3, 2: 4}
    assert {r["product_id"]: r["id"] for r in latest_open(history).collect()} == {1: 3}
    previous = {r["product_id"]: r["prev_price"] for r in previous_price(history).collect()}
    assert previous == {1: None, 2: 8.0}
    assert closed_rows(history).count() == 3


def test_view_of_closed_prices_continues(spark):
    def closed(*rows):
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], HISTORY)

    first = closed((1, 5.0, None, "CRC", at(0), at(2)), (2, 1.0, None, "CRC", at(0), at(9)), (None, 1.0, None, "CRC", at(0), at(1)))
    second = closed((1, None, None, "CRC", at(2), at(4)), (2, 7.0, None, "CRC", at(1), at(3)), (3, 2.0, None, "CRC", at(0), at(0)), (3, 4.0, None, "CRC", at(0), at(0)))
    want = {1: None, 2: 1.0, 3: 4.0, None: 1.0}
    for one, two in ((first, second), (second, first)):
        view = newer_closed(latest_closed(one), two)
        assert {r["product_id"]: r["prev_price"] for r in view.collect()} == want
        assert sorted(map(str, newer_closed(view, two).collect())) == sorted(map(str, view.collect()))
    assert {r["product_id"]: r["prev_price"] for r in previous_price(first.unionByName(second)).collect()} == want
    assert newer_closed(latest_closed(first.limit(0)), first.limit(0)).count() == 0


def test_one_shuffle_without_hot_products(spark):
    log = random_log(1)
    plan = strict_intervals(frame(spark, log))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SinglePartition" not in plan


def orderings(spark, n, distinct_ties):
    """One product at one time, beside a NULL product and single rows; ties tell the order, or values alone do."""
    rng = random.Random(n)
    rows = [(1, at(0), i if distinct_ties else 0, float(rng.choice([1, 1, 2]))) for i in range(n)]
    rows += [(None, at(i % 3), i if distinct_ties else 0, float(rng.choice([5, 6]))) for i in range(n // 2)]
    rows += [(p, at(p), 0, 3.0) for p in range(2, 20)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "product_id int, observed_at timestamp, tie int, price double")


@pytest.mark.parametrize("distinct_ties", [True, False])
def test_one_time_is_cut_by_ties_and_values(spark, distinct_ties):
    rows, df = orderings(spark, 600, distinct_ties)
    sliced, any_cut = segmented(df, "product_id", ["observed_at", "tie", "price"], 64)
    assert any_cut
    slices = {r["product_id"]: r["n"] for r in sliced.groupBy("product_id").agg(F.countDistinct("_slice").alias("n")).collect()}
    assert slices[1] >= (20 if distinct_ties else 2)
    assert slices[None] >= 2
    assert all(n == 1 for p, n in slices.items() if p not in (1, None))
    log = {}
    for product, when, tie, price in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:])):
        log.setdefault(product, []).append((when, price))
    for build, model in ((strict_intervals, record_prices), (coalesced_intervals, coalesce_prices)):
        out = build(df, value_cols=("price",), tie_cols=("tie",), segments=64)
        wanted = [(p, v, s, e) for p, seen in log.items() for v, s, e in model(seen)]
        got = [(r["product_id"], r["price"], r["start_ts"], r["end_ts"]) for r in out.collect()]
        assert sorted(map(str, got)) == sorted(map(str, wanted))


def test_segments_of_empty_and_single_tables(spark):
    empty = spark.createDataFrame([], OBS)
    one = spark.createDataFrame([(1, at(0), 1.0, "CRC", None)], OBS)
    for build in (strict_intervals, coalesced_intervals, mark_changes):
        assert build(empty, segments=8).count() == 0
        assert build(one, segments=8).count() == 1


def test_even_keys_are_never_cut(spark):
    df = spark.range(4000).select((F.col("id") % 400).alias("product_id"), F.col("id").alias("observed_at"))
    sliced, any_cut = segmented(df, "product_id", ["observed_at"], 8)
    assert not any_cut
    assert sliced.filter("_slice <> 0 OR _cut").count() == 0


def test_sizing_gives_borders_by_its_leading_columns(spark):
    log = random_log(3, products=4, longest=10, hot=500)
    rows = frame(spark, log)
    sizing = rows.select("product_id", F.col("observed_at").cast("timestamp"))
    assert found(strict_intervals(rows, segments=32, sizing=sizing)) == expected(log, record_prices)
