"""Pages by position and by last row, and merges that rewrite touched buckets only."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfline.operators import pages
from shelfline.plans import stored_merge
from shelfline.schemas import HISTORY, PRODUCTS, align_schema, history_id


@pytest.fixture(scope="module")
def shelf(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([None, "", "a", "b", "Ñandú"]), rng.choice([True, False, None]), rng.choice([None, 1.0, 2.5])) for k in range(500)]
    return spark.createDataFrame(rows, "id long, name string, is_active boolean, price double").repartition(5)


KEYS = [
    pages.base_keys(),
    [pages.Key("price", nulls_first=False), *pages.base_keys()],
    [pages.Key("price", descending=True, nulls_first=True), pages.Key("name", nulls_first=False), pages.Key("id", descending=True)],
]


@pytest.mark.parametrize("keys", KEYS)
def test_pages_equal_the_whole_order(shelf, keys):
    everything = [r.id for r in shelf.orderBy(*pages.orders(keys)).collect()]
    index = pages.position_index(shelf, keys, step=64)
    assert index.count() == 8
    for number in (1, 2, 9, 17):
        found = [r.id for r in pages.page_at(shelf, keys, index, number, size=30, step=64).collect()]
        assert found == everything[(number - 1) * 30 : number * 30]
    assert pages.page_at(shelf, keys, index, 40, size=30, step=64).count() == 0


@pytest.mark.parametrize("keys", KEYS)
def test_following_pages_meet_every_row_once(shelf, keys):
    part = shelf.filter("id < 150").coalesce(1).cache()
    seen, last = [], None
    while rows := pages.page_after(part, keys, last, size=40).collect():
        seen += [r.id for r in rows]
        last = rows[-1]
    assert seen == [r.id for r in part.orderBy(*pages.orders(keys)).collect()]
    part.unpersist()


def test_filter_reaches_the_scan(spark, shelf, tmp_path):
    shelf.write.parquet(f"{tmp_path}/shelf")
    rows = spark.read.parquet(f"{tmp_path}/shelf")
    last = rows.orderBy(*pages.orders(pages.base_keys())).first()
    plan = pages.page_after(rows, pages.base_keys(), last)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_index_of_no_rows(shelf):
    none = shelf.limit(0)
    index = pages.position_index(none, pages.base_keys())
    assert pages.page_at(none, pages.base_keys(), index, 3).count() == 0


# ---- merges into stored buckets

OLD, NEW = datetime(2024, 1, 1), datetime(2024, 3, 1)


def _products(spark, rows):
    made = spark.createDataFrame(rows, "id long, url string, name string, is_active boolean, last_checked_at timestamp")
    return align_schema(made, PRODUCTS)


def _history(spark, rows):
    made = spark.createDataFrame(rows, "product_id long, price double, start_ts timestamp, end_ts timestamp")
    return align_schema(made.withColumn("id", history_id(F.col("product_id"), F.col("start_ts"))), HISTORY)


def _files(folder):
    return {str(f): f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}


def test_merge_keeps_files_of_untouched_buckets(spark, tmp_path):
    base = f"{tmp_path}/store"
    stored_merge.create(
        _products(spark, [(k, f"u{k}", f"p{k}", True, OLD) for k in range(64)]),
        _history(spark, [(k, 10.0, OLD, None) for k in range(64)]),
        base,
        buckets=16,
    )
    before = _files(tmp_path / "store" / "history")
    # 3 gets a new price, 5 is gone, 7 was looked at again without any history, 8 is not newer
    looked = [(3, "u3", "new", True, NEW), (5, "u5", "p5", False, NEW), (7, "u7", "p7", True, NEW), (8, "u8", "late", True, OLD)]
    deltas = _products(spark, looked).withColumn("shard", F.lit("worker-0"))
    theirs = _history(spark, [(3, 12.0, NEW, None), (8, 1.0, NEW, None)]).withColumn("shard", F.lit("worker-0"))
    done = stored_merge.merge_stored(spark, base, deltas, theirs)
    versions = done.versions
    assert {b for (t, b), v in versions.items() if t == "products" and v == 1} == {3, 5, 7}
    assert {b for (t, b), v in versions.items() if t == "history" and v == 1} == {3, 5}
    after = _files(tmp_path / "store" / "history")
    assert {f: t for f, t in after.items() if f in before} == before
    assert all("version=1" in f for f in after.keys() - before.keys())
    rows = stored_merge.read_table(spark, base, "history", done).collect()
    assert len(rows) == 65
    assert sorted((r.price, r.start_ts, r.end_ts) for r in rows if r.product_id == 3)[0] == (10.0, OLD, NEW)
    assert [(r.price, r.end_ts) for r in rows if r.product_id == 5] == [(10.0, NEW)]
    previous = stored_merge.read_table(spark, base, "previous", done).collect()
    assert sorted((r.product_id, r.prev_price, r.closed_at) for r in previous) == [(3, 10.0, NEW), (5, 10.0, NEW)]
    names = {r.id: r.name for r in stored_merge.read_table(spark, base, "products", done).collect()}
    assert len(names) == 64 and names[3] == "new" and names[8] == "p8"
    assert done.counters == {"buckets": 16, "merged": 3, "acted": 2}
    # again: nothing is newer, so nothing is written
    assert stored_merge.merge_stored(spark, base, deltas, theirs) == done
    assert _files(tmp_path / "store" / "history") == after


def test_merge_needs_stored_tables(spark, tmp_path):
    none = _products(spark, []).withColumn("shard", F.lit("worker-0"))
    with pytest.raises(ValueError, match="no stored tables"):
        stored_merge.merge_stored(spark, f"{tmp_path}/none", none, _history(spark, []).withColumn("shard", F.lit("w")))
