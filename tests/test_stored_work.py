"""Registered jobs write what they read again, and write it by parallel tasks."""

from datetime import datetime, timedelta
from pathlib import Path

from shelfline.plans import queries_ingest, stored_merge
from shelfline.schemas import HISTORY, PRODUCTS, align_schema
from shelfline.streaming import ingest

T0 = datetime(2024, 1, 1)


def test_the_view_of_previous_prices_is_made_from_the_stored_history(spark, tmp_path, monkeypatch):
    read = []

    def recorded(history):
        read.append(history.inputFiles())
        return latest_closed(history)

    latest_closed = stored_merge.latest_closed
    monkeypatch.setattr(stored_merge, "latest_closed", recorded)
    products = spark.createDataFrame([(k, f"u{k}", T0) for k in range(6)], "id long, url string, last_checked_at timestamp")
    intervals = [(10 * k + n, k, float(n), T0 + timedelta(days=n), T0 + timedelta(days=n + 1)) for k in range(6) for n in range(2)]
    history = spark.createDataFrame(intervals, "id long, product_id long, price double, start_ts timestamp, end_ts timestamp")
    made = stored_merge.create(align_schema(products, PRODUCTS), align_schema(history, HISTORY), str(tmp_path), 4)
    assert read[0] and all("/history/version=0/" in f for f in read[0])
    kept = stored_merge.read_table(spark, str(tmp_path), "previous", made)
    assert sorted((r.product_id, r.prev_price) for r in kept.collect()) == [(k, 1.0) for k in range(6)]


def test_a_lot_of_several_files_is_one_batch(spark, tmp_path, monkeypatch):
    events = [(k, T0 + timedelta(hours=6 * k), k % 7, "error" if k % 9 == 0 else "view", float(k), "{}") for k in range(118)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(events, schema).write.parquet(str(tmp_path / "events.parquet"))
    home = tmp_path / "home"
    monkeypatch.setattr(queries_ingest, "scratch_dir", lambda spark, name: str(home))
    got = {(r.batch, r.outcome): r.n for r in queries_ingest.streaming_counters(spark, str(tmp_path)).collect()}
    want = {}
    for k, ts, _, kind, *_ in events:
        batch = 0 if ts < datetime(2024, 1, 10) else 1 if ts < datetime(2024, 1, 20) else 2
        outcome = "inactive" if kind == "error" else "priced"
        want[batch, outcome] = want.get((batch, outcome), 0) + 1
        if batch == 0 and kind != "error" and k % queries_ingest.LATE_EVERY == 0:
            want[1, "late"] = want.get((1, "late"), 0) + 1
    assert got == {k: n for k, n in want.items() if n}
    assert ingest.last_batch(spark, str(home / "tables")) == 2
    assert len(list(Path(home, "in").glob("*.parquet"))) > 3
