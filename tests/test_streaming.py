import random
from datetime import datetime, timedelta

import pytest
from simulators import coalesce_prices, record_prices

from shelfline.operators import catalog
from shelfline.operators.intervals import previous_price
from shelfline.operators.quality import TooManyNullPrices
from shelfline.schemas import OBSERVATIONS
from shelfline.sources import buckets
from shelfline.streaming import ingest

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize(("mode", "model"), [("strict", record_prices), ("coalesced", coalesce_prices)])
def test_batches_as_they_arrive_equal_the_whole_log(spark, tmp_path, mode, model):
    rng = random.Random(3)
    log = {f"u{i}": [(t, float(rng.choice([1, 1, 2]))) for t in range(12)] for i in range(8)}
    source, base = str(tmp_path / "in"), str(tmp_path / "tables")

    def arrive(first, last):
        rows = []
        for url, seen in log.items():
            for t, price in seen[first:last]:
                row = dict.fromkeys(OBSERVATIONS.names)
                row.update(url=url, observed_at=T0 + timedelta(hours=t), attempt=0, status_code=200, price=price,
                           currency="CRC", name=f"n{t}", is_product=True, is_challenge=False)
                rows.append(tuple(row[c] for c in OBSERVATIONS.names))
        spark.createDataFrame(rows, OBSERVATIONS).coalesce(1).write.mode("append").parquet(source)

    last = -1
    for first, end in ((0, 5), (5, 6), (6, 12)):
        arrive(first, end)
        run = ingest.start_ingest(
            ingest.observation_stream(spark, source), base, ["url", "observed_at"], mode, available_now=True
        )
        run.awaitTermination()
        last = ingest.last_batch(spark, base)
    assert last == 2
    products = ingest.products_after(spark, base, last)
    assert {r["name"] for r in products.collect()} == {"n11"}
    urls = {r["id"]: r["url"] for r in products.collect()}

    def stored():
        return sorted(
            (urls[r["product_id"]], r["start_ts"], r["price"], str(r["end_ts"]))
            for r in ingest.history_after(spark, base, last).collect()
        )

    def hour(n):
        return None if n is None else T0 + timedelta(hours=n)

    want = sorted((u, hour(s), v, str(hour(e))) for u, seen in log.items() for v, s, e in model(seen))
    assert stored() == want

    def previous(rows):
        return sorted((r["product_id"], r["prev_price"]) for r in rows.collect())

    # the kept view is what the whole closed history gives, and a page built on it reads no closed interval
    whole = previous_price(ingest.history_after(spark, base, last))
    assert previous(ingest.previous_after(spark, base, last)) == previous(whole)
    shown = catalog.current_and_previous(products, ingest.open_after(spark, base, last), ingest.previous_after(spark, base, last))
    assert all("/closed/" not in f for f in shown.inputFiles())
    everything = catalog.current_and_previous(products, ingest.history_after(spark, base, last))
    assert sorted(map(str, shown.collect())) == sorted(map(str, everything.collect()))
    # repeating the last batch, as after a failure, gives the same tables
    again = spark.read.schema(OBSERVATIONS).parquet(source).filter("hour(observed_at) >= 6")
    ingest.fold_batch(spark, base, again, last, ["url", "observed_at"], mode)
    assert stored() == want
    assert previous(ingest.previous_after(spark, base, last)) == previous(whole)


def observations_at(spark, rows):
    """Rows (url, minute, price, status, attempt, run_id)."""
    made = []
    for url, minute, price, status, attempt, run_id in rows:
        row = dict.fromkeys(OBSERVATIONS.names)
        when = None if minute is None else T0 + timedelta(minutes=minute)
        row.update(url=url, observed_at=when, attempt=attempt, status_code=status, price=price, currency="CRC",
                   is_product=status == 200, is_challenge=False, run_id=run_id)
        made.append(tuple(row[c] for c in OBSERVATIONS.names))
    return spark.createDataFrame(made, OBSERVATIONS)


def folders(base, table):
    """{bucket: version} of the folders that exist."""
    import pathlib

    found = {}
    for path in pathlib.Path(base, table).glob("version=*/bucket=*"):
        found.setdefault(int(path.name[7:]), set()).add(int(path.parent.name[8:]))
    return found


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    base = str(tmp_path)
    first = [(f"u{k}", 1, 5.0, 200, 0, "r1") for k in range(40)]
    ingest.fold_batch(spark, base, observations_at(spark, first), 0, n_buckets=8)
    assert set(folders(base, "products")) == set(range(8))
    before = {p: p.stat().st_mtime_ns for p in tmp_path.glob("products/version=0/bucket=*/*.parquet")}
    ingest.fold_batch(spark, base, observations_at(spark, [("u3", 2, 6.0, 200, 0, "r2")]), 1, n_buckets=8)
    manifest = buckets.read_manifest(spark, base, 1)
    rewritten = [b for (t, b), v in manifest.versions.items() if t == "products" and v == 1]
    assert len(rewritten) == 1
    assert {p: p.stat().st_mtime_ns for p in before} == before
    assert ingest.products_after(spark, base, 1).count() == 40 and ingest.products_after(spark, base, 0).count() == 40
    assert ingest.history_after(spark, base, 1).count() == 41
    # the version that only manifest 0 names goes once two newer manifests exist
    ingest.fold_batch(spark, base, observations_at(spark, [("u3", 3, 7.0, 200, 0, "r3")]), 2, n_buckets=8)
    assert folders(base, "products")[rewritten[0]] == {1, 2}
    ingest.fold_batch(spark, base, observations_at(spark, [("u3", 4, 7.0, 200, 0, "r4")]), 3, n_buckets=8)
    assert folders(base, "products")[rewritten[0]] == {2, 3}
    assert ingest.history_after(spark, base, 3).filter("end_ts IS NULL").count() == 39


def test_an_uncommitted_batch_is_not_read_and_can_be_repeated(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    ingest.fold_batch(spark, base, observations_at(spark, [("u", 1, 5.0, 200, 0, None)]), 0, n_buckets=2)
    second = observations_at(spark, [("u", 2, 6.0, 200, 0, None), ("v", 2, 1.0, 200, 0, None)])

    def fails(*_):
        raise OSError("lost before the commit")

    with monkeypatch.context() as m:
        m.setattr(buckets, "commit", fails)
        with pytest.raises(OSError):
            ingest.fold_batch(spark, base, second, 1, n_buckets=2)
    assert ingest.last_batch(spark, base) == 0
    assert [r.price for r in ingest.history_after(spark, base, 0).collect()] == [5.0]
    for _ in range(2):
        assert ingest.fold_batch(spark, base, second, 1, n_buckets=2)["priced"] == 2
        assert sorted(r.price for r in ingest.history_after(spark, base, 1).collect()) == [1.0, 5.0, 6.0]
        assert ingest.rejected_after(spark, base, 1).count() == 0


def test_rejected_rows_keep_their_reason_and_the_gate_comes_last(spark, tmp_path):
    base, source = str(tmp_path / "tables"), str(tmp_path / "in")
    rows = [
        ("u", 5, None, 200, 0, "r1"), ("u", 6, 9.0, 200, 1, "r1"),  # settled by the retry
        ("v", 5, None, 200, 0, "r1"), ("w", 5, 3.0, 200, None, "r1"),
        ("x", 5, 3.0, 200, 3, "r1"), (None, 5, 3.0, 200, 0, "r1"), ("y", None, 3.0, 200, 0, "r1"),
    ]
    observations_at(spark, rows).write.parquet(source)
    stream = ingest.observation_stream(spark, source)
    with pytest.raises(TooManyNullPrices):
        ingest.run_ingest(stream, base, null_price_limit=0, n_buckets=4)
    assert ingest.last_batch(spark, base) == 0  # stored all the same
    assert {(r.url, r.reason) for r in ingest.rejected_after(spark, base, 0).collect()} == {("x", "retry_limit"), (None, "no_url"), ("y", "no_time")}
    observations_at(spark, [("u", 4, 1.0, 200, 0, "r0"), ("w", 7, 3.0, 200, 0, "r2")]).write.mode("append").parquet(source)
    done = ingest.run_ingest(stream, base, null_price_limit=0, n_buckets=4)
    assert done.last_batch == 1
    assert {k: n for k, n in done.counters.items() if n} == {"priced": 1, "late": 1}
    again = ingest.run_ingest(stream, base, null_price_limit=0, n_buckets=4)
    assert again == ingest.Run(1, {})
    assert {(r.batch, r.url, r.reason) for r in ingest.rejected_after(spark, base, 1).filter("batch = 1").collect()} == {(1, "u", "late")}
