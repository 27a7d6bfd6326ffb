import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfline.operators import chunks, discover, search
from shelfline.plans import jobs
from shelfline.schemas import HISTORY, PRODUCTS, WATCHLIST, align_schema
from shelfline.sources import shards, sitemaps, tables, watchlists, worklists

NOW = datetime(2024, 1, 1)
DOCS = "loc string, xml string"
URLSET = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{}</urlset>'


def urlset(*urls):
    return URLSET.format("".join(f"<url><loc> {u} </loc><lastmod>2024</lastmod></url>" for u in urls))


def index(*locs):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"


def product_rows(spark, n):
    rows = [(i, f"u{i:02d}", True, datetime(2020, 1, 1 + i)) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, url string, is_active boolean, last_checked_at timestamp")
    return align_schema(df, PRODUCTS)


def test_sitemap_documents(spark):
    docs = spark.createDataFrame([("a", urlset("x", "y", "x")), ("b", "<urlset><url>"), ("c", index("a")), ("d", "")], DOCS)
    assert sorted(r["url"] for r in sitemaps.sitemap_urls(docs).collect()) == ["x", "x", "y"]


def test_sitemap_index(spark):
    stored = spark.createDataFrame([("a", urlset("x", "y")), ("bad", "<urlset")], DOCS)
    entry = spark.createDataFrame([("i", index("a", "bad", "lost"))], DOCS)
    got = sorted((r["loc"], str(r["url"])) for r in sitemaps.resolve_sitemap(entry, stored).collect())
    assert got == [("a", "x"), ("a", "y"), ("bad", "None"), ("lost", "None")]
    plain = spark.createDataFrame([("p", urlset("z"))], DOCS)
    assert [tuple(r) for r in sitemaps.resolve_sitemap(plain, stored).collect()] == [("p", "z")]


def test_discovery_job(spark):
    shop = "https://x/producto/"
    stored = spark.createDataFrame([("a", urlset(shop + "1/", shop + "2/", shop + "2/", "https://x/tag/1/"))], DOCS)
    entry = spark.createDataFrame([("i", index("a"))], DOCS)
    known = spark.createDataFrame([(1, shop + "1/"), (9, shop + "9/")], "id bigint, url string")
    out = jobs.discover_urls(entry, stored, align_schema(known, PRODUCTS), F.lit(NOW).cast("timestamp"))
    assert [tuple(r) for r in out.new.collect()] == [(shop + "2/", 2)]
    assert [r["url"] for r in out.orphaned.collect()] == [shop + "9/"]
    assert out.counts.first().asDict() == {"listed": 3, "tracked": 2, "new": 2, "orphaned": 1}
    added = out.products.filter(F.col("url") == shop + "2/").first()
    assert added["last_checked_at"] == datetime(1970, 1, 1) and added["is_active"] and added["first_seen_at"] == NOW


def test_audit_and_variants(spark):
    shop = "https://x/producto/"
    urls = [shop + "ram-2/", shop + "ram-8gb/", shop + "ssd/", "https://x/tag/1/"]
    stored = spark.createDataFrame([("a", urlset(*urls))], DOCS)
    counts, matches = jobs.sitemap_audit(
        spark.createDataFrame([("i", index("a", "lost"))], DOCS), stored,
        [shop.upper() + "SSD", shop + "ram-9/", "https://y/producto/ram-8gb/", shop + "none/"],
    )
    got = {r["loc"]: (r["urls"], r["product_urls"], r["numbered"]) for r in counts.collect()}
    assert got == {"a": (4, 3, 1), "lost": (0, 0, 0), None: (4, 3, 1)}
    found = {(r["target"], r["stage"], r["url"]) for r in matches.collect()}
    assert found == {
        (shop.upper() + "SSD", 1, shop + "ssd/"),
        (shop + "ram-9/", 3, shop + "ram-2/"), (shop + "ram-9/", 3, shop + "ram-8gb/"),
        ("https://y/producto/ram-8gb/", 2, shop + "ram-8gb/"),
    }
    many = [f"https://x/producto/none-{i}/" for i in range(200)] + [shop + "ssd/"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r["stage"] for r in discover.url_variants(rows, many).collect()] == [1]


@pytest.mark.parametrize(("rows", "sizes"), [(12, [3, 3, 3, 3]), (10, [3, 3, 2, 2]), (2, [1, 1, 0, 0]), (0, [0, 0, 0, 0])])
def test_chunks(spark, rows, sizes):
    products = product_rows(spark, rows)
    plan = jobs.plan_crawl(products)
    assert [r["n"] for r in chunks.chunk_manifest(plan).orderBy("chunk").collect()] == sizes
    order = [F.col("last_checked_at").asc(), F.col("url").asc()]
    large = chunks.balanced_chunks(products.select("url", "last_checked_at"), order)
    assert sorted(map(tuple, large.select("url", "chunk").collect())) == sorted(map(tuple, plan.collect()))
    cut = chunks.balanced_chunks(products.select("url", "last_checked_at"), order, limit=5)
    fewer = jobs.plan_crawl(products, limit=5)
    assert sorted(map(tuple, cut.select("url", "chunk").collect())) == sorted(map(tuple, fewer.collect()))
    inside = [r["chunk"] for r in plan.orderBy("url").collect()]
    assert inside == sorted(inside)


def test_overrides_and_chunk_files(spark, tmp_path):
    products = product_rows(spark, 5)
    listed = jobs.plan_crawl(products, workers=2, override=" b , , a ,c")
    assert sorted(map(tuple, listed.collect())) == [("a", 0), ("b", 0), ("c", 1)]
    worklists.write_chunks(jobs.plan_crawl(products, limit=3, workers=2), str(tmp_path / "chunks"))
    part = str(tmp_path / "chunks" / "chunk=0")
    assert sorted(r["url"] for r in worklists.choose_urls(spark, products, None, part).collect()) == ["u00", "u01"]
    assert worklists.choose_urls(spark, products).count() == 5
    assert worklists.choose_urls(spark, products, "x", part).first()["url"] == "x"


def test_shard_files(spark, tmp_path):
    base = tmp_path / "shards"
    for name in ("worker-0", "worker-10", "worker-x", "backup", "worker-extra-0"):
        product_rows(spark, 2).coalesce(1).write.parquet(str(base / "products" / name))
        spark.createDataFrame([], HISTORY).coalesce(1).write.parquet(str(base / "price_history" / name))
    (base / "products" / "worker-3").mkdir()
    (base / "products" / "worker-3" / "part-0.parquet").write_bytes(b"not a parquet file")
    products, history = shards.read_shards(spark, str(base))
    got = {r["shard"]: r["n"] for r in products.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert got == {"worker-0": 2, "worker-10": 2} and history.count() == 0
    with pytest.raises(ValueError, match="no worker shards"):
        shards.read_shards(spark, str(tmp_path / "nowhere"))


def test_shards_with_an_unreadable_file_are_left_out_whole(spark, tmp_path):
    base = tmp_path / "shards"
    price = spark.createDataFrame([(1, 1, 5.0, None, "CRC", NOW, None)], HISTORY)
    for name in (f"worker-{k}" for k in range(6)):
        product_rows(spark, 2).coalesce(1).write.parquet(str(base / "products" / name))
        price.coalesce(1).write.parquet(str(base / "price_history" / name))
    (base / "products" / "worker-1" / "part-9.parquet").write_bytes(b"not a parquet file")
    (base / "price_history" / "worker-3" / "part-9.parquet").write_bytes(b"not a parquet file")
    (base / "products" / "worker-4" / "part-9.parquet").write_bytes(b"")
    cut = next((base / "products" / "worker-5").glob("part-*.parquet"))
    whole = cut.read_bytes()
    cut.write_bytes(b"PAR1" + b"\xff" * (len(whole) // 4) + whole[4 + len(whole) // 4 :])  # the footer is intact
    for crc in (base / "products" / "worker-5").glob(".*.crc"):
        crc.unlink()
    out = shards.read_whole_shards(spark, str(base))
    for rows in (out.products, out.history, *shards.read_shards(spark, str(base))):
        assert {r["shard"] for r in rows.collect()} == {"worker-0", "worker-2"}
    assert sorted((r["shard"], r["source"]) for r in out.left_out.collect()) == [
        ("worker-1", "products"), ("worker-3", "price_history"), ("worker-4", "products"), ("worker-5", "products"),
    ]


def test_watch_list_documents(spark):
    entry = {"productId": 1, "url": "u", "name": "n", "addedAt": "2024-01-01T00:00:00.000Z", "priceAtAddition": 5}
    raws = [
        ("ana", json.dumps({"version": 1, "favorites": {"1": entry, "2": {**entry, "productId": 2, "notifyByEmail": True}}})),
        ("old", json.dumps({"version": 2, "favorites": {"1": entry}})), ("bad", "{x"), ("none", None),
    ]
    documents = spark.createDataFrame(raws, "user_id string, raw string")
    rows = watchlists.explode_documents(documents)
    assert rows.schema.names == WATCHLIST.names
    assert sorted((r["user_id"], r["product_id"], r["notify_by_email"], r["added_at"]) for r in rows.collect()) == [
        ("ana", 1, False, NOW), ("ana", 2, True, NOW),
    ]
    for size in (1, 100):
        back = watchlists.explode_documents(watchlists.to_documents(rows, size))
        assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    sizes = {r["user_id"]: r["favorites"] for r in watchlists.favorites_size(documents).collect()}
    assert sizes["ana"] == 2 and sizes["old"] == 0


def test_snapshots(spark, tmp_path):
    base, history = str(tmp_path / "snap"), spark.createDataFrame([(1, 1, 5.0, None, "CRC", NOW, None)], HISTORY)
    tables.write_snapshot(product_rows(spark, 2), history, base, "run-1")
    tables.write_snapshot(product_rows(spark, 3), history, base, "run-2")
    assert tables.read_snapshot(spark, base)[0].count() == 3
    tables.write_snapshot(product_rows(spark, 1), history, base, "run-0")
    assert tables.latest_run(spark, base) == "run-0"
    old, past = tables.read_snapshot(spark, base, "run-1")
    assert old.count() == 2 and past.first()["price"] == 5.0


def test_older_files_read_with_missing_columns(spark, tmp_path):
    path = str(tmp_path / "old")
    product_rows(spark, 2).select("id", "url", "is_active").write.parquet(path)
    row = tables.read_products(spark, path).orderBy("id").first()
    assert row["url"] == "u00" and row["stock_locations"] is None and len(row) == len(PRODUCTS)


@pytest.mark.parametrize("spare", [0, 7, 10_000])
@pytest.mark.parametrize("limit", [0, 1, 40, 333, 5_000])
def test_oldest_rows_hold_the_limit_and_little_else(spark, monkeypatch, limit, spare):
    """Most rows share one instant, as products that were never checked do; it is never split."""
    monkeypatch.setattr(chunks, "SPARE_ROWS", spare)
    rng = random.Random(limit)
    times = [rng.choice([0, 0, 0, 10**9 + rng.randrange(40), rng.randrange(10**15), -5 * 10**14]) for _ in range(400)]
    rows = spark.createDataFrame([(f"u{k:03}", t) for k, t in enumerate(times)], "url string, micros long")
    rows = rows.select("url", F.timestamp_micros("micros").alias("ts"))
    got = {r.url for r in chunks.oldest_rows(rows, "ts", limit).collect()}
    order = sorted(range(400), key=lambda k: (times[k], k))
    wanted = {f"u{k:03}" for k in order[:limit]}
    assert wanted <= got
    if wanted and limit < 400:
        last = times[order[limit - 1]]
        assert len(got) <= max(limit + spare, sum(t <= last for t in times))


def test_chunk_file_wins_over_the_stalest_and_loses_to_an_override(spark, tmp_path):
    products = product_rows(spark, 8)
    spark.createDataFrame([("x",), ("y",), ("z",)], "url string").write.json(str(tmp_path / "chunk"))
    where = str(tmp_path / "chunk")
    assert sorted(map(tuple, jobs.plan_crawl(products, workers=2, chunk_path=where).collect())) == [("x", 0), ("y", 0), ("z", 1)]
    assert jobs.plan_crawl(products, workers=2, override="o", chunk_path=where).collect()[0]["url"] == "o"
    assert tuple(jobs.crawl_backlog(products, 5).first()) == (8, 5, 3)
    assert tuple(jobs.crawl_backlog(products, None).first()) == (8, 8, 0)


def test_a_table_of_targets_gives_what_a_list_gives(spark):
    rng = random.Random(8)
    urls = [f"https://shop.example/producto/{rng.choice(['red', 'Blue'])}-{rng.choice(['ring', 'pin'])}-{k}/" for k in range(60)]
    targets = [urls[3].upper(), urls[5], "red-ring", "blue-pin-999", "nothing-here-1", "https://other.example/producto/red-pin/", urls[9][:-1], "ring-7"]
    found = spark.createDataFrame([(u,) for u in urls + urls[:5]], "url string")
    asked = spark.createDataFrame([(t,) for t in [*targets, targets[0], None, "/"]], "target string")
    got = sorted(tuple(r) for r in discover.match_targets(found, asked).collect())
    assert got == sorted({tuple(r) for r in discover.url_variants(found, targets).collect()})
    assert {r[1] for r in got} == {1, 2, 3}


def test_targets_known_by_their_slug_are_not_paired_by_their_base(spark, monkeypatch):
    """Numbered slugs of one name: each is in its own URL, so the name they share is looked up for none of them."""
    asked = []

    def recorded(vocabulary, candidates):
        asked.extend(r["candidate"] for r in candidates.collect())
        return search.containing(vocabulary, candidates)

    monkeypatch.setattr(discover, "containing", recorded)
    urls = [f"https://shop.example/producto/red-ring-{k}/" for k in range(100, 160)]
    targets = [f"red-ring-{k}" for k in range(100, 160)] + [urls[0].upper(), "blue-pin-7", "red-ring-7"]
    got = discover.match_targets(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame([(t,) for t in targets], "target string"))
    want = [(f"red-ring-{k}", 2, u) for k, u in zip(range(100, 160), urls, strict=True)] + [(urls[0].upper(), 1, urls[0])]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want + [("red-ring-7", 3, u) for u in urls])
    # the whole URL is settled by equality; only the two targets without a slug are looked up by their base
    assert sorted(asked) == sorted([f"red-ring-{k}" for k in range(100, 160)] + ["blue-pin-7", "red-ring-7"] + ["blue-pin", "red-ring"])


def test_exploded_substrings_are_never_broadcast(spark, monkeypatch):
    """Spark takes a column of substrings to be as small as the words it comes from."""
    monkeypatch.setattr(search, "SENT_ROWS", 0)
    words = spark.createDataFrame([(f"word-{k:05}",) for k in range(50)], "token string")
    found = search.containing(words, words.withColumnRenamed("token", "candidate"))
    assert found.count() == 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the one broadcast is that of the sizes of substrings, on both uses of the index
    assert plan.count("BroadcastHashJoin") == plan.count("LeftSemi") == 2
