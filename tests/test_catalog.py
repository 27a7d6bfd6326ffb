from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfline.operators import alerts, catalog, quality, series
from shelfline.plans.jobs import catalog_view
from shelfline.schemas import HISTORY, PRODUCTS, WATCHLIST, align_schema

NOW = datetime(2024, 6, 8, 12)
WEEK_AGO = NOW - timedelta(days=7)
ITEMS = [
    # sku, name, price, previous, original, active, stock
    ("CPU1011", "AMD Ryzen 5", 39900.0, 45000.0, None, True, [("Alajuela", 1)]),
    ("MT2736", "Mouse Razer Kraken", 34900.0, 39900.0, None, True, [("Guapiles", 1)]),
    ("HE6006", "Headset", 67901.0, None, 69900.0, True, [("Heredia", 3)]),
    ("LT001", "Laptop", 850000.0, 800000.0, None, True, [("San Jose", 1)]),
    ("MS001", "Monitor", 45000.0, None, None, True, [("Alajuela", 2)]),
    ("MM001", "Memoria", 25000.0, None, None, False, None),
]


@pytest.fixture(scope="module")
def tables(spark):
    products, history = [], []
    for i, (sku, name, price, previous, original, active, stock) in enumerate(ITEMS, 1):
        url = f"https://x/producto/{name.lower().replace(' ', '-')}/"
        products.append((i, url, name, sku, active, stock))
        if previous is not None:
            history.append((i * 10, i, previous, None, "CRC", WEEK_AGO, NOW))
        history.append((i * 10 + 1, i, price, original, "CRC", NOW, None))
    rows = spark.createDataFrame(
        products,
        "id bigint, url string, name string, sku string, is_active boolean, stock_locations array<struct<location:string,quantity:int>>",
    )
    return align_schema(rows, PRODUCTS).cache(), spark.createDataFrame(history, HISTORY).cache()


def skus(rows, order):
    return [r["sku"] for r in catalog.page(rows, order).collect()]


def test_default_filter_and_inactive(tables):
    assert catalog_view(*tables)[0].count() == 5
    assert catalog_view(*tables, include_inactive=True)[0].count() == 6


def test_derived_columns(tables):
    rows = {r["sku"]: r for r in catalog_view(*tables, include_inactive=True)[0].collect()}
    assert rows["HE6006"]["discount_pct"] == 3 and rows["HE6006"]["change_badge"] is None
    assert tuple(rows["LT001"]["change_badge"]) == ("up", 6)
    assert rows["MM001"]["status"] == "inactive" and rows["CPU1011"]["status"] is None


def test_sorts(tables):
    def first(sort):
        return skus(*catalog_view(*tables, sort=sort))

    assert first("increase-desc")[0] == "LT001"
    assert first("discount-desc")[:2] == ["MT2736", "CPU1011"]
    assert first("price-asc")[0] == "MT2736" and first("price-desc")[0] == "LT001"
    assert first("name-asc")[0] == "CPU1011" and first("name-desc")[0] == "MT2736"
    assert first(None) == ["CPU1011", "HE6006", "LT001", "MS001", "MT2736"]


def test_search_overrides_the_sort(tables):
    assert skus(*catalog_view(*tables, query="CPU1011", sort="price-desc")) == ["CPU1011"]
    assert skus(*catalog_view(*tables, query="razer-kraken")) == ["MT2736"]
    assert skus(*catalog_view(*tables, query="nada")) == []
    assert skus(*catalog_view(*tables, query="--", sort="price-desc")) == skus(*catalog_view(*tables))


def test_favorites_filter(spark, tables):
    favorites = spark.createDataFrame([(1,), (4,)], "product_id bigint")
    rows, order = catalog_view(*tables, favorites=favorites)
    assert skus(rows, order) == ["CPU1011", "LT001"]


def test_pages_plan_as_top_k(tables):
    rows, order = catalog_view(*tables, sort="price-asc")
    plan = catalog.page(rows, order)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert [r["sku"] for r in catalog.page(rows, order, number=2, size=2).collect()] == ["MS001", "HE6006"]


def test_lookups(tables):
    products, history = tables
    url = "https://x/producto/laptop/"
    assert catalog.product_by_url(products, url).first()["sku"] == "LT001"
    assert [r["price"] for r in catalog.history_of(products, history, url).collect()] == [800000.0, 850000.0]
    assert catalog.product_urls(products).count() == 6
    assert catalog.active_with_price(products, history).count() == 5


def test_series(tables):
    now = F.lit(NOW + timedelta(days=2)).cast("timestamp")
    points = series.price_series(tables[1], 7, now).filter("product_id = 1").orderBy("start_ts", "point").collect()
    assert [(r["point_ts"], r["price"]) for r in points] == [
        (NOW - timedelta(days=5), 45000.0), (NOW, 45000.0), (NOW, 39900.0), (NOW + timedelta(days=2), 39900.0),
    ]
    packed = series.packed_series(series.price_series(tables[1], 7, now))
    row = packed.filter("product_id = 1").first()
    assert row["labels"] == ["2024-06-03", "2024-06-08", "2024-06-08", "2024-06-10"] and row["part"] == 0
    split = series.packed_series(series.price_series(tables[1], 7, now), hot_rows=1, max_slices=32)
    parts = split.filter("product_id = 1").orderBy("part").collect()
    assert sum((r["prices"] for r in parts), []) == [45000.0, 45000.0, 39900.0, 39900.0] and len(parts) > 1


def test_watch_list(spark, tables):
    rows = catalog_view(*tables, include_inactive=True)[0]
    watch = spark.createDataFrame([], WATCHLIST)
    now = F.lit(NOW).cast("timestamp")
    watch = alerts.add_favorites(watch, rows.filter("id <= 3"), F.lit("ana"), now)
    asked = spark.createDataFrame([("ana", 1, "ana@x.cr"), ("ana", 2, "bad")], "user_id string, product_id bigint, email string")
    watch = alerts.request_alerts(watch, asked)
    out = alerts.price_alerts(watch, rows).collect()
    assert [(r["product_id"], r["to_email"], r["current_price"], r["price_at_addition"]) for r in out] == [
        (1, "ana@x.cr", 39900.0, 39900.0)
    ]
    cheaper = watch.withColumn("price_at_addition", F.col("price_at_addition") * 2)
    changed = alerts.change_since_added(cheaper, rows).filter("product_id = 1").first()
    assert tuple(changed["change_since"]) == ("down", 50)
    fewer = alerts.remove_favorites(watch, spark.createDataFrame([("ana", 1)], "user_id string, product_id bigint"))
    assert alerts.favorite_counts(fewer).first()["favorites"] == 2


def test_integrity(spark, tables):
    def failed(products, history):
        return {r["check"] for r in quality.integrity_report(products, history).collect() if r["failed"]}

    assert failed(spark.createDataFrame([], PRODUCTS), tables[1]) == set()
    assert failed(*tables) == set()
    assert failed(tables[0], tables[1].filter("product_id = 1")) == {"no_price"}
    unnamed = tables[0].withColumn("name", F.when(F.col("id") == 1, F.col("name")))
    assert failed(unnamed, tables[1]) == {"no_name"}
    assert failed(tables[0].withColumn("name", F.lit("same")), tables[1]) == {"dominant_name"}
    assert quality.active_count(tables[0]).first()["active"] == 5


def test_null_price_gate(spark):
    counters = spark.createDataFrame([("priced", 5), ("null_price", 51)], "outcome string, n bigint")
    with pytest.raises(RuntimeError, match="51"):
        quality.null_price_gate(counters)
    quality.null_price_gate(counters, limit=51)


def test_stale_first(spark):
    rows = [(i, f"u{i}", i != 3, datetime(2020 + i, 1, 1)) for i in range(1, 6)]
    df = align_schema(spark.createDataFrame(rows, "id bigint, url string, is_active boolean, last_checked_at timestamp"), PRODUCTS)
    assert [r["url"] for r in catalog.stale_first(df, 3).collect()] == ["u1", "u2", "u4"]
    assert [r["url"] for r in catalog.stale_first(df, 3, include_inactive=True).collect()] == ["u1", "u2", "u3"]
