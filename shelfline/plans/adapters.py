"""The driver's tables seen as catalogue tables.

Parts are products, line items are price observations of parts, events are observations of users'
activity, web pages give URLs. Everything is derived by Spark from whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.operators.intervals import strict_intervals
from shelfline.schemas import HISTORY, OBSERVATIONS, PRODUCTS, align_schema, epoch, history_id

SHOP = "https://shop.example/producto/"
# Fixed points in time of the registered queries.
NOW = "2000-01-01 12:00:00"
MERGE_POINT = "1999-01-01 00:00:00"
WORKERS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table with its instants as time-zone aware timestamps in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(
        *[
            F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: the price is the event's value in bands of 50."""
    band = ((F.floor(F.col("value") / 50) + 1) * 50).cast("double")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("product_id"),
        F.col("ts").alias("observed_at"),
        "event_type",
        band.alias("price"),
        F.lit("CRC").alias("currency"),
        F.lit(None).cast("double").alias("original_price"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as price observations: one per part and shipping day."""
    price = (F.floor(F.min("l_quantity") / 10) * 10 + 10).cast("double")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_partkey") + 1).alias("product_id"), F.col("l_shipdate").alias("observed_at"))
        .agg(price.alias("price"), F.min("l_discount").alias("_discount"))
        .select(
            "product_id",
            "observed_at",
            "price",
            F.lit("CRC").alias("currency"),
            F.when(F.col("_discount") >= 0.05, F.col("price") * 1.25).alias("original_price"),
        )
    )


def offer_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product and day of every line item: what offers are reduced from."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") + 1).alias("product_id"), F.col("l_shipdate").alias("observed_at")
    )


def history(spark: SparkSession, sf_dir: str, before: str | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Price history of the parts, optionally of the observations before an instant; ``seen`` are the offers if stored."""
    seen = offers(spark, sf_dir) if seen is None else seen
    if before is not None:
        seen = seen.filter(F.col("observed_at") < instant(before))
    rows = strict_intervals(seen, sizing=offer_sizing(spark, sf_dir))
    rows = rows.withColumn("id", history_id(F.col("product_id"), F.col("start_ts")))
    return align_schema(rows, HISTORY)


def product_url() -> Column:
    """Every third slug ends in a number of its own."""
    key = F.col("p_partkey")
    tail = F.when(key % 3 == 0, F.concat(F.lit("-"), key)).otherwise(F.concat(F.lit("-x"), key))
    return F.concat(F.lit(SHOP), F.replace("p_name", F.lit(" "), F.lit("-")), tail, F.lit("/"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products, without check times."""
    store = F.struct(F.lit("main").alias("location"), (F.col("p_size") % 4).alias("quantity"))
    first = F.when(F.col("p_size") % 2 == 0, F.to_date(F.lit("1998-03-01")))
    latest = F.when(F.col("p_size") % 3 == 0, F.to_date(F.lit("1999-04-01"))).otherwise(first)
    return table(spark, sf_dir, "part").select(
        (F.col("p_partkey") + 1).alias("id"),
        product_url().alias("url"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_name")).alias("name"),
        F.col("p_brand").alias("sku"),
        F.col("p_type").alias("category"),
        F.when(F.col("p_size") % 7 != 0, F.array(store)).alias("stock_locations"),
        (F.col("p_size") > 5).alias("is_active"),
        first.alias("published_first"),
        latest.alias("published_latest"),
    )


def checked_parts(spark: SparkSession, sf_dir: str, before: str | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Parts with the time of their last observation as check time; ``seen`` as for ``history``."""
    seen = offers(spark, sf_dir) if seen is None else seen
    if before is not None:
        seen = seen.filter(F.col("observed_at") < instant(before))
    checks = seen.groupBy(F.col("product_id").alias("id")).agg(F.max("observed_at").alias("last_checked_at"))
    rows = parts(spark, sf_dir).join(checks, "id", "left")
    return align_schema(
        rows.withColumns(
            {
                "last_checked_at": F.coalesce("last_checked_at", epoch()),
                "first_seen_at": instant("1995-01-01 00:00:00"),
            }
        ),
        PRODUCTS,
    )


def shards(spark: SparkSession, sf_dir: str, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What four workers leave behind: full copies of their products, a third of them touched.

    Every fifth product was gone when its worker looked, so its history is still the stored one. ``seen`` as for
    ``history``.
    """
    seen = offers(spark, sf_dir) if seen is None else seen
    shard = F.concat(F.lit("worker-"), F.col("id") % WORKERS)
    before = checked_parts(spark, sf_dir, MERGE_POINT, seen).select(
        "id", F.col("last_checked_at").alias("_before")
    )
    touched = F.col("id") % 3 == 0
    gone = F.col("id") % 5 == 0
    products = (
        checked_parts(spark, sf_dir, seen=seen)
        .join(before, "id")
        .withColumns(
            {
                "last_checked_at": F.when(touched, F.col("last_checked_at")).otherwise(F.col("_before")),
                "is_active": F.when(touched & gone, F.lit(False)).otherwise(F.col("is_active")),
                "category": F.when(touched, F.lower("category")).otherwise(F.col("category")),
                "shard": shard,
            }
        )
        .drop("_before")
    )
    theirs = seen.filter(
        (F.col("observed_at") < instant(MERGE_POINT))
        | ((F.col("product_id") % 3 == 0) & (F.col("product_id") % 5 != 0))
    )
    rows = strict_intervals(theirs, sizing=offer_sizing(spark, sf_dir))
    rows = rows.withColumn("id", history_id(F.col("product_id"), F.col("start_ts")))
    delta_history = align_schema(rows, HISTORY).withColumn(
        "shard", F.concat(F.lit("worker-"), F.col("product_id") % WORKERS)
    )
    return products, delta_history


def sitemap_documents(urls: DataFrame, key: Column, per_document: int = 100) -> DataFrame:
    """Sitemap documents of at most ``per_document`` URLs each, cut by a dense numeric key."""
    entry = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    return (
        urls.select(F.floor(key / per_document).alias("_doc"), entry.alias("_entry"))
        .groupBy("_doc")
        .agg(F.concat_ws("", F.collect_list("_entry")).alias("_body"))
        .select(
            F.concat(F.lit("https://shop.example/sitemap-"), F.col("_doc"), F.lit(".xml")).alias("loc"),
            F.concat(
                F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
                F.col("_body"),
                F.lit("</urlset>"),
            ).alias("xml"),
            "_doc",
        )
    )


def sitemap_indexes(documents: DataFrame, per_index: int = 100) -> DataFrame:
    """Index documents naming the sitemap documents, plus one child each that is not stored."""
    entry = F.concat(F.lit("<sitemap><loc>"), F.col("loc"), F.lit("</loc></sitemap>"))
    return (
        documents.select(F.floor(F.col("_doc") / per_index).alias("_index"), entry.alias("_entry"))
        .groupBy("_index")
        .agg(F.concat_ws("", F.collect_list("_entry")).alias("_body"))
        .select(
            F.concat(F.lit("https://shop.example/index-"), F.col("_index"), F.lit(".xml")).alias("loc"),
            F.concat(
                F.lit("<sitemapindex>"),
                F.col("_body"),
                F.lit("<sitemap><loc>https://shop.example/lost-"),
                F.col("_index"),
                F.lit(".xml</loc></sitemap></sitemapindex>"),
            ).alias("xml"),
        )
    )


def price_text(amount: Column, style: Column) -> Column:
    """An amount written in one of four ways: US, European, Costa Rican or plain."""
    us = F.format_number(amount, 2)
    swapped = F.translate(us, ",.", ".,")
    return (
        F.when(style == 0, F.concat(F.lit("$ "), us))
        .when(style == 1, F.concat(F.lit("€ "), swapped))
        .when(
            style == 2,
            F.concat(F.lit("₡ "), F.translate(F.format_number(F.floor(amount), 0), ",", "."), F.lit(" colones")),
        )
        .otherwise(F.translate(us, ",", ""))
    )


def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shop pages written from the parts: sales, stock tables, status boxes and dates vary."""
    key, size = F.col("p_partkey"), F.col("p_size")
    amount = F.concat(
        F.lit('<span class="woocommerce-Price-amount amount"><bdi>'),
        price_text(F.col("p_retailprice"), key % 4),
        F.lit("</bdi></span>"),
    )
    original = F.concat(
        F.lit('<del><span class="amount">'),
        price_text(F.col("p_retailprice") + 100, key % 4),
        F.lit("</span></del>"),
    )
    price = (
        F.when(size % 9 == 0, F.lit('<p class="price">Consultar</p>'))
        .when(
            size % 2 == 0,
            F.concat(F.lit('<p class="price">'), original, F.lit(" <ins>"), amount, F.lit("</ins></p>")),
        )
        .otherwise(F.concat(F.lit('<p class="price">'), amount, F.lit("</p>")))
    )
    boxes = F.concat(
        F.lit('<div class="store-item"><span class="store-name"> Alajuela </span><span class="status '),
        F.when(size % 3 == 0, "status-out").when(size % 3 == 1, "status-limited").otherwise("status-available"),
        F.lit('"><span class="status-text">Quedan '),
        size,
        F.lit('</span></span></div><div class="store-item"><span class="store-name">Cartago</span><span class="status status-out">'),
        F.lit('<span class="status-text">Agotado</span></span></div>'),
    )
    rows = F.concat(
        F.lit('<table class="wc-stock-locations"><tr><td>Heredia<td>'),
        size,
        F.lit(" en stock<tr><td>Central<td>ninguno<tr><td>Liberia<td>3 en stock</table>"),
    )
    items = F.concat(
        F.lit('<ul class="stock-locations"><li>Bodega: '), size % 2, F.lit(" unidades<li>sin datos<li>Tienda: 0 unidades</ul>")
    )
    stock = (
        F.when(key % 4 == 0, boxes)
        .when(key % 4 == 1, rows)
        .when(key % 4 == 2, items)
        .otherwise(F.when(size % 2 == 0, '<p class="stock in-stock">Hay</p>').otherwise('<p class="stock out-of-stock">No hay</p>'))
    )
    day = F.date_format(F.date_add(F.to_date(F.lit("2020-01-01")), size), "yyyy-MM-dd")
    dated = (
        F.when(key % 5 == 0, F.concat(F.lit('<meta property="article:published_time" content="'), day, F.lit('T10:30:00+00:00">')))
        .when(
            key % 5 == 1,
            F.concat(
                F.lit('<script type="application/ld+json">{broken</script><script type="application/ld+json">[{"@type":"Thing"},{"datePublished":"'),
                day,
                F.lit('"}]</script>'),
            ),
        )
        .when(key % 5 == 2, F.concat(F.lit('<meta itemprop="datePublished" content="'), day, F.lit('">')))
        .when(key % 5 == 3, F.concat(F.lit('<time class="entry-date" datetime="'), day, F.lit('">x</time>')))
        .otherwise(F.lit(""))
    )
    challenge = F.lit('<html><body>Just a moment<script src="https://challenges.cloudflare.com/x.js"></script></body></html>')
    page = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"),
        F.col("p_name"),
        F.lit("</title>"),
        dated,
        F.lit('</head><body class="single-product theme-x"><nav><ul><li><a href="/">Inicio</a></ul></nav>'),
        F.lit('<div class="product"><div class="woocommerce-product-gallery__image"><img '),
        F.when(size % 2 == 0, "src").otherwise('src="" data-src'),
        F.lit('="https://shop.example/img/'),
        key,
        F.lit('.jpg"></div><div class="summary entry-summary"><h1 class="product_title entry-title"> '),
        F.col("p_name"),
        F.lit(" </h1>"),
        F.when(size % 2 == 0, F.concat(F.lit('<span class="onsale">-'), size, F.lit("%</span>"))).otherwise(""),
        price,
        F.lit('<div class="woocommerce-product-details__short-description"><p>Tipo '),
        F.col("p_type"),
        F.lit('<p>fin</div><span class="sku">'),
        F.col("p_brand"),
        F.lit('</span><span class="posted_in">En: <a>'),
        F.col("p_type"),
        F.lit("</a>, <a>otros</a></span>"),
        stock,
        F.lit('</div></div><section class="related"><p class="price"><span class="amount">$ 1.00</span></p></section></body></html>'),
    )
    plain = F.concat(F.lit("<html><body><h1>"), F.col("p_name"), F.lit("</h1></body></html>"))
    kind = key % 20
    # narrow rows are spread before the expensive steps that follow; pages at rest have many splits
    spread = table(spark, sf_dir, "part").repartition(spark.sparkContext.defaultParallelism)
    return spread.select(
        product_url().alias("url"),
        F.when(kind == 17, challenge).when(kind == 18, plain).otherwise(page).alias("html"),
        F.when(kind == 19, 404).otherwise(200).alias("status_code"),
        instant(NOW).alias("fetched_at"),
        F.lit(0).alias("attempt"),
    )


def page_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as fetch attempts: the line number counts the attempts of an order."""
    kept = F.struct("l_shipdate", "l_quantity", "l_returnflag", "l_linestatus", "l_tax", "l_extendedprice", "l_partkey", "l_suppkey")
    row = F.col("row")
    gone = row["l_tax"] >= 0.07
    challenge = ~gone & (row["l_returnflag"] == "R")
    product = ~gone & ~challenge & (row["l_linestatus"] == "O")
    price = F.when(product & (row["l_quantity"] >= 25), row["l_extendedprice"])
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min(kept).alias("row"))
        .select(
            F.concat(F.lit(SHOP), F.col("l_orderkey"), F.lit("/")).alias("url"),
            (F.col("l_linenumber") - 1).alias("attempt"),
            row["l_shipdate"].alias("observed_at"),
            F.when(gone, 404).otherwise(200).alias("status_code"),
            challenge.alias("is_challenge"),
            product.alias("is_product"),
            price.alias("price"),
        )
    )


def crawl_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fetch attempts as ten runs of a URL: orders share a URL by tens, each order is a run."""
    order = F.regexp_extract("url", "([0-9]+)/$", 1).cast("long")
    since = F.make_dt_interval(F.lit(0), F.col("_order") % 10, F.col("attempt"))
    rows = page_observations(spark, sf_dir).withColumn("_order", order)
    return align_schema(
        rows.withColumns(
            {
                "url": F.concat(F.lit(f"{SHOP}crawl-"), F.floor(F.col("_order") / 10), F.lit("/")),
                "run_id": F.concat(F.lit("run-"), F.col("_order") % 10),
                "observed_at": instant("1999-01-01 00:00:00") + since,
                "currency": F.when(F.col("price").isNotNull(), F.lit("CRC")),
            }
        ),
        OBSERVATIONS,
    )
