"""Registered queries on the column functions, over texts that are written from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions.dates import json_ld_date, normalise_date, published_drift, short_date
from shelfline.functions.prices import (
    first_integer,
    format_thousands,
    parse_currency,
    parse_percent,
    parse_price,
    round_half_up,
)
from shelfline.functions.stock import (
    availability,
    json_in_stock,
    location_and_quantity,
    stock_from_json,
    stock_to_json,
    store_status_quantity,
)
from shelfline.functions.text import (
    field_score,
    squash,
    token_score,
    tokenize,
    trim_or_null,
    valid_email,
)
from shelfline.plans import adapters as a
from shelfline.plans.queries_history import query_table

QUERIES, ORACLES, query = query_table()

_SPACES = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


@query(
    "parse_prices",
    """SELECT l_orderkey % 4 AS style, CASE WHEN l_orderkey % 4 = 2 THEN floor(l_extendedprice) ELSE l_extendedprice END AS price,
    ['USD', 'EUR', 'CRC', NULL][l_orderkey % 4 + 1] AS currency, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def parse_prices(spark: SparkSession, d: str) -> DataFrame:
    """Line item prices written in four styles and parsed back."""
    style = F.col("l_orderkey") % 4
    text = a.price_text(F.col("l_extendedprice"), style)
    rows = a.table(spark, d, "lineitem").select(style.alias("style"), text.alias("raw"))
    return (
        rows.select("style", parse_price(F.col("raw")).alias("price"), parse_currency(F.col("raw")).alias("currency"))
        .groupBy("style", "price", "currency")
        .agg(F.count("*").alias("n"))
    )


@query(
    "parse_percent",
    """SELECT CAST(round(l_discount * 100) AS INTEGER) AS discount,
    CASE WHEN l_linenumber < 7 THEN CAST(round(l_discount * 100) AS INTEGER) END AS pct, l_linenumber, count(*) AS n
    FROM lineitem GROUP BY ALL""",
)
def percent(spark: SparkSession, d: str) -> DataFrame:
    discount = F.round(F.col("l_discount") * 100).cast("int")
    text = F.when(F.col("l_linenumber") < 7, F.concat(F.lit("Descuento -"), discount, F.lit(" % OFF"))).otherwise("OFERTA")
    return (
        a.table(spark, d, "lineitem")
        .select(discount.alias("discount"), "l_linenumber", parse_percent(text).alias("pct"))
        .groupBy("discount", "l_linenumber", "pct")
        .agg(F.count("*").alias("n"))
    )


@query(
    "store_status_qty",
    """SELECT style, k, CASE style WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN k WHEN 3 THEN 1 WHEN 4 THEN k END AS quantity,
    count(*) AS n FROM (SELECT event_id % 6 AS style, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY ALL""",
)
def store_status_qty(spark: SparkSession, d: str) -> DataFrame:
    style, k = F.col("style"), F.col("k")
    css = (
        F.when(style == 0, "status status-out")
        .when(style == 1, "status status-available")
        .when(style.isin(2, 3), "status status-limited")
        .otherwise("status")
    )
    text = F.when(style.isin(2, 4), F.concat(F.lit("Quedan "), k, F.lit(" de 99"))).otherwise("Consultar")
    rows = a.table(spark, d, "events").select(
        (F.col("event_id") % 6).alias("style"), F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    return rows.withColumn("quantity", store_status_quantity(css, text)).groupBy("style", "k", "quantity").agg(F.count("*").alias("n"))


@query(
    "stock_text",
    """SELECT p_brand, CASE WHEN p_size % 5 > 0 THEN p_brand END AS location, CASE WHEN p_size % 5 > 0 THEN p_size END AS quantity,
    p_size AS first_number, count(*) AS n FROM part GROUP BY ALL""",
)
def stock_text(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("p_size") % 5 > 0, F.concat("p_brand", F.lit(" : "), "p_size", F.lit(" en stock"))).otherwise(
        F.concat(F.lit("quedan "), "p_size", F.lit(" unidades"))
    )
    parsed = location_and_quantity(text)
    counted = F.concat(F.lit("quedan "), "p_size", F.lit(" de 3"))
    return (
        a.table(spark, d, "part")
        .select("p_brand", parsed["location"].alias("location"), parsed["quantity"].alias("quantity"), first_integer(counted).alias("first_number"))
        .groupBy("p_brand", "location", "quantity", "first_number")
        .agg(F.count("*").alias("n"))
    )


STOCK_KINDS = 7


@query(
    "in_stock",
    f"""SELECT kind, q, CASE WHEN kind IN (0, 6) THEN q > 0 WHEN kind = 1 THEN true ELSE false END AS in_stock, count(*) AS n
    FROM (SELECT l_orderkey % {STOCK_KINDS} AS kind, l_linenumber % 3 AS q FROM lineitem) GROUP BY ALL""",
)
def in_stock(spark: SparkSession, d: str) -> DataFrame:
    """Stock JSON of every shape: arrays, objects, malformed text, nothing."""
    kind, q = F.col("kind"), F.col("q")
    row = F.concat(F.lit('{"location":"a","quantity":'), q, F.lit("}"))
    text = (
        F.when(kind == 0, F.concat(F.lit("["), row, F.lit("]")))
        .when(kind == 1, F.concat(F.lit('[{"location":"b","quantity":0},'), row, F.lit(',{"location":"c","quantity":2}]')))
        .when(kind == 2, '{"quantity":2}')
        .when(kind == 3, "{bad")
        .when(kind == 4, "[]")
        .when(kind == 6, F.concat(F.lit(" ["), row, F.lit("]")))
    )
    rows = a.table(spark, d, "lineitem").select((F.col("l_orderkey") % STOCK_KINDS).alias("kind"), (F.col("l_linenumber") % 3).alias("q"))
    return rows.withColumn("in_stock", json_in_stock(text)).groupBy("kind", "q", "in_stock").agg(F.count("*").alias("n"))


@query(
    "stock_json",
    """SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN '[{"location":"main","quantity":' || p_size % 4 || '}]' END AS stored,
    CASE WHEN p_size % 7 > 0 THEN p_size % 4 END AS quantity FROM part""",
)
def stock_json(spark: SparkSession, d: str) -> DataFrame:
    rows = a.parts(spark, d).select((F.col("id") - 1).alias("p_partkey"), stock_to_json(F.coalesce("stock_locations", F.array())).alias("stored"))
    return rows.withColumn("quantity", F.get(stock_from_json(F.col("stored")), F.lit(0))["quantity"])


@query(
    "availability",
    """SELECT oos, ins, cart, stocked, CASE WHEN stocked IS NULL THEN NOT oos AND (ins OR cart) ELSE stocked END AS available, count(*) AS n
    FROM (SELECT o_orderkey % 2 = 1 AS oos, o_orderkey % 3 = 1 AS ins, o_orderkey % 5 = 1 AS cart,
                 CASE WHEN o_orderkey % 7 > 3 THEN o_orderkey % 7 > 5 END AS stocked FROM orders) GROUP BY ALL""",
)
def page_availability(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = a.table(spark, d, "orders").select(
        (key % 2 == 1).alias("oos"),
        (key % 3 == 1).alias("ins"),
        (key % 5 == 1).alias("cart"),
        F.when(key % 7 > 3, key % 7 > 5).alias("stocked"),
    )
    store = F.array(F.struct(F.lit("a").alias("location"), F.lit(0).alias("quantity")), F.struct(F.lit("b").alias("location"), F.col("stocked").cast("int").alias("quantity")))
    stock = F.when(F.col("stocked").isNotNull(), store).otherwise(F.slice(store, 1, 0))
    return rows.withColumn("available", availability(stock, F.col("oos"), F.col("ins"), F.col("cart"))).groupBy(
        "oos", "ins", "cart", "stocked", "available"
    ).agg(F.count("*").alias("n"))


@query(
    "normalise_dates",
    """SELECT o_orderkey % 8 AS kind, CASE WHEN o_orderkey % 8 < 4 THEN CAST(o_orderdate AS DATE) END AS day, count(*) AS n
    FROM orders GROUP BY ALL""",
)
def normalise_dates(spark: SparkSession, d: str) -> DataFrame:
    """Order dates in good and bad spellings."""
    kind, day = F.col("o_orderkey") % 8, F.date_format("o_orderdate", "yyyy-MM-dd")
    text = (
        F.when(kind == 0, day)
        .when(kind == 1, F.concat(day, F.lit("T10:30:00+00:00")))
        .when(kind == 2, F.concat(day, F.lit("T23:59:59.123Z")))
        .when(kind == 3, F.concat(day, F.lit(" 08:15")))
        .when(kind == 4, F.concat(F.left(day, F.lit(5)), F.lit("99-99")))
        .when(kind == 5, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(kind == 6, F.concat(day, F.lit("Tnoon")))
    )
    return a.table(spark, d, "orders").select(kind.alias("kind"), normalise_date(text).alias("day")).groupBy("kind", "day").agg(F.count("*").alias("n"))


@query(
    "json_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 5 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""",
)
def json_dates(spark: SparkSession, d: str) -> DataFrame:
    """JSON-LD blocks: objects, arrays, malformed ones in front, no date, unusable date."""
    kind, day = F.col("o_orderkey") % 7, F.date_format("o_orderdate", "yyyy-MM-dd")

    def block(before: str, after: str):
        return F.concat(F.lit(before), day, F.lit(after))

    published = block('{"datePublished":"', '"}')
    blocks = (
        F.when(kind == 0, F.array(published))
        .when(kind == 1, F.array(block('[{"name":"x"},{"datePublished":"","dateCreated":"', 'T01:02:03Z"}]')))
        .when(kind == 2, F.array(F.lit("{broken"), published))
        .when(kind == 3, F.array(F.lit('{"datePublished":"soon"}'), block('{"dateCreated":"', '"}')))
        .when(kind == 4, F.array(F.lit('[1, {"dateCreated":null}]'), published))
        .when(kind == 5, F.array(block('[{"datePublished":"soon"},{"datePublished":"', '"}]')))
        .otherwise(F.array(F.lit("{}")))
    )
    return a.table(spark, d, "orders").select("o_orderkey", json_ld_date(blocks).alias("day"))


@query(
    "published_drift",
    """SELECT p_size, CASE WHEN p_size % 3 = 0 THEN '1999-04-01' WHEN p_size % 2 = 0 THEN '1998-03-01' END AS latest,
    p_size % 3 = 0 AS drifted, count(*) AS n FROM part GROUP BY ALL""",
)
def drift(spark: SparkSession, d: str) -> DataFrame:
    size = a.table(spark, d, "part").select("p_partkey", "p_size")
    rows = a.parts(spark, d).join(size, F.col("id") == F.col("p_partkey") + 1)
    return rows.select(
        "p_size",
        short_date(F.col("published_latest")).alias("latest"),
        published_drift(F.col("published_first"), F.col("published_latest")).alias("drifted"),
    ).groupBy("p_size", "latest", "drifted").agg(F.count("*").alias("n"))


@query(
    "token_counts",
    rf"""SELECT token, count(*) AS n FROM (SELECT unnest(string_split_regex(strip_accents(lower(text)), '{_SPACES}\-/.]+')) AS token
    FROM documents) WHERE token <> '' GROUP BY 1""",
)
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Normalised tokens of all documents, counted."""
    tokens = a.table(spark, d, "documents").select(F.explode(tokenize(F.col("text"))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


@query(
    "normalize_tokens",
    r"""SELECT p_partkey, list_filter(string_split_regex(strip_accents(lower(p_name || '-' || p_brand || '/Ñandú.' || p_type)), '[\s\-/.]+'),
    lambda t: t <> '') AS tokens FROM part""",
)
def normalize_tokens(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("p_name", F.lit("-"), "p_brand", F.lit("/Ñandú."), "p_type")
    return a.table(spark, d, "part").select("p_partkey", tokenize(text).alias("tokens"))


@query(
    "token_scores",
    """WITH t AS (SELECT DISTINCT s_name AS q, c_name AS t FROM supplier JOIN customer ON s_suppkey = c_custkey // 10)
    SELECT q, t, CASE WHEN contains(t, q) THEN 2 WHEN length(q) >= 5 AND abs(length(q) - length(t)) <= 1 AND levenshtein(q, t) <= 1
    THEN 1 ELSE 0 END AS score FROM (SELECT 'id' || regexp_replace(q, '^.*#', '') AS q, 'id' || regexp_replace(t, '^.*#', '') AS t FROM t)""",
)
def token_scores(spark: SparkSession, d: str) -> DataFrame:
    """Whole supplier numbers scored against whole customer numbers of the same tens."""
    supplier, customer = a.table(spark, d, "supplier"), a.table(spark, d, "customer")
    pairs = supplier.join(customer, F.col("s_suppkey") == F.floor(F.col("c_custkey") / 10))
    rows = pairs.select(
        F.concat(F.lit("id"), F.regexp_replace("s_name", "^.*#", "")).alias("q"),
        F.concat(F.lit("id"), F.regexp_replace("c_name", "^.*#", "")).alias("t"),
    )
    return rows.withColumn("score", token_score(F.col("q"), F.col("t")))


@query(
    "field_scores",
    r"""SELECT p_partkey, max(CASE WHEN contains(t, 'widge') THEN 2 WHEN abs(length(t) - 5) <= 1 AND levenshtein(t, 'widge') <= 1 THEN 1 ELSE 0 END) AS score
    FROM (SELECT p_partkey, unnest(string_split_regex(lower(p_name), '[\s\-/.]+')) AS t FROM part) GROUP BY 1""",
)
def field_scores(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "part").select(
        "p_partkey", field_score(F.lit("widge"), tokenize(F.col("p_name"))).alias("score")
    )


@query(
    "trimmed_texts",
    r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS squashed,
    left(trim(regexp_replace(text, '\s+', ' ', 'g')), 300) AS excerpt, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS lang
    FROM documents""",
)
def trimmed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whole squashed texts, excerpts as kept in page diagnoses, and blank texts turned into NULL."""
    padded = F.when(F.col("lang") == "en", F.lit("  \n")).otherwise(F.concat(F.lit("  "), "lang", F.lit("\t")))
    return a.table(spark, d, "documents").select(
        "doc_id",
        squash(F.col("text")).alias("squashed"),
        squash(F.col("text"), 300).alias("excerpt"),
        trim_or_null(padded).alias("lang"),
    )


@query(
    "valid_emails",
    r"""SELECT kind, kind IN (0, 5) AS valid, count(*) AS n FROM (SELECT c_custkey % 6 AS kind FROM customer) GROUP BY ALL""",
)
def valid_emails(spark: SparkSession, d: str) -> DataFrame:
    key, kind = F.col("c_custkey"), F.col("c_custkey") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("u"), key, F.lit("@example.com")))
        .when(kind == 1, F.concat(F.lit("u"), key, F.lit("@example")))
        .when(kind == 2, F.concat(F.lit("u "), key, F.lit("@example.com")))
        .when(kind == 3, F.concat(F.lit("u@"), key, F.lit("@example.com")))
        .when(kind == 4, F.lit("@example.com"))
        .otherwise(F.concat(F.lit("ú.x+"), key, F.lit("@a.b.c")))
    )
    return a.table(spark, d, "customer").select(kind.alias("kind"), valid_email(text).alias("valid")).groupBy("kind", "valid").agg(F.count("*").alias("n"))


@query(
    "rounded_changes",
    """SELECT CAST(floor((l_quantity - 25) / 2 + 0.5) AS BIGINT) AS half_up, l_quantity, count(*) AS n,
    format('{:,}', CAST(l_quantity * 1000 AS BIGINT)) AS shown FROM lineitem GROUP BY ALL""",
)
def rounded_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = a.table(spark, d, "lineitem").select(
        round_half_up((F.col("l_quantity") - 25) / 2).alias("half_up"),
        "l_quantity",
        format_thousands(F.col("l_quantity") * 1000).alias("shown"),
    )
    return rows.groupBy("half_up", "l_quantity", "shown").agg(F.count("*").alias("n"))
