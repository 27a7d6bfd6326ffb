"""Registered queries on the catalogue: prices, filters, sorts, search, charts, watch lists, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.operators import alerts, catalog, pages, quality, search, series
from shelfline.operators.intervals import closed_rows, open_rows
from shelfline.plans import adapters as a
from shelfline.plans import jobs
from shelfline.plans.oracle_parts import (
    BASE_ORDER,
    CATALOG,
    CHECKED,
    CURRENT,
    HISTORY,
    NOW_SQL,
    PARTS,
)
from shelfline.plans.queries_history import query_table
from shelfline.session import pinned
from shelfline.sources import watchlists

QUERIES, ORACLES, query = query_table()


@query(
    "current_price_left",
    f"""WITH {HISTORY}, {PARTS}, {CURRENT}
    SELECT id, name, price, original_price FROM parts LEFT JOIN cur ON product_id = id WHERE is_active""",
)
def current_price_left(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.active_with_price(a.parts(spark, d), a.history(spark, d))
    return rows.select("id", "name", "price", "original_price")


@query(
    "current_price_inner",
    f"WITH {CATALOG} SELECT id, name, is_active, price, original_price, prev_price FROM catalog",
)
def current_price_inner(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.current_and_previous(a.parts(spark, d), a.history(spark, d))
    return rows.select("id", "name", "is_active", "price", "original_price", "prev_price")


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_derived(catalog.current_and_previous(a.parts(spark, d), a.history(spark, d)))


DERIVED = (
    "id, price, prev_price, change_pct, badge_direction, badge_pct, discount_pct, in_stock, status, published_drift"
)


@query("price_change", f"WITH {CATALOG} SELECT {DERIVED} FROM catalog")
def price_change(spark: SparkSession, d: str) -> DataFrame:
    return _catalog(spark, d).select(
        "id",
        "price",
        "prev_price",
        "change_pct",
        F.col("change_badge.direction").alias("badge_direction"),
        F.col("change_badge.pct").alias("badge_pct"),
        "discount_pct",
        "in_stock",
        "status",
        "published_drift",
    )


@query("open_and_closed_counts", f"""WITH {HISTORY}
    SELECT count(*) FILTER (WHERE end_ts IS NULL) AS open_rows, count(end_ts) AS closed_rows FROM hist""")
def open_and_closed(spark: SparkSession, d: str) -> DataFrame:
    rows = a.history(spark, d)
    marked = open_rows(rows).select(F.lit(1).alias("o")).unionByName(closed_rows(rows).select(F.lit(0).alias("o")))
    return marked.agg(F.count_if(F.col("o") == 1).alias("open_rows"), F.count_if(F.col("o") == 0).alias("closed_rows"))


def ranked(page: DataFrame, order: list, keep: list[str]) -> DataFrame:
    """A page with its positions; the page is already limited, so one task can number it."""
    rank = F.row_number().over(Window.orderBy(*order))
    return page.withColumn("rank", rank).select("rank", *keep)


SHOWN = "(is_active AND in_stock)"


def _page_sql(where: str, order: str, columns: str) -> str:
    return f"""WITH {CATALOG} SELECT row_number() OVER (ORDER BY {order}) AS rank, {columns}
    FROM catalog WHERE {where} QUALIFY rank <= 60"""


PAGE = ["id", "name", "price", "prev_price", "change_pct"]


@query("catalog_page", _page_sql(SHOWN, f"change_pct ASC, {BASE_ORDER}", ", ".join(PAGE)))
def catalog_page(spark: SparkSession, d: str) -> DataFrame:
    """Biggest price drops first, default filters, first page."""
    rows, order = jobs.catalog_view(a.parts(spark, d), a.history(spark, d), sort="discount-desc")
    return ranked(catalog.page(rows, order), order, PAGE)


@query(
    "price_changes_ranked",
    _page_sql(f"{SHOWN} OR NOT is_active", f"change_pct DESC, {BASE_ORDER}", ", ".join(PAGE)),
)
def price_changes_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Biggest rises first, inactive products included."""
    rows, order = jobs.catalog_view(
        a.parts(spark, d), a.history(spark, d), sort="increase-desc", include_inactive=True
    )
    return ranked(catalog.page(rows, order), order, PAGE)


SORTS = {
    "name-asc": "coalesce(name, '') ASC",
    "name-desc": "coalesce(name, '') DESC",
    "price-asc": "price ASC NULLS LAST",
    "price-desc": "price DESC NULLS LAST",
    "discount-desc": "change_pct ASC",
    "increase-desc": "change_pct DESC",
    "default": None,
}


@query(
    "catalog_sorts",
    f"WITH {CATALOG} "
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS sort, row_number() OVER (ORDER BY {f'{o}, ' if o else ''}{BASE_ORDER}) AS rank, id
        FROM catalog QUALIFY rank <= 60"""
        for name, o in SORTS.items()
    ),
)
def catalog_sorts(spark: SparkSession, d: str) -> DataFrame:
    """The first page in every sort order, without filters."""
    rows = _catalog(spark, d).select("id", "name", "is_active", "price", "prev_price")
    rows = pinned(rows)
    pages = None
    for name in SORTS:
        order = catalog.sort_order(name)
        shown = ranked(catalog.page(rows, order), order, ["id"]).withColumn("sort", F.lit(name))
        pages = shown if pages is None else pages.unionByName(shown)
    return pages


@query(
    "catalog_second_page",
    f"""WITH {CATALOG} SELECT row_number() OVER (ORDER BY {BASE_ORDER}) AS position, id, name
    FROM catalog QUALIFY position BETWEEN 61 AND 120""",
)
def catalog_second_page(spark: SparkSession, d: str) -> DataFrame:
    order = catalog.base_order()
    page = catalog.page(_catalog(spark, d), order, number=2)
    position = F.row_number().over(Window.orderBy(*order)) + 60
    return page.withColumn("position", position).select("position", "id", "name")


@query(
    "catalog_deep_page",
    f"""WITH {CATALOG}, ranks AS (SELECT row_number() OVER (ORDER BY {BASE_ORDER}) AS position, count(*) OVER () AS n, id, name FROM catalog)
    SELECT position, id, name FROM ranks WHERE position - 1 >= 60 * (n // 120) AND position - 1 < 60 * (n // 120) + 120""",
)
def catalog_deep_page(spark: SparkSession, d: str) -> DataFrame:
    """The page in the middle of the catalogue, found by its position, and the one after it, by its last row."""
    rows, keys = _catalog(spark, d), pages.base_keys()
    index = pages.position_index(rows, keys)
    count = catalog.total(rows).first()[0]
    middle = pages.page_at(rows, keys, index, count // 120 + 1)
    shown = middle.collect()  # a page, as a reader of it has
    both = middle.unionByName(pages.page_after(rows, keys, shown[-1])) if shown else middle
    position = F.row_number().over(Window.orderBy(*pages.orders(keys))) + count // 120 * 60
    return both.withColumn("position", position).select("position", "id", "name")


@query("catalog_total", f"WITH {CATALOG} SELECT count(*) AS total FROM catalog WHERE {SHOWN}")
def catalog_total(spark: SparkSession, d: str) -> DataFrame:
    return catalog.total(jobs.catalog_view(a.parts(spark, d), a.history(spark, d))[0])


@query(
    "catalog_filters",
    " UNION ALL ".join(
        f"(WITH {CATALOG} SELECT '{label}' AS filters, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids "
        f"FROM catalog WHERE {where})"
        for label, where in [
            ("inactive+stock", f"{SHOWN} OR NOT is_active"),
            ("inactive+any", "true"),
            ("active+stock", SHOWN),
            ("active+any", "is_active"),
            ("favorites", "is_active AND id IN (SELECT l_partkey + 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 7)"),
        ]
    ),
)
def catalog_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = pinned(_catalog(spark, d).select("id", "is_active", "in_stock"))
    favorites = _watchlist(spark, d).filter("user_id = '7'")
    parts = [
        ("inactive+stock", catalog.filter_catalog(rows, include_inactive=True)),
        ("inactive+any", catalog.filter_catalog(rows, True, False)),
        ("active+stock", catalog.filter_catalog(rows)),
        ("active+any", catalog.filter_catalog(rows, only_in_stock=False)),
        ("favorites", catalog.filter_catalog(rows, only_in_stock=False, favorites=favorites)),
    ]
    out = None
    for label, kept in parts:
        one = kept.agg(F.count("*").alias("n"), F.sum("id").alias("ids")).withColumn("filters", F.lit(label))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "history_of_product",
    f"""WITH {HISTORY}, {PARTS} SELECT product_id, price, start_ts, end_ts FROM hist
    JOIN parts ON id = product_id WHERE url = (SELECT max(url) FROM parts)""",
)
def history_of_product(spark: SparkSession, d: str) -> DataFrame:
    products = a.parts(spark, d)
    url = products.agg(F.max("url")).first()[0]
    return catalog.history_of(products, a.history(spark, d), url).select(
        "product_id", "price", "start_ts", "end_ts"
    )


@query(
    "stale_topk",
    f"""WITH {CHECKED} SELECT row_number() OVER (ORDER BY last_checked_at, url) AS rank, url, last_checked_at
    FROM checked WHERE is_active QUALIFY rank <= 500""",
)
def stale_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.stale_first(a.checked_parts(spark, d), 500)
    return ranked(rows, [F.col("last_checked_at"), F.col("url")], ["url", "last_checked_at"])


@query("freshness", f"WITH {CHECKED} SELECT max(last_checked_at) AS last_updated FROM checked")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    return quality.last_updated(a.checked_parts(spark, d))


@query("active_count", f"WITH {PARTS} SELECT count(*) FILTER (WHERE is_active) AS active FROM parts")
def active_count(spark: SparkSession, d: str) -> DataFrame:
    return quality.active_count(a.parts(spark, d))


@query(
    "unpriced_products",
    f"""WITH {HISTORY}, {PARTS} SELECT id FROM parts WHERE is_active AND NOT EXISTS
    (SELECT 1 FROM hist WHERE product_id = id AND end_ts IS NULL)""",
)
def unpriced_products(spark: SparkSession, d: str) -> DataFrame:
    return quality.unpriced_products(a.parts(spark, d), a.history(spark, d)).select("id")


def _integrity_sql(ctes: str, products: str, priced: str) -> str:
    return f"""WITH {ctes},
    t AS (SELECT count(*) AS total, count(*) FILTER (WHERE NOT EXISTS
             (SELECT 1 FROM {priced} AS o WHERE o.product_id = p.id)) AS unpriced,
             count(*) FILTER (WHERE name IS NULL) AS unnamed FROM {products} AS p WHERE is_active),
    n AS (SELECT name, count(*) AS n FROM {products} WHERE is_active AND name IS NOT NULL GROUP BY 1
          ORDER BY 2 DESC, 1 DESC LIMIT 1),
    c AS (SELECT 'no_price' AS "check", 'CRITICAL' AS severity, unpriced AS numerator, total AS denominator,
                 CAST(NULL AS VARCHAR) AS detail FROM t
          UNION ALL SELECT 'no_name', 'CRITICAL', unnamed, total, NULL FROM t
          UNION ALL SELECT 'dominant_name', 'WARNING', coalesce((SELECT n FROM n), 0), total, (SELECT name FROM n) FROM t)
    SELECT *, numerator / denominator AS ratio, coalesce(numerator / denominator >= 0.8, false) AS failed FROM c"""


@query(
    "integrity_report",
    _integrity_sql(f"{HISTORY}, {PARTS}, open_h AS (SELECT product_id FROM hist WHERE end_ts IS NULL)", "parts", "open_h"),
)
def integrity_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.integrity_report(a.parts(spark, d), a.history(spark, d))


@query(
    "document_integrity",
    _integrity_sql(
        "docs AS (SELECT doc_id AS id, lang AS name, true AS is_active FROM documents), "
        "lab AS (SELECT doc_id AS product_id FROM labels)",
        "docs",
        "lab",
    ),
)
def document_integrity(spark: SparkSession, d: str) -> DataFrame:
    """The same checks on documents: a label is the price, the language the name."""
    docs = a.table(spark, d, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("name"),
        F.lit(True).alias("is_active"),
    )
    labels = a.table(spark, d, "labels").select(
        F.col("doc_id").alias("product_id"), F.lit(None).cast("timestamp").alias("end_ts")
    )
    return quality.integrity_report(docs, labels)


# Searches

FIELDS = {"name": "p_name", "sku": "p_brand", "category": "p_type"}
WEIGHTS = "(VALUES ('p_name', 10), ('p_brand', 8), ('p_type', 5)) AS w(field, weight)"
# name of the query, text, and related words used for it
PHRASES = ["red widget", "widgat", "SMÁLL rïng", "brand#17", "blue promo gear", "keyboard", "standard bolt x", "anvi-plat"]
RELATED = {"keyboard": ["anvil", "gizmos"], "ring": ["plate"]}
_SPLIT = r"[\s\-/.]+"

FIELD_TOKENS = rf"""tok AS (
  SELECT DISTINCT p_partkey, weight, token FROM (
    SELECT p_partkey, weight, unnest(string_split_regex(strip_accents(lower(CASE field WHEN 'p_name' THEN p_name
           WHEN 'p_brand' THEN p_brand ELSE p_type END)), '{_SPLIT}')) AS token FROM part, {WEIGHTS})
  WHERE token <> '')"""


def _scores_sql(wanted: str) -> str:
    """Scores of every (query, part) from ``wanted(query_id, pos, needed, cand)``."""
    return f"""{FIELD_TOKENS}, wanted AS ({wanted}),
    voc AS (SELECT DISTINCT token FROM tok), cands AS (SELECT DISTINCT cand FROM wanted),
    m AS (SELECT cand, token, CASE WHEN contains(token, cand) THEN 2
            WHEN length(cand) >= 5 AND abs(length(cand) - length(token)) <= 1 AND levenshtein(cand, token) <= 1
            THEN 1 ELSE 0 END AS s FROM cands, voc),
    hits AS (SELECT query_id, pos, needed, token, max(s) AS s FROM wanted JOIN m USING (cand) WHERE s > 0 GROUP BY ALL),
    best AS (SELECT query_id, needed, pos, p_partkey, max(s * weight) AS b FROM hits JOIN tok USING (token) GROUP BY ALL),
    scores AS (SELECT query_id, p_partkey, CAST(sum(b) AS INTEGER) AS score FROM best
               GROUP BY query_id, p_partkey, needed HAVING count(*) = needed)"""


def _phrases_sql() -> str:
    from shelfline.functions.text import literal_tokens

    rows = []
    for phrase in PHRASES:
        tokens = literal_tokens(phrase)
        for pos, token in enumerate(tokens):
            for cand in search.expand(token, RELATED):
                rows.append(f"('{phrase}', {pos}, {len(tokens)}, '{cand}')")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS v(query_id, pos, needed, cand)"


@query("search_scores", f"WITH {_scores_sql(_phrases_sql())} SELECT query_id AS query, p_partkey, score FROM scores")
def search_scores(spark: SparkSession, d: str) -> DataFrame:
    """Several single searches over all parts, each one a narrow pass."""
    found = None
    for phrase in PHRASES:
        hits = search.search(a.table(spark, d, "part"), phrase, FIELDS, synonyms=RELATED).select(
            F.lit(phrase).alias("query"), "p_partkey", "score"
        )
        found = hits if found is None else found.unionByName(hits)
    return found


@query(
    "search_ranked",
    f"""WITH {_scores_sql("SELECT 'q' AS query_id, * FROM (VALUES (0, 2, 'smal'), (1, 2, 'ring')) AS v(pos, needed, cand)")}
    SELECT row_number() OVER (ORDER BY score DESC, p_name, p_partkey) AS rank, p_partkey, p_name, score
    FROM scores JOIN part USING (p_partkey) QUALIFY rank <= 60""",
)
def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    hits = search.search(a.table(spark, d, "part"), "smal ring", FIELDS)
    order = [*search.relevance_order(), F.col("p_name"), F.col("p_partkey")]
    return ranked(catalog.page(hits, order), order, ["p_partkey", "p_name", "score"])


@query(
    "search_many",
    f"""WITH {_scores_sql('''SELECT p_name AS query_id, pos, 2 AS needed, cand FROM (
        SELECT DISTINCT p_name FROM part), LATERAL (SELECT unnest([0, 1]) AS pos,
        unnest(string_split(p_name, ' ')) AS cand)''')}
    SELECT query_id, p_partkey, score FROM scores""",
)
def search_many(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct part name as a query over all parts."""
    parts = a.table(spark, d, "part")
    queries = parts.select(F.col("p_name").alias("query_id"), F.col("p_name").alias("query")).distinct()
    return search.search_many(parts, queries, "p_partkey", FIELDS)


@query(
    "search_customers",
    """WITH q AS (SELECT s_suppkey, 's' || regexp_replace(s_name, '^.*#', '') AS cand FROM supplier),
    v AS (SELECT c_custkey, 's' || regexp_replace(c_name, '^.*#', '') AS token FROM customer)
    SELECT s_suppkey AS query_id, c_custkey, CAST(10 * max(CASE WHEN contains(token, cand) THEN 2 ELSE 1 END) AS INTEGER) AS score
    FROM q JOIN v ON contains(token, cand) OR levenshtein(cand, token) <= 1 GROUP BY ALL""",
)
def search_customers(spark: SparkSession, d: str) -> DataFrame:
    """Whole supplier numbers looked up among whole customer numbers: near misses with a common head."""
    number = lambda name: F.concat(F.lit("s"), F.regexp_replace(name, "^.*#", ""))
    names = a.table(spark, d, "customer").select("c_custkey", number("c_name").alias("name"))
    queries = a.table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), number("s_name").alias("query"))
    return search.search_many(names, queries, "c_custkey", {"name": "name"})


@query(
    "catalog_search",
    f"""WITH {CATALOG},
    s AS (SELECT id, CASE WHEN contains(coalesce(name, ''), 'widget') OR contains(url, 'widget') THEN 1 END AS hit,
                 greatest(CASE WHEN contains(coalesce(name, ''), 'widget') THEN 20 ELSE 0 END,
                          CASE WHEN contains(url, 'widget') THEN 4 ELSE 0 END)
               + greatest(CASE WHEN contains(coalesce(name, ''), 'red') THEN 20 ELSE 0 END,
                          CASE WHEN contains(url, 'red') THEN 4 ELSE 0 END) AS score
          FROM catalog WHERE contains(url, 'widget') AND contains(url, 'red'))
    SELECT row_number() OVER (ORDER BY score DESC, {BASE_ORDER}) AS rank, id, name, CAST(score AS INTEGER) AS score
    FROM catalog JOIN s USING (id) WHERE {SHOWN} QUALIFY rank <= 60""",
)
def catalog_search(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue page for a search text: filters, relevance, first page."""
    rows, order = jobs.catalog_view(
        a.parts(spark, d), a.history(spark, d), query="red widget", sort="price-asc"
    )
    return ranked(catalog.page(rows, order), order, ["id", "name", "score"])


# Charts


def _points_sql(days: int, where: str = "true") -> str:
    return f"""WITH {HISTORY}, {PARTS},
    o AS (SELECT product_id, price, start_ts, greatest(start_ts, {NOW_SQL} - INTERVAL {days} DAY) AS s,
                 least(coalesce(end_ts, {NOW_SQL}), {NOW_SQL}) AS e FROM hist
          WHERE product_id > 0 AND (end_ts IS NULL OR end_ts >= {NOW_SQL} - INTERVAL {days} DAY)
            AND start_ts <= {NOW_SQL} AND price IS NOT NULL AND {where}),
    points AS (SELECT product_id, start_ts, 0 AS point, s AS point_ts, price FROM o
          UNION ALL SELECT product_id, start_ts, 1, e, price FROM o WHERE CAST(s AS DATE) <> CAST(e AS DATE))"""


@query("price_series", f"{_points_sql(365)} SELECT * FROM points")
def price_series(spark: SparkSession, d: str) -> DataFrame:
    return series.price_series(a.history(spark, d), 365, a.instant(a.NOW))


@query(
    "packed_series",
    f"""{_points_sql(30)} SELECT product_id, 0 AS part,
    list(strftime(point_ts, '%Y-%m-%d') ORDER BY start_ts, point) AS labels,
    list(price ORDER BY start_ts, point) AS prices FROM points GROUP BY 1""",
)
def packed_series(spark: SparkSession, d: str) -> DataFrame:
    return series.packed_series(series.price_series(a.history(spark, d), 30, a.instant(a.NOW)))


@query(
    "sparklines",
    _points_sql(7, "product_id IN (SELECT id FROM parts ORDER BY is_active DESC, name ASC NULLS FIRST, id LIMIT 60)")
    + " SELECT * FROM points",
)
def sparklines(spark: SparkSession, d: str) -> DataFrame:
    page = catalog.page(a.parts(spark, d), catalog.base_order())
    return series.sparklines(page, a.history(spark, d), a.instant(a.NOW))


# Watch lists: a customer watches the parts of the orders' line items


WATCH_SQL = f"""{PARTS},
watch AS (SELECT DISTINCT o_custkey AS user_id, l_partkey + 1 AS product_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
w AS (SELECT CAST(user_id AS VARCHAR) AS user_id, product_id, url, coalesce(name, '(Producto desconocido)') AS name,
             {NOW_SQL} AS added_at,
             CASE WHEN product_id % 4 > 0 THEN CAST(product_id % 4 * 20 AS DOUBLE) END AS price_at_addition,
             product_id % 2 = 0 AS notify_by_email,
             CASE product_id % 3 WHEN 0 THEN 'u' || user_id || '@example.com' WHEN 1 THEN 'no address' ELSE '' END AS notify_email
      FROM watch JOIN parts ON id = product_id)"""


def _watchlist(spark: SparkSession, d: str) -> DataFrame:
    orders = a.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = a.table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    pairs = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("user_id"), (F.col("l_partkey") + 1).alias("product_id")
    ).distinct()
    products = a.parts(spark, d).select(F.col("id").alias("product_id"), "url", "name")
    kind = F.col("product_id") % 3
    return pairs.join(products, "product_id").select(
        F.col("user_id").cast("string").alias("user_id"),
        "product_id",
        "url",
        alerts.shown_name().alias("name"),
        a.instant(a.NOW).alias("added_at"),
        F.when(F.col("product_id") % 4 > 0, F.col("product_id") % 4 * 20).cast("double").alias("price_at_addition"),
        (F.col("product_id") % 2 == 0).alias("notify_by_email"),
        F.when(kind == 0, F.concat(F.lit("u"), "user_id", F.lit("@example.com")))
        .when(kind == 1, "no address")
        .otherwise("")
        .alias("notify_email"),
    )


@query("watchlist_roundtrip", f"WITH {WATCH_SQL} SELECT * FROM w")
def watchlist_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Rows packed into JSON documents of at most a few entries, and read back from them."""
    return watchlists.explode_documents(watchlists.to_documents(_watchlist(spark, d), 20))


@query("watchlist_counts", "SELECT CAST(o_custkey AS VARCHAR) AS user_id, count(DISTINCT l_partkey) AS favorites FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def watchlist_counts(spark: SparkSession, d: str) -> DataFrame:
    return alerts.favorite_counts(_watchlist(spark, d))


@query("watchlist_document_sizes", "SELECT CAST(o_custkey AS VARCHAR) AS user_id, count(DISTINCT l_partkey) AS favorites FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def watchlist_document_sizes(spark: SparkSession, d: str) -> DataFrame:
    return watchlists.favorites_size(watchlists.to_documents(_watchlist(spark, d)))


@query(
    "watch_change",
    f"""WITH {CATALOG}, {WATCH_SQL.removeprefix(PARTS + ',')},
    x AS (SELECT w.user_id, w.product_id, price_at_addition, price,
                 floor(abs((price - price_at_addition) / price_at_addition) * 100 + 0.5) AS pct
          FROM w JOIN catalog ON id = w.product_id)
    SELECT user_id, product_id, price,
           CASE WHEN pct <> 0 THEN CASE WHEN price < price_at_addition THEN 'down' ELSE 'up' END END AS direction,
           CASE WHEN pct <> 0 THEN CAST(pct AS BIGINT) END AS pct FROM x""",
)
def watch_change(spark: SparkSession, d: str) -> DataFrame:
    changed = alerts.change_since_added(_watchlist(spark, d), _catalog(spark, d))
    return changed.select(
        "user_id",
        "product_id",
        "price",
        F.col("change_since.direction").alias("direction"),
        F.col("change_since.pct").alias("pct"),
    )


@query(
    "price_alerts",
    f"""WITH {CATALOG}, {WATCH_SQL.removeprefix(PARTS + ',')}
    SELECT user_id, product_id, notify_email AS to_email, coalesce(catalog.name, '(Producto desconocido)') AS product_name,
           catalog.url AS product_url, price AS current_price, coalesce(price_at_addition, price) AS price_at_addition
    FROM w JOIN catalog ON id = w.product_id WHERE notify_by_email AND product_id % 3 = 0""",
)
def price_alerts(spark: SparkSession, d: str) -> DataFrame:
    return alerts.price_alerts(_watchlist(spark, d), _catalog(spark, d))


@query(
    "watchlist_updates",
    f"""WITH {WATCH_SQL}
    SELECT user_id, product_id, notify_by_email OR product_id % 7 = 0 AS notify_by_email,
           CASE WHEN product_id % 7 = 0 THEN 'new@example.com' ELSE notify_email END AS notify_email, price_at_addition
    FROM w WHERE product_id % 11 <> 0 AND user_id <> '7'
    UNION ALL SELECT '7', id, false, '', CAST(id AS DOUBLE) FROM parts""",
)
def watchlist_updates(spark: SparkSession, d: str) -> DataFrame:
    """Favourites removed, alerts requested, and every part added for one user."""
    watch = _watchlist(spark, d)
    removed = watch.filter("product_id % 11 = 0").select("user_id", "product_id")
    asked = watch.filter("product_id % 7 = 0").select("user_id", "product_id", F.lit("new@example.com").alias("email"))
    kept = alerts.request_alerts(alerts.remove_favorites(watch, removed), asked)
    products = a.parts(spark, d).select("id", "url", "name", F.col("id").cast("double").alias("price"))
    added = alerts.add_favorites(kept, products, F.lit("7"), a.instant(a.NOW))
    return added.select("user_id", "product_id", "notify_by_email", "notify_email", "price_at_addition")


