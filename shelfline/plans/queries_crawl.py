"""Registered queries on URL discovery, crawl plans, sitemaps and page extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions.urls import (
    fetch_outcome,
    is_challenge_page,
    is_disambiguated,
    is_product_url,
)
from shelfline.operators import catalog, chunks, discover, extract
from shelfline.plans import adapters as a
from shelfline.plans import jobs
from shelfline.plans.oracle_parts import CHECKED, EPOCH, NOW_SQL, PARTS, URL
from shelfline.plans.queries_history import query_table
from shelfline.schemas import PAGES, align_schema
from shelfline.session import scratch_dir
from shelfline.sources import tables
from shelfline.sources.sitemaps import resolve_sitemap, sitemap_urls
from shelfline.sources.worklists import override_urls, read_chunk, write_chunks

QUERIES, ORACLES, query = query_table()

ALLOW, DENY = ["/en/", "/es/"], ["blog", "page="]
LISTED = "(contains(lower(url), '/en/') OR contains(lower(url), '/es/')) AND NOT (contains(lower(url), 'blog') OR contains(lower(url), 'page='))"


@query("product_url_filter", f"SELECT url, {LISTED} AS is_product FROM pages")
def product_url_filter(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return a.table(spark, d, "pages").select("url", is_product_url(url, ALLOW, DENY).alias("is_product"))


def _web(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Listed pages (some hosts list theirs twice, .html pages not), and the tracked secure ones."""
    pages = a.table(spark, d, "pages")
    copies = F.when(F.contains("url", F.lit(".org/")), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    listed = pages.filter(~F.col("url").endswith(".html")).select("url", F.explode(copies).alias("_copy")).drop("_copy")
    found = discover.product_urls_of(listed, ALLOW, DENY)
    tracked = pages.filter(F.col("url").startswith("https") & is_product_url(F.col("url"), ALLOW, DENY))
    return found, tracked.select("url")


WEB_SQL = f"""listed AS (SELECT url, CASE WHEN contains(url, '.org/') THEN 2 ELSE 1 END AS n FROM pages
            WHERE NOT url LIKE '%.html' AND {LISTED}),
tracked AS (SELECT url FROM pages WHERE url LIKE 'https%' AND {LISTED})"""


@query(
    "new_urls",
    f"WITH {WEB_SQL} SELECT url, CAST(n AS BIGINT) AS n FROM listed WHERE url NOT IN (SELECT url FROM tracked)",
)
def new_urls(spark: SparkSession, d: str) -> DataFrame:
    return discover.new_urls(*_web(spark, d))


@query("orphan_urls", f"WITH {WEB_SQL} SELECT url FROM tracked WHERE url NOT IN (SELECT url FROM listed)")
def orphan_urls(spark: SparkSession, d: str) -> DataFrame:
    return discover.orphaned_urls(*_web(spark, d))


@query(
    "discovery_counts",
    f"""WITH {WEB_SQL} SELECT CAST((SELECT sum(n) FROM listed) AS BIGINT) AS listed,
    (SELECT count(*) FROM tracked) AS tracked,
    CAST((SELECT sum(n) FROM listed WHERE url NOT IN (SELECT url FROM tracked)) AS BIGINT) AS new,
    (SELECT count(*) FROM tracked WHERE url NOT IN (SELECT url FROM listed)) AS orphaned""",
)
def discovery_counts(spark: SparkSession, d: str) -> DataFrame:
    return discover.discovery_counts(*_web(spark, d))


def _shop_sitemaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = a.table(spark, d, "part").select(a.product_url().alias("url"), "p_partkey")
    documents = a.sitemap_documents(rows, F.col("p_partkey"))
    return a.sitemap_indexes(documents), documents.select("loc", "xml")


@query(
    "discover_urls",
    f"""WITH {PARTS} SELECT url, CASE WHEN category = 'PROMO' THEN sku END AS sku,
    CASE WHEN category = 'PROMO' THEN NULL ELSE {EPOCH} END AS last_checked_at,
    CASE WHEN category = 'PROMO' THEN NULL ELSE {NOW_SQL} END AS first_seen_at FROM parts""",
)
def discover_urls(spark: SparkSession, d: str) -> DataFrame:
    """The discovery job: the PROMO parts are tracked, the sitemaps list all of them."""
    entry, stored = _shop_sitemaps(spark, d)
    tracked = a.parts(spark, d).filter("category = 'PROMO'")
    found = jobs.discover_urls(entry, stored, tracked, a.instant(a.NOW))
    return found.products.select("url", "sku", "last_checked_at", "first_seen_at")


@query("sitemap_roundtrip", "SELECT 'https://shop.example/sitemap-' || page_id // 100 || '.xml' AS loc, url FROM pages")
def sitemap_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Page URLs written into sitemap documents and read back from the XML."""
    pages = a.table(spark, d, "pages").select("url", "page_id")
    return sitemap_urls(a.sitemap_documents(pages, F.col("page_id")))


@query(
    "sitemap_index",
    f"""SELECT 'https://shop.example/sitemap-' || p_partkey // 100 || '.xml' AS loc, {URL} AS url FROM part
    UNION ALL SELECT DISTINCT 'https://shop.example/lost-' || p_partkey // 10000 || '.xml', NULL FROM part""",
)
def sitemap_index(spark: SparkSession, d: str) -> DataFrame:
    """Product URLs reached through sitemap indexes, each naming one child that is missing."""
    return resolve_sitemap(*_shop_sitemaps(spark, d))


AUDIT_ROWS = f"""rows AS (
  SELECT 'https://shop.example/sitemap-' || p_partkey // 100 || '.xml' AS loc, {URL} AS url, p_partkey % 3 = 0 AS numbered FROM part
  UNION ALL SELECT DISTINCT 'https://shop.example/lost-' || p_partkey // 10000 || '.xml', NULL, false FROM part)"""


@query(
    "sitemap_audit",
    f"""WITH {AUDIT_ROWS} SELECT loc, count(url) AS urls, count(url) AS product_urls,
    count(*) FILTER (WHERE numbered) AS numbered FROM rows GROUP BY ROLLUP (loc)""",
)
def sitemap_audit(spark: SparkSession, d: str) -> DataFrame:
    return discover.audit_counts(resolve_sitemap(*_shop_sitemaps(spark, d)))


@query("numbered_slugs", f"SELECT {URL} AS url FROM part WHERE p_partkey % 3 = 0")
def numbered_slugs(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "part").select(a.product_url().alias("url")).filter(is_disambiguated(F.col("url")))


TARGETS = [
    "HTTPS://shop.example/producto/small-ring-0",
    "https://other.example/producto/red-widget-x1/",
    "https://shop.example/producto/blue-anvil-999999999/",
    "https://shop.example/producto/none-of-these-7/",
]


@query(
    "url_targets",
    f"""WITH u AS (SELECT {URL} AS url FROM part), t(target, whole, slug, base) AS (VALUES
      ('{TARGETS[0]}', 'https://shop.example/producto/small-ring-0', '{TARGETS[0].lower()}', '{TARGETS[0].lower()[:-2]}'),
      ('{TARGETS[1]}', 'https://other.example/producto/red-widget-x1', 'red-widget-x1', NULL),
      ('{TARGETS[2]}', 'https://shop.example/producto/blue-anvil-999999999', 'blue-anvil-999999999', 'blue-anvil'),
      ('{TARGETS[3]}', 'https://shop.example/producto/none-of-these-7', 'none-of-these-7', 'none-of-these')),
    m AS (SELECT target, url, CASE WHEN regexp_replace(lower(url), '/$', '') = whole THEN 1
            WHEN contains(lower(url), slug) THEN 2 WHEN contains(lower(url), base) THEN 3 END AS stage FROM u, t)
    SELECT target, stage, url FROM m WHERE stage IS NOT NULL
    QUALIFY stage = min(stage) OVER (PARTITION BY target)""",
)
def url_targets(spark: SparkSession, d: str) -> DataFrame:
    urls = a.table(spark, d, "part").select(a.product_url().alias("url"))
    return discover.url_variants(urls, TARGETS)


@query(
    "url_variants",
    """SELECT regexp_replace(lower(u), '/$', '') AS comparable, count(*) AS n FROM (
       SELECT unnest([url, upper(url), url || '/']) AS u FROM pages) GROUP BY 1""",
)
def url_variants(spark: SparkSession, d: str) -> DataFrame:
    """Page URLs in three spellings, grouped by their comparable form."""
    url = F.col("url")
    spelled = a.table(spark, d, "pages").select(
        F.explode(F.array(url, F.upper(url), F.concat(url, F.lit("/")))).alias("url")
    )
    return discover.equal_urls(spelled)


# Crawl plans


@query(
    "crawl_chunks",
    f"""WITH {CHECKED}, k AS (SELECT url, last_checked_at FROM checked WHERE is_active ORDER BY last_checked_at, url LIMIT 501)
    SELECT url, CAST(ntile(4) OVER (ORDER BY last_checked_at, url) - 1 AS INTEGER) AS chunk FROM k""",
)
def crawl_chunks(spark: SparkSession, d: str) -> DataFrame:
    return jobs.plan_crawl(a.checked_parts(spark, d), limit=501)


@query(
    "balanced_chunks",
    "SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS chunk FROM orders",
)
def balanced_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All orders in seven balanced consecutive chunks, numbered in parallel."""
    orders = a.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    order = [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()]
    return chunks.balanced_chunks(orders, order, 7).select("o_orderkey", "chunk")


@query(
    "chunk_manifest",
    """SELECT c.chunk, count(o_orderkey) AS n FROM (SELECT unnest(range(9)) AS chunk) c
    LEFT JOIN (SELECT o_orderkey, o_custkey % 7 AS chunk FROM orders) o ON o.chunk = c.chunk GROUP BY 1""",
)
def chunk_manifest(spark: SparkSession, d: str) -> DataFrame:
    planned = a.table(spark, d, "orders").select((F.col("o_custkey") % 7).cast("int").alias("chunk"))
    return chunks.chunk_manifest(planned, 9)


@query("chunk_files", f"WITH {PARTS} SELECT url, CAST(id % 4 AS INTEGER) AS chunk FROM parts")
def chunk_files(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as JSON, one folder each, and read back."""
    home = scratch_dir(spark, "chunks")
    planned = a.parts(spark, d).select("url", (F.col("id") % 4).cast("int").alias("chunk"))
    write_chunks(planned, home)
    back = None
    for n in range(4):
        one = read_chunk(spark, f"{home}/chunk={n}").withColumn("chunk", F.lit(n))
        back = one if back is None else back.unionByName(one)
    return back


@query(
    "override_list",
    """SELECT o_orderpriority, trim(part) AS url, count(*) AS n FROM (
         SELECT o_orderpriority, unnest(string_split(' ' || o_orderpriority || ' , , ' || o_orderstatus || ',', ',')) AS part FROM orders)
       WHERE trim(part) <> '' GROUP BY ALL""",
)
def override_list(spark: SparkSession, d: str) -> DataFrame:
    """Comma-separated lists in a column, taken apart like a literal override."""
    from shelfline.functions.text import strip

    text = F.concat(F.lit(" "), "o_orderpriority", F.lit(" , , "), "o_orderstatus", F.lit(","))
    parts = a.table(spark, d, "orders").select("o_orderpriority", F.explode(F.split(text, ",")).alias("url"))
    trimmed = parts.withColumn("url", strip(F.col("url"))).filter("url <> ''")
    return trimmed.groupBy("o_orderpriority", "url").agg(F.count("*").alias("n"))


@query(
    "tracked_overrides",
    f"WITH {PARTS} SELECT id, url FROM parts WHERE url IN (SELECT max(url) FROM parts UNION ALL SELECT min(url) FROM parts)",
)
def tracked_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Products named by a literal override list."""
    products = a.parts(spark, d).select("id", "url")
    ends = products.agg(F.min("url").alias("a"), F.max("url").alias("b")).first()
    return products.join(override_urls(spark, f" {ends.a} ,, {ends.b} "), "url", "left_semi")


# Pages

OUTCOME_SQL = """SELECT page_id, status, coalesce(
  map {0: 'no_response', 403: 'forbidden', 429: 'throttled', 503: 'unavailable'}[status],
  CASE WHEN regexp_matches(body, 'Just a moment|cf-browser-verification') THEN 'challenge'
       WHEN regexp_matches(body, 'Enable JavaScript|enable javascript') THEN 'script_wall'
       WHEN regexp_matches(body, 'Access denied|access denied') THEN 'denied'
       WHEN regexp_matches(body, 'product_title|woocommerce|add to cart') THEN 'product' END,
  CASE WHEN status = 200 THEN 'unrecognized' ELSE 'status_' || status END) AS outcome, contains(body, 'jschl-answer') OR contains(body, 'cf-browser-verification') AS challenge
  FROM (SELECT page_id, [200, 0, 403, 429, 503, 200, 200, 200, 500, 200][page_id % 10 + 1] AS status,
    html || ['', '', '', '', '', 'Just a moment', 'enable javascript', 'Access denied', 'jschl-answer', 'add to cart'][page_id % 10 + 1] AS body FROM pages)"""


@query("fetch_outcomes", OUTCOME_SQL)
def fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    statuses = [200, 0, 403, 429, 503, 200, 200, 200, 500, 200]
    notes = ["", "", "", "", "", "Just a moment", "enable javascript", "Access denied", "jschl-answer", "add to cart"]
    at = (F.col("page_id") % 10).cast("int")
    rows = a.table(spark, d, "pages").select(
        "page_id",
        F.get(F.array(*map(F.lit, statuses)), at).alias("status"),
        F.concat("html", F.get(F.array(*map(F.lit, notes)), at)).alias("body"),
    )
    return rows.select(
        "page_id",
        "status",
        fetch_outcome(F.col("status"), F.col("body")).alias("outcome"),
        is_challenge_page(F.col("body")).alias("challenge"),
    )


def _decoded(text: str) -> str:
    """SQL that resolves the entities of the test pages; a closing semicolon may be missing."""
    for entity, char in [("&lt", "<"), ("&gt", ">"), ("&quot", '"'), ("&#x27", "''"), ("&#39", "''"), ("&amp", "&")]:
        text = f"regexp_replace({text}, '{entity};?', '{char}', 'g')"
    return text


@query(
    "page_fields",
    f"""WITH f AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS t,
    regexp_extract(html, '<h1>(.*?)</h1>', 1) AS h FROM pages)
    SELECT page_id, nullif(trim({_decoded('t')}), '') AS title, nullif(trim({_decoded('h')}), '') AS heading FROM f""",
)
def page_fields(spark: SparkSession, d: str) -> DataFrame:
    """Title and heading of every stored web page, through the page flattener."""
    pages = a.table(spark, d, "pages").select("page_id", "html")
    return extract.page_text(pages, {"title": "title", "heading": "h1"})


EXTRACT_SQL = f"""SELECT {URL} AS url, status_code, is_challenge, is_product,
  CASE WHEN is_product THEN p_name END AS name, CASE WHEN is_product THEN p_brand END AS sku,
  CASE WHEN is_product THEN p_type END AS category, CASE WHEN is_product THEN 'Tipo ' || p_type || 'fin' END AS description,
  CASE WHEN is_product THEN 'https://shop.example/img/' || p_partkey || '.jpg' END AS image_url,
  CASE WHEN priced THEN CASE WHEN k = 2 THEN floor(p_retailprice) ELSE p_retailprice END END AS price,
  CASE WHEN priced AND p_size % 2 = 0 THEN CASE WHEN k = 2 THEN floor(p_retailprice + 100) ELSE round(p_retailprice + 100, 2) END END AS original_price,
  CASE WHEN priced THEN ['USD', 'EUR', 'CRC', NULL][k + 1] END AS currency,
  CASE WHEN is_product AND p_size % 2 = 0 THEN p_size END AS discount_percentage,
  CASE WHEN NOT is_product THEN NULL WHEN k = 0 THEN 'Alajuela' WHEN k = 1 THEN 'Heredia' WHEN k = 2 THEN 'Bodega' END AS location,
  CASE WHEN NOT is_product THEN NULL WHEN k = 0 THEN CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN p_size ELSE 1 END
       WHEN k = 1 THEN p_size WHEN k = 2 THEN p_size % 2 END AS quantity,
  is_product AND CASE k WHEN 0 THEN p_size % 3 > 0 WHEN 1 THEN true WHEN 2 THEN p_size % 2 > 0 ELSE p_size % 2 = 0 END AS is_available,
  CASE WHEN is_product AND p_partkey % 5 < 4 THEN DATE '2020-01-01' + p_size END AS published_date,
  CASE WHEN is_product AND NOT priced THEN 'no price element on the page' END AS price_debug,
  CASE WHEN is_product AND NOT priced THEN contains(p_name, ' ') END AS diagnosed
FROM (SELECT *, p_partkey % 4 AS k, p_partkey % 20 = 17 AS is_challenge, p_partkey % 20 < 17 AS is_product,
             CASE WHEN p_partkey % 20 = 19 THEN 404 ELSE 200 END AS status_code,
             p_partkey % 20 < 17 AND p_size % 9 <> 0 AS priced FROM part)"""


@query("extract_observations", EXTRACT_SQL)
def extract_observations(spark: SparkSession, d: str) -> DataFrame:
    """Product records read from shop pages that are rendered from the parts."""
    rows = extract.extract_products(a.rendered_pages(spark, d))
    store = F.get("stock_locations", F.lit(0))
    return rows.select(
        *["url", "status_code", "is_challenge", "is_product", "name", "sku", "category", "description", "image_url"],
        *["price", "original_price", "currency", "discount_percentage"],
        store["location"].alias("location"),
        store["quantity"].alias("quantity"),
        *["is_available", "published_date", "price_debug"],
        (
            (F.get_json_object("html_debug", "$.title") == F.col("name"))
            & (F.get_json_object("html_debug", "$.price_markup") == "Consultar")
            & F.get_json_object("html_debug", "$.body_excerpt").startswith("Inicio")
        ).alias("diagnosed"),
    )


@query(
    "stock_places",
    f"""SELECT {URL} AS url, place.pos AS pos, place.location AS location, place.quantity AS quantity
FROM part, LATERAL (SELECT unnest([
    {{'k': 0, 'pos': 0, 'location': 'Alajuela', 'quantity': CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN p_size ELSE 1 END}},
    {{'k': 0, 'pos': 1, 'location': 'Cartago', 'quantity': 0}},
    {{'k': 1, 'pos': 0, 'location': 'Heredia', 'quantity': p_size}}, {{'k': 1, 'pos': 1, 'location': 'Liberia', 'quantity': 3}},
    {{'k': 2, 'pos': 0, 'location': 'Bodega', 'quantity': p_size % 2}}, {{'k': 2, 'pos': 1, 'location': 'Tienda', 'quantity': 0}}]) AS place) AS places
WHERE place.k = p_partkey % 4 AND p_partkey % 20 < 17""",
)
def stock_places(spark: SparkSession, d: str) -> DataFrame:
    """Every stock place of every page, in page order; rows without a number are no places."""
    rows = extract.extract_products(a.rendered_pages(spark, d))
    return rows.select("url", F.posexplode("stock_locations").alias("pos", "place")).select("url", "pos", "place.location", "place.quantity")


@query(
    "page_diagnoses",
    f"""SELECT {URL} AS url, p_name AS title, true AS has_summary, 'Consultar' AS price_markup,
    'no price element on the page' AS price_debug FROM part WHERE p_partkey % 20 < 17 AND p_size % 9 = 0""",
)
def page_diagnoses(spark: SparkSession, d: str) -> DataFrame:
    """What is kept of product pages without a price, field by field."""
    rows = extract.extract_products(a.rendered_pages(spark, d)).filter(F.col("is_product") & F.col("price").isNull())
    read = lambda name: F.get_json_object("html_debug", f"$.{name}")
    return rows.select(
        "url", read("title").alias("title"), (read("has_summary") == "true").alias("has_summary"), read("price_markup").alias("price_markup"), "price_debug"
    )


@query("stored_pages", "SELECT url, strlen(html) AS html_bytes, 200 AS status_code FROM pages")
def stored_pages(spark: SparkSession, d: str) -> DataFrame:
    """Crawled pages written in the page schema and read back whole."""
    home = scratch_dir(spark, "pages")
    fetched = a.table(spark, d, "pages").select("url", "html", F.lit(200).alias("status_code"), a.instant(a.NOW).alias("fetched_at"))
    align_schema(fetched, PAGES).write.parquet(home)
    return tables.read_pages(spark, home).select("url", F.octet_length("html").cast("long").alias("html_bytes"), "status_code")


@query("tracked_urls", f"SELECT {URL} AS url FROM part")
def tracked_urls(spark: SparkSession, d: str) -> DataFrame:
    return catalog.product_urls(a.parts(spark, d))


@query(
    "work_list_precedence",
    f"""WITH {CHECKED}, c AS (SELECT url FROM parts WHERE id % 7 = 0),
    s AS (SELECT url FROM checked WHERE is_active ORDER BY last_checked_at, url LIMIT 100)
    SELECT 'override' AS source, unnest(['{a.SHOP}b/', '{a.SHOP}a/']) AS url, unnest([0, 1]) AS chunk
    UNION ALL SELECT 'chunk', url, CAST(ntile(4) OVER (ORDER BY url) - 1 AS INTEGER) FROM c
    UNION ALL SELECT 'stale', url, CAST(ntile(4) OVER (ORDER BY last_checked_at, url) - 1 AS INTEGER) FROM (SELECT * FROM s JOIN checked USING (url))""",
)
def work_list_precedence(spark: SparkSession, d: str) -> DataFrame:
    """An override wins over a chunk file, a chunk file over the stalest products."""
    products = a.checked_parts(spark, d)
    home = scratch_dir(spark, "work-list")
    products.filter(F.col("id") % 7 == 0).select("url").write.json(home)
    listed = f" {a.SHOP}b/, , {a.SHOP}a/ "
    plans = {
        "override": jobs.plan_crawl(products, 100, a.WORKERS, override=listed, chunk_path=home),
        "chunk": jobs.plan_crawl(products, 100, a.WORKERS, chunk_path=home),
        "stale": jobs.plan_crawl(products, 100, a.WORKERS),
    }
    found = [plan.select(F.lit(source).alias("source"), "url", "chunk") for source, plan in plans.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


PLAN_LIMIT = 300


@query(
    "crawl_plan_full",
    f"""WITH {CHECKED}, l AS (SELECT * FROM checked WHERE is_active ORDER BY last_checked_at, url LIMIT {PLAN_LIMIT})
    SELECT 'limited' AS plan, url, CAST(ntile({a.WORKERS}) OVER (ORDER BY last_checked_at, url) - 1 AS INTEGER) AS chunk FROM l
    UNION ALL SELECT 'all', url, CAST(ntile({a.WORKERS}) OVER (ORDER BY last_checked_at, url) - 1 AS INTEGER) FROM checked""",
)
def crawl_plan_full(spark: SparkSession, d: str) -> DataFrame:
    """The stalest products up to a limit, and all products, planned by the same steps."""
    products = a.checked_parts(spark, d)
    limited = jobs.plan_crawl(products, PLAN_LIMIT, a.WORKERS)
    everything = jobs.plan_crawl(products, None, a.WORKERS, include_inactive=True)
    return limited.select(F.lit("limited").alias("plan"), "url", "chunk").unionByName(everything.select(F.lit("all").alias("plan"), "url", "chunk"))


@query(
    "crawl_backlog",
    f"""SELECT count(*) AS waiting, least(count(*), {PLAN_LIMIT}) AS planned, greatest(count(*) - {PLAN_LIMIT}, 0) AS left_out
    FROM part WHERE p_size > 5""",
)
def crawl_backlog(spark: SparkSession, d: str) -> DataFrame:
    return jobs.crawl_backlog(a.checked_parts(spark, d), PLAN_LIMIT)


@query(
    "url_targets_table",
    f"""WITH u AS (SELECT lower({URL}) AS l, {URL} AS url FROM part),
    k AS (SELECT p_partkey % 4 AS kind, p_partkey AS key, regexp_extract({URL}, '([^/]+)/$', 1) AS slug, {URL} AS url FROM part),
    t AS (SELECT DISTINCT CASE kind WHEN 0 THEN upper(url) WHEN 1 THEN slug WHEN 2 THEN 'none-of-these-' || key ELSE slug || '-7' END AS target FROM k),
    s AS (SELECT target, regexp_replace(lower(target), '/$', '') AS slug FROM t),
    b AS (SELECT *, CASE WHEN regexp_matches(slug, '^.+-[0-9]+$') THEN regexp_replace(slug, '-[0-9]+$', '') END AS base FROM s),
    m AS (SELECT target, url, CASE WHEN regexp_replace(l, '/$', '') = slug THEN 1 WHEN contains(l, slug) THEN 2 WHEN contains(l, base) THEN 3 END AS stage FROM u, b)
    SELECT target, stage, url FROM m WHERE stage IS NOT NULL QUALIFY stage = min(stage) OVER (PARTITION BY target)""",
)
def url_targets_table(spark: SparkSession, d: str) -> DataFrame:
    """A target for every part, told by whole URL, by slug, or by a slug with a number behind it; a fourth has no match."""
    urls = a.table(spark, d, "part").select("p_partkey", a.product_url().alias("url"))
    slug, kind = F.regexp_extract("url", "([^/]+)/$", 1), F.col("p_partkey") % 4
    target = (
        F.when(kind == 0, F.upper("url"))
        .when(kind == 1, slug)
        .when(kind == 2, F.concat(F.lit("none-of-these-"), "p_partkey"))
        .otherwise(F.concat(slug, F.lit("-7")))
    )
    return discover.match_targets(urls.select("url"), urls.select(target.alias("target")))
