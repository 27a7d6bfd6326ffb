"""Registered queries on crawls with retries, rejected rows, run gates and incremental batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.operators import quality
from shelfline.plans import adapters as a
from shelfline.plans import jobs
from shelfline.plans.oracle_parts import ACTIVITY, EPOCH, strict
from shelfline.plans.queries_history import query_table
from shelfline.schemas import HISTORY, OBSERVATIONS, PRODUCTS, align_schema, product_id
from shelfline.session import scratch_dir
from shelfline.streaming import ingest

QUERIES, ORACLES, query = query_table()

# ---- retries inside a crawl

CRAWLS_SQL = f"""line AS (
  SELECT l_orderkey, l_linenumber,
         min(ROW(l_shipdate, l_quantity, l_returnflag, l_linestatus, l_tax, l_extendedprice, l_partkey, l_suppkey)) AS r
  FROM lineitem GROUP BY 1, 2),
f AS (SELECT l_orderkey, l_linenumber - 1 AS attempt, r[2] AS q, r[5] >= 0.07 AS gone,
             r[5] < 0.07 AND r[3] = 'R' AS is_challenge,
             r[5] < 0.07 AND r[3] <> 'R' AND r[4] = 'O' AS is_product, r[6] AS x FROM line),
o AS (SELECT '{a.SHOP}crawl-' || (l_orderkey // 10) || '/' AS url, 'run-' || (l_orderkey % 10) AS run_id, attempt,
             TIMESTAMP '1999-01-01' + to_hours(CAST(l_orderkey % 10 AS INTEGER)) + to_minutes(CAST(attempt AS INTEGER)) AS observed_at,
             (l_orderkey // 10) % 3 = 0 AS known, is_challenge, is_product, gone, CASE WHEN is_product AND q >= 25 THEN x END AS price FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY url, run_id ORDER BY again, CASE WHEN again THEN -attempt ELSE attempt END) AS rn
      FROM (SELECT *, is_challenge OR (is_product AND price IS NULL) AS again FROM o WHERE attempt <= 2)),
settled AS (SELECT *, CASE WHEN gone THEN 'inactive' WHEN is_challenge THEN 'challenge' WHEN NOT is_product THEN 'not_product'
                           WHEN price IS NULL THEN 'null_price' ELSE 'priced' END AS outcome,
                   known AND observed_at <= TIMESTAMP '1999-01-01 04:30:00' AS late FROM p WHERE rn = 1)"""


def _crawls(spark: SparkSession, d: str) -> jobs.Update:
    """Line items as fetches: ten runs a URL, a row per attempt; every third URL was checked between the runs."""
    fetches = a.crawl_observations(spark, d)
    page = F.regexp_extract("url", "([0-9]+)/$", 1).cast("long")
    checked = fetches.filter(page % 3 == 0).select("url").distinct()
    stored = checked.select(
        product_id(F.col("url")).alias("id"),
        "url",
        a.instant("1998-01-01 00:00:00").alias("first_seen_at"),
        a.instant("1999-01-01 04:30:00").alias("last_checked_at"),
        F.lit(True).alias("is_active"),
    )
    empty = spark.createDataFrame([], HISTORY)
    return jobs.apply_observations(align_schema(stored, PRODUCTS), empty, fetches)


@query(
    "apply_observations_retries",
    f"""WITH {CRAWLS_SQL}, good AS (SELECT url, observed_at, price FROM settled WHERE NOT late AND outcome IN ('priced', 'null_price')),
    {strict('good', 'price', 'h', key='url')}
    SELECT url, price, start_ts, end_ts FROM h""",
)
def retried_crawls(spark: SparkSession, d: str) -> DataFrame:
    """History of crawls with retries: each run of a URL counts once, with the attempt that settled it."""
    update = _crawls(spark, d)
    urls = update.products.select(F.col("id").alias("product_id"), "url")
    return update.history.join(urls, "product_id").select("url", "price", "start_ts", "end_ts")


@query(
    "rejected_observations",
    f"""WITH {CRAWLS_SQL}
    SELECT url, run_id, attempt, observed_at, 'retry_limit' AS reason FROM o WHERE attempt > 2
    UNION ALL SELECT url, run_id, attempt, observed_at, 'late' FROM settled WHERE late""",
)
def rejected_observations(spark: SparkSession, d: str) -> DataFrame:
    return _crawls(spark, d).rejected.select("url", "run_id", "attempt", "observed_at", "reason")


@query(
    "null_price_gate",
    f"""WITH {CRAWLS_SQL}
    SELECT count(*) FILTER (WHERE outcome IN ('priced', 'null_price')) AS processed,
           count(*) FILTER (WHERE outcome = 'null_price') AS null_price,
           {quality.NULL_PRICE_LIMIT} AS tolerated, count(*) FILTER (WHERE outcome = 'null_price') > {quality.NULL_PRICE_LIMIT} AS failed
    FROM settled WHERE NOT late""",
)
def null_price_gate(spark: SparkSession, d: str) -> DataFrame:
    """The counters that the job takes in flight, and whether its gate closes on them."""
    update = _crawls(spark, d)
    failed = False
    try:
        update.require_prices()
    except quality.TooManyNullPrices:
        failed = True
    row = (update.counts["priced"] + update.counts["null_price"], update.counts["null_price"], quality.NULL_PRICE_LIMIT, failed)
    return spark.createDataFrame([row], "processed long, null_price long, tolerated int, failed boolean")


# ---- incremental batches

FIRST_CUT = "2024-01-10 00:00:00"
SECOND_CUT = "2024-01-20 00:00:00"
#: Every so many events of the first batch that are no errors come again, late and with another price.
LATE_EVERY = 50


def _activity_observations(spark: SparkSession, d: str) -> DataFrame:
    gone = F.col("event_type") == "error"
    seen = a.activity(spark, d).join(a.table(spark, d, "events").select(F.col("user_id").alias("product_id"), F.col("ts").alias("observed_at"), "event_id"), ["product_id", "observed_at"])
    return seen.select(
        F.concat(F.lit(a.SHOP), F.col("product_id"), F.lit("/")).alias("url"),
        "observed_at",
        "event_id",
        F.lit(0).alias("attempt"),
        F.when(gone, 404).otherwise(200).alias("status_code"),
        F.when(~gone, F.col("price")).alias("price"),
        F.lit("CRC").alias("currency"),
        (~gone).alias("is_product"),
        F.lit(False).alias("is_challenge"),
    )


def _run_in_three(spark: SparkSession, d: str) -> str:
    """Events as they arrive: two lots of files, a restart that finds nothing new, a third lot; returns the tables' folder.

    A lot is one batch. It is written by parallel tasks, and no lot has more files than the first, so that as many files
    a batch take a lot whole: files come in order of time.
    """
    home = scratch_dir(spark, "arrivals")
    rows = _activity_observations(spark, d)
    first = F.col("observed_at") < a.instant(FIRST_CUT)
    second = ~first & (F.col("observed_at") < a.instant(SECOND_CUT))
    again = first & F.col("is_product") & (F.col("event_id") % LATE_EVERY == 0)
    late = rows.filter(again).withColumn("price", F.col("price") + 1000)

    def arrive(frame: DataFrame, files: int) -> None:
        align_schema(frame, OBSERVATIONS).repartition(files).write.mode("append").parquet(f"{home}/in")

    arrive(rows.filter(first), spark.sparkContext.defaultParallelism)
    lot = len(spark.read.schema(OBSERVATIONS).parquet(f"{home}/in").inputFiles())

    def run() -> ingest.Run:
        return ingest.run_ingest(ingest.observation_stream(spark, f"{home}/in", files_per_batch=lot), f"{home}/tables", n_buckets=8)

    arrive(rows.filter(second).unionByName(late), lot)
    run()
    run()  # nothing new: no batch, no change
    arrive(rows.filter(~first & ~second), lot)
    run()
    return f"{home}/tables"


BATCHES_SQL = f"""{ACTIVITY},
e AS (SELECT *, event_type <> 'error' AS up FROM activity),
u AS (SELECT product_id, min(observed_at) AS first_up FROM e WHERE up GROUP BY 1),
s AS (SELECT product_id, CASE WHEN count(*) > 1 THEN max(observed_at) ELSE {EPOCH} END AS last_checked_at, arg_max(up, observed_at) AS is_active
      FROM e JOIN u USING (product_id) WHERE observed_at >= first_up GROUP BY 1),
good AS (SELECT * FROM e WHERE up)"""


@query(
    "streaming_batches",
    f"""WITH {BATCHES_SQL}, {strict('good', 'price', 'h')}
    SELECT '{a.SHOP}' || product_id || '/' AS url, price, start_ts, end_ts, is_active, last_checked_at FROM h JOIN s USING (product_id)""",
)
def streaming_batches(spark: SparkSession, d: str) -> DataFrame:
    """State and history after three batches with late rows and a restart: those of the whole log at once."""
    base = _run_in_three(spark, d)
    last = ingest.last_batch(spark, base)
    products = ingest.products_after(spark, base, last)
    state = products.select(F.col("id").alias("product_id"), "url", "is_active", "last_checked_at")
    return ingest.history_after(spark, base, last).join(state, "product_id").select(
        "url", "price", "start_ts", "end_ts", "is_active", "last_checked_at"
    )


@query(
    "catalog_of_batches",
    f"""WITH {BATCHES_SQL}, {strict('good', 'price', 'h')},
    prev AS (SELECT product_id, price AS prev_price FROM h WHERE end_ts IS NOT NULL
             QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY end_ts DESC, start_ts DESC, price DESC NULLS LAST) = 1),
    c AS (SELECT product_id, is_active, price, prev_price,
                 CASE WHEN prev_price IS NOT NULL AND prev_price <> 0 THEN (coalesce(price, 0) - prev_price) / prev_price * 100 ELSE 0 END AS change_pct
          FROM h JOIN s USING (product_id) LEFT JOIN prev USING (product_id) WHERE end_ts IS NULL)
    SELECT '{a.SHOP}' || product_id || '/' AS url, is_active, price, prev_price, change_pct FROM c""",
)
def catalog_of_batches(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue after three batches, from open intervals and the kept view of previous prices: no closed history is read."""
    base = _run_in_three(spark, d)
    last = ingest.last_batch(spark, base)
    rows, _ = jobs.catalog_view(
        ingest.products_after(spark, base, last),
        ingest.open_after(spark, base, last),
        include_inactive=True,
        only_in_stock=False,
        previous=ingest.previous_after(spark, base, last),
    )
    return rows.select("url", "is_active", "price", "prev_price", "change_pct")


@query(
    "streaming_counters",
    f"""SELECT CASE WHEN ts < TIMESTAMP '{FIRST_CUT}' THEN 0 WHEN ts < TIMESTAMP '{SECOND_CUT}' THEN 1 ELSE 2 END AS batch,
           CASE WHEN event_type = 'error' THEN 'inactive' ELSE 'priced' END AS outcome, count(*) AS n FROM events GROUP BY 1, 2
    UNION ALL
    SELECT 1, 'late', count(*) FROM events WHERE ts < TIMESTAMP '{FIRST_CUT}' AND event_type <> 'error' AND event_id % {LATE_EVERY} = 0""",
)
def streaming_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters that each batch took in flight and committed with its manifest."""
    return ingest.counters_of(spark, _run_in_three(spark, d)).filter("n > 0")
