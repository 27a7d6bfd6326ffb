"""Registered queries on price history, product state and shard merging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.operators import attempts, merge, quality, state
from shelfline.operators.intervals import (
    coalesced_intervals,
    latest_open,
    latest_record,
    mark_changes,
    previous_price,
    strict_intervals,
)
from shelfline.plans import adapters as a
from shelfline.plans import jobs, stored_merge
from shelfline.plans.oracle_parts import (
    ACTIVITY,
    CHECKED,
    EPOCH,
    HISTORY,
    MERGE_SQL,
    OFFERS,
    PARTS,
    PREVIOUS,
    coalesced,
    runs,
    strict,
)
from shelfline.schemas import HISTORY as HISTORY_SCHEMA
from shelfline.schemas import OBSERVATIONS, PRODUCTS, align_schema
from shelfline.session import scratch_dir
from shelfline.sources import buckets as store
from shelfline.sources.shards import read_shards
from shelfline.sources.tables import read_snapshot, write_snapshot
from shelfline.streaming import ingest

def query_table() -> tuple[dict, dict, Callable]:
    """Empty tables of queries and oracles, and the decorator that fills them."""
    queries: dict[str, Callable] = {}
    oracles: dict[str, str] = {}

    def query(name: str, sql: str | None = None) -> Callable:
        def keep(fn: Callable) -> Callable:
            queries[name] = fn
            if sql is not None:
                oracles[name] = sql
            return fn

        return keep

    return queries, oracles, query


QUERIES, ORACLES, query = query_table()


@query(
    "strict_intervals",
    f"""WITH {ACTIVITY}, {strict('activity', 'event_type', 'h')}
    SELECT product_id, event_type, start_ts, end_ts FROM h""",
)
def strict_on_activity(spark: SparkSession, d: str) -> DataFrame:
    return strict_intervals(a.activity(spark, d), value_cols=("event_type",))


@query(
    "coalesced_intervals",
    f"""WITH {ACTIVITY}, {coalesced('activity', 'price', 'h')}
    SELECT product_id, price, start_ts, end_ts FROM h""",
)
def coalesced_on_activity(spark: SparkSession, d: str) -> DataFrame:
    return coalesced_intervals(a.activity(spark, d), value_cols=("price",))


OFFER_COLUMNS = ["product_id", "price", "original_price", "start_ts", "end_ts"]


@query("price_history", f"WITH {HISTORY} SELECT product_id, price, original_price, start_ts, end_ts FROM hist")
def price_history(spark: SparkSession, d: str) -> DataFrame:
    return strict_intervals(a.offers(spark, d), sizing=a.offer_sizing(spark, d)).select(
        *OFFER_COLUMNS
    )


@query(
    "coalesced_price_history",
    f"""WITH {OFFERS}, {coalesced('offers', 'price, original_price', 'h')}
    SELECT product_id, price, original_price, start_ts, end_ts FROM h""",
)
def coalesced_price_history(spark: SparkSession, d: str) -> DataFrame:
    return coalesced_intervals(a.offers(spark, d), sizing=a.offer_sizing(spark, d)).select(
        *OFFER_COLUMNS
    )


@query(
    "sliced_intervals",
    f"""WITH {ACTIVITY}, {strict('activity', 'price', 'h')}
    SELECT product_id, price, start_ts, end_ts FROM h""",
)
def sliced_on_activity(spark: SparkSession, d: str) -> DataFrame:
    """Intervals with products cut into many slices by a large number of segments."""
    return strict_intervals(a.activity(spark, d), value_cols=("price",), segments=4096)


# Every part of an odd number is one product here, and all of its observations bear one time.
CROWDED = """crowded AS (
  SELECT CASE WHEN l_partkey % 2 = 1 THEN 0 ELSE l_partkey END AS product_id,
         CASE WHEN l_partkey % 2 = 1 THEN TIMESTAMP '1998-01-01' ELSE l_shipdate END AS observed_at,
         l_orderkey, l_linenumber, CAST(floor(l_quantity / 10) * 10 + 10 AS DOUBLE) AS price
  FROM lineitem)"""
CROWDED_ORDER = "observed_at, l_orderkey, l_linenumber, price"  # lines of an order are not unique in the tables


def crowded(spark: SparkSession, d: str) -> DataFrame:
    odd = F.col("l_partkey") % 2 == 1
    return a.table(spark, d, "lineitem").select(
        F.when(odd, 0).otherwise(F.col("l_partkey")).alias("product_id"),
        F.when(odd, F.lit("1998-01-01").cast("timestamp")).otherwise(F.col("l_shipdate")).alias("observed_at"),
        "l_orderkey",
        "l_linenumber",
        (F.floor(F.col("l_quantity") / 10) * 10 + 10).cast("double").alias("price"),
    )


CROWDED_ARGS = {"value_cols": ("price",), "tie_cols": ("l_orderkey", "l_linenumber")}


@query(
    "one_time_intervals",
    f"""WITH {CROWDED}, {strict('crowded', 'price', 'h', ts=CROWDED_ORDER, at='observed_at')}
    SELECT product_id, price, start_ts, end_ts FROM h""",
)
def one_time_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Strict intervals where half of all observations are of one product and one time."""
    return strict_intervals(crowded(spark, d), **CROWDED_ARGS)


@query(
    "one_time_runs",
    f"""WITH {CROWDED}, {coalesced('crowded', 'price', 'h', ts=CROWDED_ORDER, at='observed_at')}
    SELECT product_id, price, start_ts, end_ts FROM h""",
)
def one_time_runs(spark: SparkSession, d: str) -> DataFrame:
    """Coalesced intervals where half of all observations are of one product and one time."""
    return coalesced_intervals(crowded(spark, d), **CROWDED_ARGS)


@query(
    "one_time_changes",
    f"""WITH {CROWDED}, {runs('crowded', 'price', 'h', ts=CROWDED_ORDER, at='observed_at')}
    SELECT product_id, observed_at, l_orderkey, l_linenumber, price, chg = 1 AS changed FROM h_c""",
)
def one_time_changes(spark: SparkSession, d: str) -> DataFrame:
    """Price changes where half of all observations are of one product and one time."""
    return mark_changes(crowded(spark, d), **CROWDED_ARGS)


@query(
    "price_changes",
    f"""WITH {OFFERS}, {runs('offers', 'price, original_price', 'h')}
    SELECT product_id, observed_at, price, original_price, chg = 1 AS changed FROM h_c""",
)
def price_changes(spark: SparkSession, d: str) -> DataFrame:
    return mark_changes(a.offers(spark, d), sizing=a.offer_sizing(spark, d)).drop("currency")


@query(
    "latest_record",
    f"""WITH {HISTORY} SELECT product_id, price, original_price, start_ts, end_ts FROM hist
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY start_ts DESC) = 1""",
)
def newest_record(spark: SparkSession, d: str) -> DataFrame:
    return latest_record(a.history(spark, d)).select(*OFFER_COLUMNS)


@query(
    "latest_open",
    f"""WITH {HISTORY} SELECT product_id, price, original_price, start_ts FROM hist WHERE end_ts IS NULL
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY start_ts DESC) = 1""",
)
def newest_open(spark: SparkSession, d: str) -> DataFrame:
    return latest_open(a.history(spark, d)).select("product_id", "price", "original_price", "start_ts")


@query("previous_price", f"WITH {HISTORY}, {PREVIOUS} SELECT product_id, prev_price FROM prev")
def previous(spark: SparkSession, d: str) -> DataFrame:
    return previous_price(a.history(spark, d))


STATE_SQL = f"""WITH {ACTIVITY},
e AS (SELECT *, event_type <> 'error' AS up,
             CASE WHEN value < 30 THEN CAST(observed_at AS DATE) - k END AS published FROM activity),
u AS (SELECT product_id, min(observed_at) AS first_up FROM e WHERE up GROUP BY 1),
f AS (SELECT e.*, first_up FROM e JOIN u USING (product_id) WHERE observed_at >= first_up)
SELECT product_id, arg_max(event_type, observed_at) FILTER (WHERE up) AS name,
       any_value(first_up) AS first_seen_at,
       CASE WHEN count(*) > 1 THEN max(observed_at) ELSE {EPOCH} END AS last_checked_at,
       arg_max(up, observed_at) AS is_active,
       arg_min(published, observed_at) FILTER (WHERE up AND published IS NOT NULL) AS published_first,
       min(observed_at) FILTER (WHERE up AND published IS NOT NULL) AS published_first_scraped_at,
       arg_max_null(published, observed_at) FILTER (WHERE up) AS published_latest,
       CASE WHEN arg_max_null(published, observed_at) FILTER (WHERE up) IS NOT NULL
            THEN max(observed_at) FILTER (WHERE up) END AS published_latest_scraped_at
FROM f GROUP BY product_id"""


@query("product_state_fold", STATE_SQL)
def product_state_fold(spark: SparkSession, d: str) -> DataFrame:
    events = a.activity(spark, d).select(
        "product_id",
        "observed_at",
        F.when(F.col("event_type") == "error", state.GONE).otherwise(state.UPSERT).alias("kind"),
        F.col("event_type").alias("name"),
        F.when(F.col("value") < 30, F.date_sub(F.to_date("observed_at"), F.col("k"))).alias("published_date"),
    )
    return state.fold_state(events, key="product_id", metadata=["name"])


ATTEMPTS_SQL = f"""WITH line AS (
  SELECT l_orderkey, l_linenumber,
         min(ROW(l_shipdate, l_quantity, l_returnflag, l_linestatus, l_tax, l_extendedprice, l_partkey, l_suppkey)) AS r
  FROM lineitem GROUP BY 1, 2),
f AS (SELECT l_orderkey, l_linenumber - 1 AS attempt, r[1] AS observed_at, r[2] AS q, r[5] >= 0.07 AS gone,
             r[5] < 0.07 AND r[3] = 'R' AS is_challenge,
             r[5] < 0.07 AND r[3] <> 'R' AND r[4] = 'O' AS is_product, r[6] AS x FROM line),
o AS (SELECT '{a.SHOP}' || l_orderkey || '/' AS url, attempt, observed_at, is_challenge, is_product,
             CASE WHEN gone THEN 404 ELSE 200 END AS status_code,
             CASE WHEN is_product AND q >= 25 THEN x END AS price FROM f),
s AS (SELECT *, is_challenge OR (is_product AND price IS NULL) AS again FROM o WHERE attempt <= 2),
p AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY again,
             CASE WHEN again THEN -attempt ELSE attempt END) AS rn FROM s),
settled AS (SELECT url, attempt, observed_at, status_code, price,
       CASE WHEN status_code = 404 THEN 'inactive' WHEN is_challenge THEN 'challenge'
            WHEN NOT is_product THEN 'not_product' WHEN price IS NULL THEN 'null_price'
            ELSE 'priced' END AS outcome FROM p WHERE rn = 1)"""


def _settled(spark: SparkSession, d: str) -> DataFrame:
    return attempts.classify(attempts.resolve_attempts(a.page_observations(spark, d)))


@query(
    "resolve_attempts",
    f"{ATTEMPTS_SQL} SELECT url, attempt, observed_at, status_code, price, outcome FROM settled",
)
def resolved(spark: SparkSession, d: str) -> DataFrame:
    return _settled(spark, d).select("url", "attempt", "observed_at", "status_code", "price", "outcome")


@query("run_outcome_counts", f"{ATTEMPTS_SQL} SELECT outcome, count(*) AS n FROM settled GROUP BY 1")
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.run_counters(_settled(spark, d))


@query(
    "retry_backoff",
    """SELECT l_linenumber - 1 AS attempt,
       CASE WHEN l_linenumber > 1 THEN CAST(10000 * pow(2, l_linenumber - 2) AS BIGINT) END AS wait_ms,
       count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    tried = a.table(spark, d, "lineitem").select((F.col("l_linenumber") - 1).alias("attempt"))
    return attempts.backoff_schedule(tried).groupBy("attempt", "wait_ms").agg(F.count("*").alias("n"))


def _observed_offers(spark: SparkSession, d: str) -> DataFrame:
    """Offers from the merge point on, as settled page observations; every seventh day is a 404."""
    rows = a.offers(spark, d).filter(F.col("observed_at") >= a.instant(a.MERGE_POINT))
    gone = F.dayofyear("observed_at") % 7 == 0
    priced = rows.join(a.parts(spark, d).select(F.col("id").alias("product_id"), "url", "name"), "product_id")
    blank = {c: F.when(~gone, F.col(c)) for c in ("price", "original_price", "currency", "name")}
    return align_schema(
        priced.withColumns(
            {
                **blank,
                "attempt": F.lit(0),
                "status_code": F.when(gone, 404).otherwise(200),
                "is_product": ~gone,
                "is_challenge": F.lit(False),
            }
        ),
        OBSERVATIONS,
    )


def _updated(spark: SparkSession, d: str) -> jobs.Update:
    # stored rows use the same surrogate keys as the job derives from the URL
    from shelfline.schemas import history_id, product_id

    stored = a.checked_parts(spark, d, a.MERGE_POINT)
    keys = stored.select(F.col("id").alias("product_id"), product_id(F.col("url")).alias("_key"))
    past = a.history(spark, d, a.MERGE_POINT).join(keys, "product_id")
    past = past.withColumn("product_id", F.col("_key")).withColumn("id", history_id(F.col("_key"), F.col("start_ts")))
    return jobs.apply_observations(
        stored.withColumn("id", product_id(F.col("url"))),
        align_schema(past, HISTORY_SCHEMA),
        _observed_offers(spark, d),
        ["url", "observed_at"],
    )


FRESH_SQL = f"""{CHECKED},
fresh AS (SELECT *, dayofyear(observed_at) % 7 = 0 AS gone FROM offers WHERE observed_at >= {MERGE_SQL}),
past AS (SELECT * FROM offers WHERE observed_at < {MERGE_SQL}),
kept AS (SELECT * FROM past UNION ALL
         SELECT product_id, observed_at, price, original_price FROM fresh WHERE NOT gone)"""


@query(
    "apply_observations_history",
    f"""WITH {FRESH_SQL}, {strict('kept', 'price, original_price', 'h')}
    SELECT url, price, original_price, start_ts, end_ts FROM h JOIN parts ON id = product_id""",
)
def applied_history(spark: SparkSession, d: str) -> DataFrame:
    update = _updated(spark, d)
    urls = update.products.select(F.col("id").alias("product_id"), "url")
    return update.history.join(urls, "product_id").select(
        "url", "price", "original_price", "start_ts", "end_ts"
    )


@query(
    "apply_observations_state",
    f"""WITH {FRESH_SQL},
    s AS (SELECT product_id, max(observed_at) AS last_ts, arg_max(NOT gone, observed_at) AS ends_active,
                 count(*) FILTER (WHERE NOT gone) AS ups FROM fresh GROUP BY 1),
    b AS (SELECT product_id, max(observed_at) AS before_ts FROM past GROUP BY 1)
    SELECT url, name, CASE WHEN coalesce(ups, 0) > 0 THEN NULL ELSE sku END AS sku,
           coalesce(last_ts, before_ts, {EPOCH}) AS last_checked_at,
           coalesce(ends_active, is_active) AS is_active, published_first,
           CASE WHEN coalesce(ups, 0) > 0 THEN NULL ELSE published_latest END AS published_latest
    FROM parts LEFT JOIN s ON s.product_id = id LEFT JOIN b ON b.product_id = id""",
)
def applied_state(spark: SparkSession, d: str) -> DataFrame:
    return _updated(spark, d).products.select(
        "url", "name", "sku", "last_checked_at", "is_active", "published_first", "published_latest"
    )


def _merged(spark: SparkSession, d: str) -> jobs.Merge:
    delta_products, delta_history = a.shards(spark, d)
    return jobs.merge_deltas(
        a.checked_parts(spark, d, a.MERGE_POINT),
        a.history(spark, d, a.MERGE_POINT),
        delta_products,
        delta_history,
    )


MERGE_BASE = f"""{OFFERS}, {PARTS},
past AS (SELECT * FROM offers WHERE observed_at < {MERGE_SQL}),
{strict('past', 'price, original_price', 'mine')},
touched_offers AS (SELECT * FROM offers WHERE product_id % 3 = 0 AND product_id % 5 <> 0),
{strict('touched_offers', 'price, original_price', 'theirs')},
b AS (SELECT product_id, max(observed_at) AS before_ts FROM past GROUP BY 1),
l AS (SELECT product_id, max(observed_at) AS last_ts FROM offers GROUP BY 1),
m AS (SELECT parts.*, coalesce(before_ts, {EPOCH}) AS before_ts, coalesce(last_ts, {EPOCH}) AS last_ts
      FROM parts LEFT JOIN b ON b.product_id = id LEFT JOIN l ON l.product_id = id),
t AS (SELECT *, 'worker-' || id % 4 AS shard, CASE WHEN id % 5 = 0 THEN false ELSE is_active END AS active
      FROM m WHERE id % 3 = 0 AND last_ts > before_ts)"""


@query(
    "merge_deltas_state",
    f"""WITH {MERGE_BASE}
    SELECT m.id, m.url, CASE WHEN t.id IS NULL THEN m.category ELSE lower(m.category) END AS category,
           CASE WHEN t.id IS NULL THEN m.before_ts ELSE m.last_ts END AS last_checked_at,
           coalesce(t.active, m.is_active) AS is_active, m.published_latest
    FROM m LEFT JOIN t ON t.id = m.id""",
)
def merged_state(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).products.select(
        "id", "url", "category", "last_checked_at", "is_active", "published_latest"
    )


MERGE_HISTORY = f"""WITH {MERGE_BASE},
mo AS (SELECT product_id, max(start_ts) AS open_start FROM mine WHERE end_ts IS NULL GROUP BY 1),
ml AS (SELECT product_id, max(start_ts) AS latest_start FROM mine GROUP BY 1),
sl AS (SELECT * FROM theirs QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY start_ts DESC) = 1),
act AS (SELECT t.id AS product_id, CASE
          WHEN NOT t.active THEN CASE WHEN open_start IS NULL THEN 'none' ELSE 'close' END
          WHEN sl.product_id IS NULL THEN 'none'
          WHEN sl.start_ts = latest_start THEN 'extend' ELSE 'insert' END AS action,
        open_start, latest_start, t.last_ts, t.shard, sl.start_ts AS s_start, sl.end_ts AS s_end,
        sl.price AS s_price, sl.original_price AS s_original
      FROM t LEFT JOIN mo ON mo.product_id = t.id LEFT JOIN ml ON ml.product_id = t.id
             LEFT JOIN sl ON sl.product_id = t.id)"""


@query(
    "merge_deltas_history",
    f"""{MERGE_HISTORY}
    SELECT mine.product_id, price, original_price, start_ts,
           CASE WHEN action = 'extend' AND start_ts = latest_start THEN s_end
                WHEN action = 'close' AND start_ts = open_start THEN last_ts
                WHEN action = 'insert' AND start_ts = open_start THEN s_start ELSE end_ts END AS end_ts
    FROM mine LEFT JOIN act ON act.product_id = mine.product_id
    UNION ALL
    SELECT product_id, s_price, s_original, s_start, s_end FROM act WHERE action = 'insert'""",
)
def merged_history(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).history.select(*OFFER_COLUMNS)


@query(
    "merge_actions",
    f"{MERGE_HISTORY} SELECT shard, action, count(*) AS n FROM act GROUP BY 1, 2",
)
def merge_actions(spark: SparkSession, d: str) -> DataFrame:
    delta_products, delta_history = a.shards(spark, d)
    touched = merge.touched_products(a.checked_parts(spark, d, a.MERGE_POINT), delta_products)
    actions = merge.history_actions(a.history(spark, d, a.MERGE_POINT), delta_history, touched)
    return actions.groupBy("shard", "action").agg(F.count("*").alias("n"))


#: Buckets of the stored tables that the registered queries merge into.
MERGE_BUCKETS = 48


def _stored(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _merged_store(spark: SparkSession, d: str) -> tuple[str, store.Manifest]:
    """Stored tables into which the shards were merged twice, the second time without effect."""
    base = scratch_dir(spark, "merge-store")
    seen = _stored(a.offers(spark, d), f"{base}-offers")
    products, history = a.checked_parts(spark, d, a.MERGE_POINT, seen), a.history(spark, d, a.MERGE_POINT, seen)
    stored_merge.create(products, history, base, MERGE_BUCKETS)
    # what the workers left behind lies in storage, however often it is merged
    left = dict(zip(("products", "history"), a.shards(spark, d, seen), strict=True))
    deltas = [_stored(rows, f"{base}-shards/{name}") for name, rows in left.items()]
    first = stored_merge.merge_stored(spark, base, *deltas)
    again = stored_merge.merge_stored(spark, base, *deltas)
    if again != first:
        raise RuntimeError("a repeated merge changed the stored tables")
    return base, first


@query(
    "merge_stored_history",
    f"""{MERGE_HISTORY}
    SELECT mine.product_id, price, original_price, start_ts,
           CASE WHEN action = 'extend' AND start_ts = latest_start THEN s_end
                WHEN action = 'close' AND start_ts = open_start THEN last_ts
                WHEN action = 'insert' AND start_ts = open_start THEN s_start ELSE end_ts END AS end_ts
    FROM mine LEFT JOIN act ON act.product_id = mine.product_id
    UNION ALL
    SELECT product_id, s_price, s_original, s_start, s_end FROM act WHERE action = 'insert'""",
)
def merge_stored_history(spark: SparkSession, d: str) -> DataFrame:
    base, manifest = _merged_store(spark, d)
    return stored_merge.read_table(spark, base, "history", manifest).select(*OFFER_COLUMNS)


@query(
    "merge_stored_previous",
    f"""{MERGE_HISTORY},
    h AS (SELECT mine.product_id, price, start_ts,
           CASE WHEN action = 'extend' AND start_ts = latest_start THEN s_end
                WHEN action = 'close' AND start_ts = open_start THEN last_ts
                WHEN action = 'insert' AND start_ts = open_start THEN s_start ELSE end_ts END AS end_ts
      FROM mine LEFT JOIN act ON act.product_id = mine.product_id
      UNION ALL
      SELECT product_id, s_price, s_start, s_end FROM act WHERE action = 'insert')
    SELECT product_id, price AS prev_price, end_ts AS closed_at, start_ts AS opened_at FROM h WHERE end_ts IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY end_ts DESC, start_ts DESC, price DESC NULLS LAST) = 1""",
)
def merge_stored_previous(spark: SparkSession, d: str) -> DataFrame:
    """The view of previous prices as a merge leaves it."""
    base, manifest = _merged_store(spark, d)
    return stored_merge.read_table(spark, base, "previous", manifest)


@query(
    "merge_stored_buckets",
    f"""{MERGE_HISTORY},
    h AS (SELECT product_id, false AS hit FROM mine UNION ALL SELECT product_id, action <> 'none' FROM act)
    SELECT 'products' AS table_name, (m.id % {MERGE_BUCKETS})::INT AS bucket,
           max(CASE WHEN t.id IS NULL THEN 0 ELSE 1 END)::BIGINT AS version
    FROM m LEFT JOIN t ON t.id = m.id GROUP BY 1, 2
    UNION ALL
    SELECT 'history', (product_id % {MERGE_BUCKETS})::INT, max(CASE WHEN hit THEN 1 ELSE 0 END)::BIGINT FROM h
    WHERE product_id IN (SELECT product_id FROM mine) OR hit GROUP BY 1, 2""",
)
def merge_stored_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Which merge wrote each bucket of the stored tables last."""
    _, manifest = _merged_store(spark, d)
    rows = [(table, bucket, version) for (table, bucket), version in manifest.versions.items() if table != "previous"]
    return spark.createDataFrame(rows, "table_name string, bucket int, version long")


@query("merge_counts", f"WITH {MERGE_BASE} SELECT shard, count(*) AS merged FROM t GROUP BY ROLLUP (shard)")
def merge_counts(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).counts


@query(
    "shard_files",
    f"""WITH {MERGE_BASE}
    SELECT 'worker-' || id % 4 AS shard, id, is_active AND NOT (id % 3 = 0 AND id % 5 = 0) AS is_active,
           CASE WHEN id % 3 = 0 THEN last_ts ELSE before_ts END AS last_checked_at FROM m""",
)
def shard_files(spark: SparkSession, d: str) -> DataFrame:
    """Shards written as one folder per worker, with a stray folder, and read back."""
    home = scratch_dir(spark, "shards")
    products, delta_history = a.shards(spark, d)
    products = products.persist()
    for worker in [*range(a.WORKERS), None]:
        name = "backup" if worker is None else f"worker-{worker}"
        label = "worker-0" if worker is None else name
        align_schema(products.filter(F.col("shard") == label), PRODUCTS).write.parquet(f"{home}/products/{name}")
        align_schema(delta_history.filter(F.col("shard") == label), HISTORY_SCHEMA).write.parquet(f"{home}/price_history/{name}")
    products.unpersist()
    return read_shards(spark, home)[0].select("shard", "id", "is_active", "last_checked_at")


@query("snapshot_roundtrip", f"WITH {HISTORY} SELECT product_id, price, original_price, start_ts, end_ts FROM hist")
def snapshot_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    home = scratch_dir(spark, "snapshot")
    write_snapshot(a.checked_parts(spark, d), a.history(spark, d), home, "run-1")
    return read_snapshot(spark, home)[1].select(*OFFER_COLUMNS)


@query(
    "snapshot_products",
    f"""WITH {CHECKED} SELECT id, url, name, sku, category, is_active, last_checked_at, published_first, published_latest FROM checked""",
)
def snapshot_products(spark: SparkSession, d: str) -> DataFrame:
    """Products of the newest of two snapshots; the older one has other categories."""
    home = scratch_dir(spark, "snapshot")
    products, none = a.checked_parts(spark, d), spark.createDataFrame([], HISTORY_SCHEMA)
    write_snapshot(products.withColumn("category", F.lit("old")), none, home, "run-1")
    write_snapshot(products, none, home, "run-2")
    return read_snapshot(spark, home)[0].select(
        "id", "url", "name", "sku", "category", "is_active", "last_checked_at", "published_first", "published_latest"
    )


@query(
    "overlapping_shards",
    f"""WITH {CHECKED}
    SELECT url, CASE WHEN id % 4 = 0 THEN 'worker-3' ELSE 'worker-10' END AS shard,
           last_checked_at + CASE WHEN id % 4 = 0 THEN INTERVAL 2 DAY ELSE INTERVAL 1 DAY END AS last_checked_at FROM checked WHERE id % 2 = 0""",
)
def overlapping_shards(spark: SparkSession, d: str) -> DataFrame:
    """Two shards saw every second product at one time, a third saw some of them later: newest, then first by name."""
    stored = a.checked_parts(spark, d)
    later = lambda name, days: stored.withColumns({"shard": F.lit(name), "last_checked_at": F.col("last_checked_at") + F.make_dt_interval(F.lit(days))})
    even = (later("worker-2", 1).unionByName(later("worker-10", 1))).filter(F.col("id") % 2 == 0)
    third = later("worker-3", 2).filter(F.col("id") % 4 == 0)
    same = later("worker-0", 0)
    return merge.touched_products(stored, even.unionByName(third).unionByName(same)).select("url", "shard", "last_checked_at")


@query(
    "streaming_intervals",
    f"""WITH {ACTIVITY}, {strict('activity', 'price', 'h')}
    SELECT '{a.SHOP}' || product_id || '/' AS url, price, start_ts, end_ts FROM h""",
)
def streaming_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Events folded by a streaming query over the stored file, read back from its tables."""
    a.table(spark, d, "events")
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    url = F.concat(F.lit(a.SHOP), F.col("user_id"), F.lit("/"))
    observed = stream.select(
        url.alias("url"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        F.lit(0).alias("attempt"),
        F.lit(200).alias("status_code"),
        ((F.floor(F.col("value") / 50) + 1) * 50).cast("double").alias("price"),
        F.lit("CRC").alias("currency"),
        F.lit(True).alias("is_product"),
        F.lit(False).alias("is_challenge"),
    )
    base = scratch_dir(spark, "ingest")
    run = ingest.start_ingest(
        align_schema(observed, OBSERVATIONS), base, ["url", "observed_at"], available_now=True
    )
    run.awaitTermination()
    last = ingest.last_batch(spark, base)
    urls = ingest.products_after(spark, base, last).select(F.col("id").alias("product_id"), "url")
    return ingest.history_after(spark, base, last).join(urls, "product_id").select(
        "url", "price", "start_ts", "end_ts"
    )


