"""SQL fragments shared by the oracle queries (DuckDB dialect)."""

from __future__ import annotations

from shelfline.plans.adapters import MERGE_POINT, NOW, SHOP

EPOCH = "TIMESTAMP '1970-01-01 00:00:00'"
NOW_SQL = f"TIMESTAMP '{NOW}'"
MERGE_SQL = f"TIMESTAMP '{MERGE_POINT}'"

ACTIVITY = """activity AS (
  SELECT user_id AS product_id, ts AS observed_at, event_type,
         CAST((floor(value / 50) + 1) * 50 AS DOUBLE) AS price, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""

OFFERS = """offers AS (
  SELECT l_partkey + 1 AS product_id, l_shipdate AS observed_at,
         CAST(floor(min(l_quantity) / 10) * 10 + 10 AS DOUBLE) AS price,
         CASE WHEN min(l_discount) >= 0.05
              THEN CAST(floor(min(l_quantity) / 10) * 10 + 10 AS DOUBLE) * 1.25 END AS original_price
  FROM lineitem GROUP BY 1, 2)"""


def runs(
    source: str, value: str, name: str, key: str = "product_id", ts: str = "observed_at", at: str | None = None
) -> str:
    """CTEs that number the runs of equal values and the rows inside each run; ``ts`` orders, ``at`` is the time if ties follow it."""
    at = at or ts
    same = " AND ".join(f"lag({v}) OVER w IS NOT DISTINCT FROM {v}" for v in value.split(", "))
    return f"""{name}_c AS (
  SELECT *, CASE WHEN lag({at}) OVER w IS NOT NULL AND {same} THEN 0 ELSE 1 END AS chg,
         lead({at}) OVER w AS next_ts
  FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY {ts})),
{name}_r AS (SELECT *, sum(chg) OVER (PARTITION BY {key} ORDER BY {ts}) AS run FROM {name}_c),
{name}_n AS (SELECT *, row_number() OVER (PARTITION BY {key}, run ORDER BY {ts}) AS rn FROM {name}_r)"""


def strict(
    source: str, value: str, name: str, key: str = "product_id", ts: str = "observed_at", at: str | None = None
) -> str:
    return f"""{runs(source, value, name, key, ts, at)},
{name} AS (SELECT {key}, {value}, {at or ts} AS start_ts, next_ts AS end_ts FROM {name}_n WHERE rn % 2 = 1)"""


def coalesced(
    source: str, value: str, name: str, key: str = "product_id", ts: str = "observed_at", at: str | None = None
) -> str:
    return f"""{runs(source, value, name, key, ts, at)},
{name} AS (SELECT {key}, {value}, {at or ts} AS start_ts,
           lead({at or ts}) OVER (PARTITION BY {key} ORDER BY {ts}) AS end_ts
    FROM {name}_n WHERE rn = 1)"""


HISTORY = f"{OFFERS},\n{strict('offers', 'price, original_price', 'hist')}"

URL = (
    f"'{SHOP}' || replace(p_name, ' ', '-') || "
    "CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE '-x' END || p_partkey || '/'"
)
PARTS = f"""parts AS (
  SELECT p_partkey + 1 AS id, {URL} AS url, CASE WHEN p_size % 10 <> 0 THEN p_name END AS name,
         p_brand AS sku, p_type AS category, p_size > 5 AS is_active,
         p_size % 7 <> 0 AND p_size % 4 > 0 AS in_stock,
         CASE WHEN p_size % 2 = 0 THEN DATE '1998-03-01' END AS published_first,
         CASE WHEN p_size % 3 = 0 THEN DATE '1999-04-01'
              WHEN p_size % 2 = 0 THEN DATE '1998-03-01' END AS published_latest
  FROM part)"""
CHECKED = f"""{OFFERS}, {PARTS},
checked AS (
  SELECT parts.*, coalesce(last_ts, {EPOCH}) AS last_checked_at
  FROM parts LEFT JOIN (SELECT product_id, max(observed_at) AS last_ts FROM offers GROUP BY 1)
       ON product_id = id)"""
CURRENT = "cur AS (SELECT product_id, price, original_price FROM hist WHERE end_ts IS NULL)"
PREVIOUS = (
    "prev AS (SELECT product_id, arg_max(price, end_ts) AS prev_price "
    "FROM hist WHERE end_ts IS NOT NULL GROUP BY 1)"
)
CHANGE = (
    "CASE WHEN prev_price IS NOT NULL AND prev_price <> 0 "
    "THEN (coalesce(price, 0) - prev_price) / prev_price * 100 ELSE 0 END"
)
CATALOG = f"""{HISTORY}, {PARTS}, {CURRENT}, {PREVIOUS},
base AS (
  SELECT parts.*, price, original_price, prev_price, {CHANGE} AS change_pct
  FROM parts JOIN cur ON cur.product_id = id LEFT JOIN prev ON prev.product_id = id),
catalog AS (
  SELECT *,
    CASE WHEN prev_price IS NOT NULL AND floor(abs(change_pct) + 0.5) <> 0
         THEN CASE WHEN price < prev_price THEN 'down' ELSE 'up' END END AS badge_direction,
    CASE WHEN prev_price IS NOT NULL AND floor(abs(change_pct) + 0.5) <> 0
         THEN CAST(floor(abs(change_pct) + 0.5) AS BIGINT) END AS badge_pct,
    CASE WHEN original_price > price
         THEN CAST(floor((original_price - price) / original_price * 100 + 0.5) AS BIGINT) END AS discount_pct,
    CASE WHEN NOT is_active THEN 'inactive' WHEN NOT in_stock THEN 'out_of_stock' END AS status,
    published_latest IS NOT NULL AND published_first IS DISTINCT FROM published_latest AS published_drift
  FROM base)"""
BASE_ORDER = "is_active DESC, name ASC NULLS FIRST, id"
