"""Runs registered queries against their oracle SQL in DuckDB and compares the rows."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, Decimal):
        return repr(float(v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir) -> tuple[bool, str]:
    started = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - started
    if sql is None:
        return True, f"{name}: {len(got)} rows in {took:.1f}s (no oracle)"
    con.execute(sql)
    columns = [c[0] for c in con.description]
    want = rows_of(columns, con.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} against {sorted(columns)}"
    if got != want:
        only_got = list(set(got) - set(want))[:3]
        only_want = list(set(want) - set(got))[:3]
        return False, (
            f"{name}: {len(got)} rows against {len(want)}; columns {sorted(columns)}\n"
            f"   only ours:   {only_got}\n   only oracle: {only_want}"
        )
    return True, f"{name}: {len(got)} rows in {took:.1f}s"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from __spark_entry__ import oracle_sql, queries

    from shelfline.session import build_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    session = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = oracle_sql()
    bad = []
    for name, fn in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, text = compare(session, con, name, fn, oracles.get(name), sf)
        except Exception as problem:  # report and go on with the next query
            ok, text = False, f"{name}: {type(problem).__name__}: {str(problem)[:600]}"
        print("ok  " if ok else "BAD ", text, flush=True)
        if not ok:
            bad.append(name)
    print("bad:", bad)
