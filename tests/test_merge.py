import copy
import random
from datetime import datetime, timedelta

from simulators import merge_shards

from shelfline.plans.jobs import merge_deltas
from shelfline.schemas import HISTORY, PRODUCTS, align_schema

T0 = datetime(2024, 1, 1)


def at(n):
    return None if n is None else T0 + timedelta(minutes=n)


def product_frame(spark, products, ids, shard=None):
    rows = [(ids[u], u, p["name"], at(p["checked"]), p["active"]) for u, p in products.items()]
    df = spark.createDataFrame(rows, "id bigint, url string, name string, last_checked_at timestamp, is_active boolean")
    return align_schema(df, PRODUCTS) if shard is None else align_schema(df, PRODUCTS).selectExpr("*", f"'{shard}' AS shard")


def history_frame(spark, history, ids, shard=None):
    rows = [
        (ids[u] * 1000 + i, ids[u], h[0], None, "CRC", at(h[1]), at(h[2]))
        for u, intervals in history.items()
        for i, h in enumerate(intervals)
    ]
    df = spark.createDataFrame(rows, HISTORY)
    return df if shard is None else df.selectExpr("*", f"'{shard}' AS shard")


def run(spark, products, history, shards, ids):
    union = None
    for n, (p, h) in enumerate(shards):
        pair = (product_frame(spark, p, ids, f"worker-{n}"), history_frame(spark, h, ids, f"worker-{n}"))
        union = pair if union is None else tuple(a.unionByName(b) for a, b in zip(union, pair, strict=True))
    return merge_deltas(product_frame(spark, products, ids), history_frame(spark, history, ids), *union)


def state(rows):
    return {r["url"]: (r["name"], r["last_checked_at"], r["is_active"]) for r in rows.collect()}


def intervals(rows, ids):
    urls = {i: u for u, i in ids.items()}
    return sorted((urls[r["product_id"]], r["price"], r["start_ts"], str(r["end_ts"])) for r in rows.collect())


def expect(products, history):
    return (
        {u: (p["name"], at(p["checked"]), p["active"]) for u, p in products.items()},
        sorted((u, h[0], at(h[1]), str(at(h[2]))) for u, hs in history.items() for h in hs),
    )


def test_merge_equals_the_model_and_repeats_safely(spark):
    rng = random.Random(5)
    ids = {f"u{i:03d}": i + 1 for i in range(90)}
    products, history = {}, {}
    for u in ids:
        products[u] = {"checked": 100, "active": True, "name": "main"}
        starts = sorted(rng.sample(range(90), rng.randint(0, 3)))
        history[u] = [[float(rng.randint(1, 3)), s, e] for s, e in zip(starts, [*starts[1:], rng.choice([None, 95])], strict=False)]
    shards = []
    for n in range(3):
        mine = {u for i, u in enumerate(ids) if i % 3 == n}
        p, h = copy.deepcopy({u: products[u] for u in mine}), copy.deepcopy({u: history[u] for u in mine})
        for u in mine:
            kind = rng.choice(["untouched", "same", "changed", "gone"])
            if kind == "untouched":
                continue
            p[u].update(checked=200, name=f"shard{n}", active=kind != "gone")
            if kind == "same" and h[u]:
                h[u][-1][2] = 200
            elif kind == "changed":
                if h[u] and h[u][-1][2] is None:
                    h[u][-1][2] = 200
                h[u].append([9.0, 200, None])
        p[f"new{n}"] = {"checked": 300, "active": True, "name": "unknown"}
        h[f"new{n}"] = []
        shards.append((p, h))
    known = {**ids, **{f"new{n}": 900 + n for n in range(3)}}
    merged = run(spark, products, history, shards, known)
    want = expect(*merge_shards(copy.deepcopy(products), copy.deepcopy(history), copy.deepcopy(shards)))
    assert (state(merged.products), intervals(merged.history, known)) == want
    counts = {r["shard"]: r["merged"] for r in merged.counts.collect()}
    assert counts[None] == sum(v for k, v in counts.items() if k) > 0

    deltas = [
        (product_frame(spark, p, known, f"worker-{n}"), history_frame(spark, h, known, f"worker-{n}"))
        for n, (p, h) in enumerate(shards)
    ]
    again = merge_deltas(merged.products, merged.history, deltas[0][0], deltas[0][1])
    assert (state(again.products), intervals(again.history, known)) == want


def test_overlapping_shards_newest_wins(spark):
    ids = {"a": 1}
    products = {"a": {"checked": 1, "active": True, "name": "main"}}
    history = {"a": [[5.0, 0, None]]}
    older = ({"a": {"checked": 10, "active": True, "name": "old"}}, {"a": [[5.0, 0, 10], [6.0, 10, None]]})
    newer = ({"a": {"checked": 20, "active": True, "name": "new"}}, {"a": [[5.0, 0, 20], [7.0, 20, None]]})
    merged = run(spark, products, history, [older, newer], ids)
    assert state(merged.products)["a"][0] == "new"
    assert intervals(merged.history, ids) == [("a", 5.0, at(0), str(at(20))), ("a", 7.0, at(20), "None")]
