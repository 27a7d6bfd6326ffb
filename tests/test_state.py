import random
from datetime import date, datetime, timedelta

import pytest
from simulators import fold_product

from shelfline.operators.attempts import classify, resolve_attempts
from shelfline.operators.state import GONE, UPSERT, fold_into, fold_state
from shelfline.plans.jobs import apply_observations
from shelfline.schemas import HISTORY, METADATA, OBSERVATIONS, PRODUCTS, align_schema

T0 = datetime(2024, 1, 1)
EPOCH = datetime(1970, 1, 1)


def at(n):
    return T0 + timedelta(minutes=n)


def random_events(seed, urls=40):
    rng = random.Random(seed)
    log = {}
    for u in range(urls):
        events = []
        for i in range(rng.randint(1, 7)):
            kind = rng.choice([UPSERT, UPSERT, GONE])
            name = rng.choice(["a", "b", None]) if kind == UPSERT else None
            day = rng.choice([None, date(2023, 1, 1), date(2023, 5, 5)]) if kind == UPSERT else None
            events.append((i + 1, kind, name, day))
        log[f"u{u}"] = events
    return log


def frame(spark, log):
    rows = [(u, at(ts), k, n, d) for u, events in log.items() for ts, k, n, d in events]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "url string, observed_at timestamp, kind string, name string, published_date date")
    blank = align_schema(df, OBSERVATIONS)
    return df.join(blank.drop("name", "published_date"), ["url", "observed_at"])


def found(rows):
    return {
        r["url"]: (
            r["name"], r["first_seen_at"], r["last_checked_at"], r["is_active"], r["published_first"],
            r["published_first_scraped_at"], r["published_latest"], r["published_latest_scraped_at"],
        )
        for r in rows.collect()
    }


def expected(log):
    out = {}
    for url, events in log.items():
        s = fold_product(events)
        if s is not None:
            checked = EPOCH if s["checked"] == 0 else at(s["checked"])
            out[url] = (
                s["name"], at(s["seen"]), checked, s["active"], s["first"],
                s["first_at"] and at(s["first_at"]), s["latest"], s["latest_at"] and at(s["latest_at"]),
            )
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_the_model(spark, seed):
    log = random_events(seed)
    assert found(fold_state(frame(spark, log), metadata=["name"])) == expected(log)


@pytest.mark.parametrize("cut", [2, 4])
def test_fold_in_two_batches_equals_one(spark, cut):
    log = random_events(3)
    early = {u: [e for e in events if e[0] <= cut] for u, events in log.items()}
    late = {u: [e for e in events if e[0] > cut] for u, events in log.items()}
    first = fold_into(spark.createDataFrame([], PRODUCTS), frame(spark, early))
    assert found(fold_into(first, frame(spark, late))) == expected(log)


def observation(url, ts, attempt=0, status=200, price=None, product=True, challenge=False, name="n"):
    row = dict.fromkeys(OBSERVATIONS.names)
    row.update(
        url=url, observed_at=at(ts), attempt=attempt, status_code=status, price=price, currency="CRC",
        name=name, is_product=product, is_challenge=challenge, stock_locations=[], is_available=True,
    )
    return row


def observations(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in OBSERVATIONS.names) for r in rows], OBSERVATIONS)


def test_attempts_and_outcomes(spark):
    rows = [
        observation("retried", 1, 0), observation("retried", 2, 1, price=5.0), observation("retried", 3, 2, price=6.0),
        observation("never", 1, 0), observation("never", 2, 1), observation("never", 3, 2), observation("never", 4, 3, price=1.0),
        observation("gone", 1, 0, product=False, challenge=True), observation("gone", 2, 1, status=404, product=False),
        observation("gone", 3, 2, price=1.0),
        observation("blocked", 1, 0, product=False, challenge=True),
        observation("page", 1, 0, product=False), observation("page", 2, 1, price=1.0),
    ]
    out = classify(resolve_attempts(observations(spark, rows)))
    got = {r["url"]: (r["attempt"], r["outcome"]) for r in out.collect()}
    assert got == {
        "retried": (1, "priced"), "never": (2, "null_price"), "gone": (1, "inactive"),
        "blocked": (0, "challenge"), "page": (0, "not_product"),
    }


def test_job_folds_state_and_history(spark):
    products = spark.createDataFrame([], PRODUCTS)
    history = spark.createDataFrame([], HISTORY)
    first = observations(
        spark,
        [
            observation("a", 1, price=10.0), observation("b", 1), observation("c", 1, status=404, product=False),
            observation("d", 1, product=False, challenge=True), observation("e", 1, product=False),
        ],
    )
    one = apply_observations(products, history, first)
    state = {r["url"]: (r["last_checked_at"], r["is_active"]) for r in one.products.collect()}
    assert state == {"a": (EPOCH, True), "b": (EPOCH, True)}
    assert {r["outcome"]: r["n"] for r in one.counters.collect()} == dict.fromkeys(
        ["priced", "null_price", "inactive", "challenge", "not_product"], 1
    )
    second = observations(
        spark, [observation("a", 5, price=12.0, name=None), observation("b", 5, status=404, product=False, name=None)]
    )
    two = apply_observations(one.products, one.history, second)
    state = {r["url"]: (r["last_checked_at"], r["is_active"], r["name"]) for r in two.products.collect()}
    assert state == {"a": (at(5), True, None), "b": (at(5), False, "n")}
    prices = sorted((r["price"] or 0, r["start_ts"], r["end_ts"]) for r in two.history.collect())
    assert prices == [(0, at(1), None), (10.0, at(1), at(5)), (12.0, at(5), None)]
    # rows that are not newer than the stored check change nothing
    again = apply_observations(two.products, two.history, second)
    assert sorted(map(str, again.history.collect())) == sorted(map(str, two.history.collect()))
    assert sorted(map(str, again.products.collect())) == sorted(map(str, two.products.collect()))
    assert METADATA[0] == "name"


def test_late_and_repeated_observations_open_no_second_interval(spark):
    """A first observation sent again, and an older one, change nothing; two crawls of one batch are both kept."""
    from datetime import datetime

    from shelfline import schemas
    from shelfline.plans import jobs

    def batch(*rows):
        fields = "url string, observed_at timestamp, attempt int, status_code int, name string, price double, currency string, " \
                 "original_price double, is_product boolean, is_challenge boolean, published_date date"
        rows = spark.createDataFrame([(u, datetime(2024, 1, d), 0, 200, "n", p, "EUR", None, True, False, None) for u, d, p in rows], fields)
        return schemas.align_schema(rows, schemas.OBSERVATIONS)

    products, history = spark.createDataFrame([], schemas.PRODUCTS), spark.createDataFrame([], schemas.HISTORY)
    first = jobs.apply_observations(products, history, batch(("u", 10, 5.0), ("v", 1, 5.0), ("v", 2, 7.0)))
    assert sorted(r.price for r in first[1].collect()) == [5.0, 5.0, 7.0]
    again = jobs.apply_observations(first[0], first[1], batch(("u", 10, 5.0), ("u", 5, 9.0)))
    opened = again[1].filter("end_ts IS NULL").groupBy("product_id").count().collect()
    assert [r["count"] for r in opened] == [1, 1]
    assert again[1].count() == 3
