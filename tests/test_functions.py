import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfline.functions import dates, prices, stock, text, urls


def apply(spark, values, fn, kind="string"):
    """Values of ``fn(column)`` for a list of inputs, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def check(spark, cases, fn, kind="string"):
    assert apply(spark, [c[0] for c in cases], fn, kind) == [c[1] for c in cases]


def test_parse_price(spark):
    cases = [
        ("₡ 99999", 99999.0), ("1,234,567", 1234567.0), ("$ 99.99", 99.99), ("1.234,56", 1234.56),
        ("1,234.56", 1234.56), ("₡ 39.900", 39900.0), ("1.234.567", 1234567.0), ("67.901", 67901.0),
        ("₡375,000 I.V.A.I", 375000.0), ("1,50", 1.5), ("1234,56", 1234.56), ("", None), ("N/A", None),
        ("1,234,5", 1.234), (".", None), (",", None), (".5", 0.5), ("5.", 5.0), ("1.5", 1.5), (None, None),
    ]
    check(spark, cases, prices.parse_price)


def test_currency_percent_integer(spark):
    check(
        spark,
        [("₡1", "CRC"), ("5 crc", "CRC"), ("$ 1", "USD"), ("1 €", "EUR"), ("₡ $", "CRC"), ("7", None)],
        prices.parse_currency,
    )
    check(spark, [("-3%", 3), ("20% OFF", 20), ("20 %", 20), ("OFERTA", None)], prices.parse_percent)
    check(spark, [("1 en stock", 1), ("hay 12 de 30", 12), ("nada", None)], prices.first_integer)


def test_rounding_goes_up_at_the_half(spark):
    cases = [(-2.5, -2), (2.5, 3), (-2.6, -3), (0.4, 0)]
    check(spark, cases, prices.round_half_up, "double")


def test_change_columns(spark):
    rows = [(90.0, 100.0), (110.0, 100.0), (100.2, 100.0), (None, 100.0), (5.0, None), (5.0, 0.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p double, q double")
    p, q = F.col("p"), F.col("q")
    out = df.select(
        "i",
        prices.change_pct(p, q).alias("pct"),
        prices.change_badge(p, q).alias("badge"),
        prices.change_since(p, q).alias("since"),
    )
    got = out.orderBy("i").collect()
    assert [round(r["pct"], 6) for r in got] == [-10.0, 10.0, 0.2, -100.0, 0.0, 0.0]
    assert [r["badge"] and tuple(r["badge"]) for r in got] == [("down", 10), ("up", 10), None, None, None, None]
    assert [r["since"] and tuple(r["since"]) for r in got] == [("down", 10), ("up", 10), None, None, None, None]
    pairs = spark.createDataFrame([(67901.0, 69900.0), (5.0, 5.0), (5.0, None)], "p double, o double")
    shown = [r[0] for r in pairs.select(prices.discount_pct(F.col("p"), F.col("o"))).collect()]
    assert shown == [3, None, None]
    check(spark, [(1234567.0, "1,234,567"), (0.5, "0.5"), (12.341, "12.34")], prices.format_thousands, "double")


def test_dates(spark):
    day = dt.date(2023, 6, 15)
    cases = [
        ("2023-06-15", day), ("2023-06-15T10:30:00+00:00", day), ("2023-06-15T10:30:00.123Z", day),
        ("2023-06-15 10:30", day), ("2023-99-99", None), ("not-a-date", None), ("2023-06-15Tnoon", None),
        ("2023-02-30", None), (None, None), ("", None),
    ]
    check(spark, cases, dates.normalise_date)
    blocks = [
        (['{"datePublished":"2023-06-15"}'], day),
        (['[{"x":1},{"dateCreated":"2023-06-15T00:00:00Z"}]'], day),
        (["{broken", '{"datePublished":"2023-06-15"}'], day),
        (['{"datePublished":"soon"}', '{"datePublished":"2023-06-15"}'], day),
        (['[{"datePublished":"soon"},{"datePublished":"2023-06-15"}]'], None),
        ([], None),
    ]
    check(spark, blocks, dates.json_ld_date, "array<string>")
    waits = apply(spark, [1, 2, 3], dates.backoff_ms, "int")
    assert waits == [10_000, 20_000, 40_000]


def test_stock(spark):
    cases = [
        (None, False), ("[]", False), ("{bad", False), ('{"quantity":2}', False),
        ('[{"location":"a","quantity":0}]', False), ('[{"location":"a","quantity":0},{"quantity":2}]', True),
        (' [{"location":"a","quantity":"3"}]', True),
    ]
    check(spark, cases, stock.json_in_stock)
    states = [
        ("status status-out", "x", 0), ("status status-available", "Disponible", 1),
        ("status status-limited", "Quedan 2", 2), ("status status-limited", "pocas", 1),
        ("status", "hay 4", 4), ("status", "?", None),
    ]
    df = spark.createDataFrame([(i, *s[:2]) for i, s in enumerate(states)], "i int, c string, t string")
    out = df.select("i", stock.store_status_quantity(F.col("c"), F.col("t")).alias("q")).orderBy("i")
    assert [r["q"] for r in out.collect()] == [s[2] for s in states]
    parsed = apply(spark, ["Alajuela: 1 en stock", "a: b: 2", "nada"], stock.location_and_quantity)
    assert [p and tuple(p) for p in parsed] == [("Alajuela", 1), ("a: b", 2), None]


def test_tokens(spark):
    cases = [
        ("Tarjeta  de\tVídeo", ["tarjeta", "de", "video"]), ("ddr4-3200/pc.x", ["ddr4", "3200", "pc", "x"]),
        ("ÑANDÚ çà", ["nandu", "ca"]), (None, []), ("--", []), ("é", ["e"]), ("İ", ["i"]),
    ]
    check(spark, cases, text.tokenize)
    for phrase, tokens in cases:
        assert text.literal_tokens(phrase) == tokens


@pytest.mark.parametrize(
    ("query", "token", "score"),
    [
        ("ddr", "ddr4", 2), ("cpu", "cpu", 2), ("procesaor", "procesador", 1), ("abce", "abcd", 0),
        ("procesadra", "procesador", 0), ("widget", "widge", 1), ("abcde", "abcdefg", 2),
    ],
)
def test_token_score(spark, query, token, score):
    row = spark.range(1).select(text.token_score(F.lit(query), F.lit(token)).alias("s")).first()
    assert row["s"] == score


def test_trimming_and_email(spark):
    check(spark, [("  a b\n", "a b"), (" \t", None), (None, None)], text.trim_or_null)
    check(spark, [("  a \n\n b c  ", "a b c")], text.squash)
    check(spark, [("  a \n\n b", "a ")], lambda c: text.squash(c, 2))
    check(spark, [("a@b.c", True), ("a@b", False), ("a b@c.d", False), ("@b.c", False)], text.valid_email)


def test_urls(spark):
    cases = [
        ("https://x/producto/a/", True), ("https://x/PRODUCT/a/", True), ("https://x/categoria/producto/", False),
        ("https://x/tag/a/", False), ("https://x/cart/", False), ("https://x/shop/product/a", False), ("https://x/", False),
    ]
    check(spark, cases, urls.is_product_url)
    pages = [
        ("<script src='https://challenges.cloudflare.com/a'>", True), ("cf-browser-verification", True),
        ("__cf_chl_f_tk=1", True), ("jschl-answer", True), ("<div class='product'>", False),
    ]
    check(spark, pages, urls.is_challenge_page)
    check(spark, [("https://x/a-2/", True), ("https://x/a-2", False), ("https://x/a2/", False)], urls.is_disambiguated)
    outcomes = [(0, "no_response"), (403, "forbidden"), (429, "throttled"), (503, "unavailable"), (200, "unrecognized"), (500, "status_500")]
    got = apply(spark, [o[0] for o in outcomes], lambda c: urls.fetch_outcome(c, F.lit("x")), "int")
    assert got == [o[1] for o in outcomes]
