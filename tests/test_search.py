import random

import pytest

from shelfline.functions.text import literal_tokens
from shelfline.operators import search as index
from shelfline.operators.search import FIELD_WEIGHTS, SYNONYMS, expand, search, search_many

FIELDS = "id bigint, name string, sku string, category string, description string, url string"
PRODUCTS = [
    (1, "Memoria RAM Corsair 32GB", "MEM01", "Memorias", None, "https://x/producto/memoria-ram-corsair/"),
    (2, "Procesador AMD Ryzen 5", "CPU1011", "Procesadores", "socket am4 ddr4", "https://x/producto/ryzen-5/"),
    (3, "Tarjeta de Vídeo RTX", "GPU-77", "Gráficas", "para monitor", "https://x/producto/rtx/"),
    (4, "Teclado mecánico", "KB.1", "Periféricos", None, "https://x/producto/teclado/"),
    (5, None, None, None, None, "https://x/producto/sin-nombre/"),
    (6, "Mouse Razer", "MS1", "Periféricos", "raton óptico", "https://x/producto/mouse-razer/"),
]
QUERIES = [
    "ram", "memoria 32gb", "procesaor", "cpu ryzen", "ddr4 32gb", "keyboard", "video", "perifericos razer",
    "MS1", "gpu", "producto", "x", "raton raton", "zzz", "tarjeta-rtx", "procesadra", "display", "--",
]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def model(product, query, synonyms=SYNONYMS):
    """Score by the written rule: best field per token, every token must match."""
    fields = dict(zip(FIELD_WEIGHTS, product[1:], strict=True))
    total = 0
    for token in literal_tokens(query):
        best = 0
        for candidate in expand(token, synonyms):
            for field, value in fields.items():
                for t in literal_tokens(value):
                    near = len(candidate) >= 5 and abs(len(candidate) - len(t)) <= 1 and edits(candidate, t) <= 1
                    score = 2 if candidate in t else 1 if near else 0
                    best = max(best, score * FIELD_WEIGHTS[field])
        if best == 0:
            return 0
        total += best
    return total


def expected(products, queries):
    return sorted(
        (q, p[0], model(p, q)) for q in queries for p in products if literal_tokens(q) and model(p, q) > 0
    )


@pytest.fixture(scope="module")
def catalogue(spark):
    return spark.createDataFrame(PRODUCTS, FIELDS)


def test_single_search_equals_the_model(catalogue):
    found = None
    for q in QUERIES[:-1]:
        hits = search(catalogue, q).selectExpr(f"'{q}' AS q", "id", "score")
        found = hits if found is None else found.unionByName(hits)
    assert sorted(map(tuple, found.collect())) == expected(PRODUCTS, QUERIES)


def test_separators_only_filter_nothing(catalogue):
    rows = search(catalogue, " -- ").collect()
    assert len(rows) == 6 and all(r["score"] is None for r in rows)


def test_search_needs_no_shuffle(catalogue):
    assert "Exchange" not in search(catalogue, "cpu ryzen")._jdf.queryExecution().executedPlan().toString()


def many(spark, products, queries):
    rows = spark.createDataFrame([(q, q) for q in queries], "query_id string, query string")
    return sorted(map(tuple, search_many(products, rows).collect()))


def test_many_searches_equal_the_model(spark, catalogue):
    assert many(spark, catalogue, QUERIES) == expected(PRODUCTS, QUERIES)


@pytest.mark.parametrize("seed", [1, 2])
def test_many_searches_on_random_words(spark, seed):
    rng = random.Random(seed)

    def word():
        return "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))

    products = [(i, f"{word()} {word()}", word(), None, f"{word()}-{word()}", word()) for i in range(60)]
    queries = sorted({" ".join(word() for _ in range(rng.randint(1, 2))) for _ in range(25)})
    assert many(spark, spark.createDataFrame(products, FIELDS), queries) == expected(products, queries)


def test_plan_has_no_cross_join(spark, catalogue):
    rows = spark.createDataFrame([("q", "cpu ryzen")], "query_id string, query string")
    plan = search_many(catalogue, rows)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_words_meet_on_their_rarest_substring(spark):
    """Codes that share head and ending: verified pairs stay within a small factor of the matches."""
    tokens = [f"code{k:05}end" for k in range(400)] + ["cod", "x"]
    asked = [f"code{k:05}end" for k in range(0, 400, 4)] + [f"{k:05}" for k in range(50)] + ["zzz", "e", "nd", "code"]
    vocabulary = spark.createDataFrame([(t,) for t in tokens], "token string")
    candidates = spark.createDataFrame([(t,) for t in asked], "candidate string")
    rows = index.match_vocabulary(vocabulary, candidates).filter("score = 2").collect()
    want = sorted((c, t) for c in asked for t in tokens if c in t)
    assert sorted((r.candidate, r.token) for r in rows) == want
    lookups = index.rarest_grams(vocabulary, candidates)
    pairs = lookups.join(index.gram_index(vocabulary, candidates), "gram").count()
    assert pairs <= 4 * len(want)


def test_places_take_the_best_related_word_and_rows_of_a_key_count_together(spark, monkeypatch):
    """Two rows of one key, repeated queries, a place with two words the product has, and both ways of joining."""
    schema = "id bigint, name string, sku string"
    products = spark.createDataFrame([(1, "ram", None), (1, "memoria", "X1"), (2, "disco", None), (None, "ram", "duro"), (4, None, None)], schema)
    queries = spark.createDataFrame([("a", "ram"), ("a", "ram"), ("b", "ram ram"), ("c", "ram duro"), ("d", None), (None, "x1")], "query_id string, query string")
    want = {("a", 1, 20), ("a", None, 20), ("b", 1, 40), ("b", None, 40), ("c", None, 36), (None, 1, 16)}
    for most in (index.SENT_ROWS, 0):
        monkeypatch.setattr(index, "SENT_ROWS", most)
        rows = [tuple(r) for r in search_many(products, queries).collect()]
        assert len(rows) == len(want) and set(rows) == want


def test_queries_meet_products_once_on_their_rarest_word(spark):
    """One word common to all products and queries; products are dealt out once, by key, and not joined by sorting."""
    products = spark.createDataFrame([(k, f"common w{k:04}{k:04}z", None) for k in range(300)], "id bigint, name string, sku string")
    queries = spark.createDataFrame([(f"common w{k:04}{k:04}z",) * 2 for k in range(0, 300, 10)], "query_id string, query string")
    found = search_many(products, queries)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    assert sorted((r.query_id, r.id) for r in found.collect()) == [(f"common w{k:04}{k:04}z", k) for k in range(0, 300, 10)]
