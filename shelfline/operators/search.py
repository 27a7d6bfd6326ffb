"""Weighted fuzzy search over product fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.text import (
    EXACT_SCORE,
    FUZZY_MAX_DISTANCE,
    FUZZY_MIN_LENGTH,
    FUZZY_SCORE,
    literal_tokens,
    split_tokens,
    token_text,
    tokenize,
)
from shelfline.session import pinned

# Field weights.
FIELD_WEIGHTS = {"name": 10, "sku": 8, "category": 5, "description": 3, "url": 2}

# Related words; not every relation is mutual.
SYNONYMS = {
    "ram": ["memoria"],
    "memoria": ["ram"],
    "ssd": ["solido", "solid", "nvme"],
    "nvme": ["ssd", "m2"],
    "hdd": ["disco", "duro"],
    "disco": ["hdd"],
    "gpu": ["grafica", "video", "tarjeta"],
    "cpu": ["procesador"],
    "procesador": ["cpu"],
    "monitor": ["pantalla", "display"],
    "pantalla": ["monitor", "display"],
    "display": ["monitor", "pantalla"],
    "teclado": ["keyboard"],
    "keyboard": ["teclado"],
    "mouse": ["raton"],
    "raton": ["mouse"],
    "laptop": ["portatil", "notebook"],
    "portatil": ["laptop", "notebook"],
    "notebook": ["laptop", "portatil"],
}

# Lengths of the substrings the search index is keyed by.
_GRAMS = (1, 2, 3, 6)

# Words, queries or matches that are sent to all tasks at most; more of them are shuffled.
SENT_ROWS = 100_000


def expand(token: str, synonyms: dict[str, list[str]] | None = None) -> list[str]:
    table = SYNONYMS if synonyms is None else synonyms
    return [token, *table.get(token, [])]


def _candidate_score(candidate: str, text: Column, tokens: Column) -> Column:
    """2, 1 or 0 for one constant candidate against one field.

    A candidate has no separators, so it lies inside some token exactly when it lies inside the
    text; only misses of long candidates look at the tokens one by one.
    """
    score = F.when(F.contains(text, F.lit(candidate)), EXACT_SCORE)
    if len(candidate) >= FUZZY_MIN_LENGTH:
        shortest, longest = len(candidate) - FUZZY_MAX_DISTANCE, len(candidate) + FUZZY_MAX_DISTANCE
        near = F.exists(
            tokens,
            lambda t: F.length(t).between(shortest, longest)
            & (F.levenshtein(t, F.lit(candidate)) <= FUZZY_MAX_DISTANCE),
        )
        score = score.when(near, FUZZY_SCORE)
    return score.otherwise(0)


def relevance(
    tokens: list[str],
    texts: dict[str, Column],
    weights: dict[str, int] | None = None,
    synonyms: dict[str, list[str]] | None = None,
) -> Column:
    """Relevance for constant query tokens; 0 unless every token matches some field.

    ``texts`` maps a weight name to the ``token_text`` of that field.
    """
    weights = FIELD_WEIGHTS if weights is None else weights
    best = []
    for token in tokens:
        scores = [
            _candidate_score(candidate, text, split_tokens(text)) * weights[field]
            for candidate in expand(token, synonyms)
            for field, text in texts.items()
        ]
        best.append(F.greatest(*scores) if len(scores) > 1 else scores[0])
    every, score = best[0] > 0, best[0]
    for b in best[1:]:
        every, score = every & (b > 0), score + b
    return F.when(every, score).otherwise(0)


def search(
    products: DataFrame,
    query: str,
    fields: dict[str, str] | None = None,
    weights: dict[str, int] | None = None,
    synonyms: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Products that match the query, with their ``score``; a narrow pass without shuffles.

    A query of nothing but separators keeps every product, with a NULL score.
    """
    fields = {f: f for f in FIELD_WEIGHTS if f in products.columns} if fields is None else fields
    tokens = literal_tokens(query)
    if not tokens:
        return products.withColumn("score", F.lit(None).cast("int"))
    # The lambda variable holds the normalised texts, so they are computed once per row, and the
    # generator drops misses without the score being evaluated again in a pushed-down filter.
    normalized = F.struct(*[token_text(F.col(c)).alias(f) for f, c in fields.items()])
    scored = F.transform(
        F.array(normalized),
        lambda n: F.struct(
            relevance(tokens, {f: n[f] for f in fields}, weights, synonyms).alias("score")
        ),
    )
    return products.select("*", F.inline(F.filter(scored, lambda s: s["score"] > 0)))


def relevance_order() -> list[Column]:
    return [F.col("score").desc()]


def _postings(products: DataFrame, key: str, fields: dict[str, str], weights: dict[str, int]) -> DataFrame:
    """(key, token, weight) for every token of every field; a narrow pass."""
    per_field = F.array(
        *[
            F.struct(tokenize(F.col(c)).alias("tokens"), F.lit(weights[f]).alias("weight"))
            for f, c in fields.items()
        ]
    )
    return products.select(key, F.inline(per_field)).select(
        key, F.explode("tokens").alias("token"), "weight"
    )


def _grams_of(token: Column, n: Column | int) -> Column:
    """Substrings of n characters, each once."""
    n = F.lit(n) if isinstance(n, int) else n
    starts = F.filter(F.sequence(F.lit(1), F.length(token)), lambda p: p + n - 1 <= F.length(token))
    return F.array_distinct(F.transform(starts, lambda p: F.substring(token, p, n)))


def _gram_size(token: Column) -> Column:
    """Characters of the substrings a search word is looked up by: the longest listed size it has."""
    sizes = F.array(*map(F.lit, sorted(_GRAMS)))
    return F.array_max(F.filter(sizes, lambda n: n <= F.length(token)))


def _one_deletion(token: Column) -> Column:
    """The token and everything it becomes when one character is dropped."""
    drop = F.transform(
        F.sequence(F.lit(1), F.length(token)),
        lambda p: F.concat(F.substring(token, F.lit(1), p - 1), F.substring(token, p + 1, F.length(token))),
    )
    return F.array_distinct(F.concat(F.array(token), drop))


def _key_of(gram: Column) -> Column:
    """32 bits stand for a substring; what meets on them is verified, so equal bits of different substrings cost pairs only."""
    return F.hash(gram).cast("long") + (1 << 31)


def _asked_grams(candidates: DataFrame) -> DataFrame:
    word = F.col("candidate")
    asked = candidates.filter("candidate <> ''").select("candidate", F.explode(_grams_of(word, _gram_size(word))).alias("gram"))
    return asked.select("candidate", _key_of(F.col("gram")).alias("gram"))


def gram_index(vocabulary: DataFrame, candidates: DataFrame) -> DataFrame:
    """(token, gram): inverted index of the substrings of the sizes that the candidates ask for.

    If the candidates are few, only of substrings that one of them asks for: the others are not shuffled.
    """
    sizes = candidates.filter("candidate <> ''").select(_gram_size(F.col("candidate")).alias("n")).distinct()
    sized = vocabulary.select("token", F.explode(F.array(*map(F.lit, _GRAMS))).alias("n")).join(F.broadcast(sizes), "n", "left_semi")
    held = sized.select("token", F.explode(_grams_of(F.col("token"), F.col("n"))).alias("gram"))
    index = held.select("token", _key_of(F.col("gram")).alias("gram"))
    asked = _asked_grams(candidates).select("gram").distinct()
    return index.join(F.broadcast(asked), "gram", "left_semi") if is_small(asked) else index


def is_small(rows: DataFrame) -> bool:
    """Whether rows are few enough to be sent to all tasks; reads no more of them than that."""
    return rows.limit(SENT_ROWS + 1).count() <= SENT_ROWS


def rarest_grams(vocabulary: DataFrame, candidates: DataFrame) -> DataFrame:
    """(candidate, gram): of the substrings of a candidate the one that the fewest tokens hold."""
    frequency = gram_index(vocabulary, candidates).groupBy("gram").agg(F.count("*").alias("tokens"))
    # frequency and key in one number, which unlike a pair is aggregated by hashing
    tokens = F.least(F.coalesce("tokens", F.lit(0)), F.lit((1 << 31) - 1))
    least = F.min(tokens * (1 << 32) + F.col("gram")) % (1 << 32)
    return _asked_grams(candidates).join(frequency.hint("merge"), "gram", "left").groupBy("candidate").agg(least.alias("gram"))


def containing(vocabulary: DataFrame, candidates: DataFrame) -> DataFrame:
    """(candidate, token) wherever a token contains a candidate that isn't empty.

    Sides that hold exploded substrings are far larger than Spark's estimate of them, so they are never broadcast.
    """
    return (
        gram_index(vocabulary, candidates)
        .join(rarest_grams(vocabulary, candidates).hint("merge"), "gram")
        .filter((F.length("token") >= F.length("candidate")) & F.contains("token", "candidate"))
        .select("candidate", "token")
    )


def match_vocabulary(vocabulary: DataFrame, candidates: DataFrame) -> DataFrame:
    """(candidate, token, score) for every candidate and vocabulary token that match.

    Containment: an inverted index from substrings to the tokens that hold them. A candidate asks for all its
    substrings of one size (longer words by longer ones), their document frequency is counted over the vocabulary,
    and the two sides meet on the candidate's rarest one only; a candidate with a substring that no token holds has no
    match and meets nothing. So a head, or an ending, that many tokens share costs no pairs unless it is all there is.
    One edit: two words are at most one edit apart only if they share a form with at most one
    character dropped. Both are equi-joins whose pairs are then verified, so no pair is missed and
    no full product of the two sides is formed.
    """
    contained = containing(vocabulary, candidates).withColumn("score", F.lit(EXACT_SCORE))
    long_enough = F.length("candidate") >= FUZZY_MIN_LENGTH
    forms = candidates.filter(long_enough).select(
        "candidate", F.explode(_one_deletion(F.col("candidate"))).alias("form")
    )
    near = (
        vocabulary.filter(F.length("token") >= FUZZY_MIN_LENGTH - FUZZY_MAX_DISTANCE)
        .select("token", F.explode(_one_deletion(F.col("token"))).alias("form"))
        .join(forms.hint("merge"), "form")
        .filter(
            (F.levenshtein("candidate", "token") <= FUZZY_MAX_DISTANCE)
            & ~F.contains("token", "candidate")
        )
        .select("candidate", "token", F.lit(FUZZY_SCORE).alias("score"))
        .distinct()
    )
    return contained.unionByName(near)


def search_many(
    products: DataFrame,
    queries: DataFrame,
    key: str = "id",
    fields: dict[str, str] | None = None,
    weights: dict[str, int] | None = None,
    synonyms: dict[str, list[str]] | None = None,
) -> DataFrame:
    """(query_id, key, score) of every product that matches every token of a query.

    ``queries`` has ``query_id`` and ``query``. Tokens of all products are reduced to a vocabulary that is matched
    against the query words; vocabulary, matches and queries are pinned. Products are dealt out by key, and each gets
    the best score of every query word it matches. A query meets only the products that match the place with the
    fewest postings, and these answer for its other places, so products that match one word of many are not spread out.
    """
    weights = FIELD_WEIGHTS if weights is None else weights
    fields = {f: f for f in FIELD_WEIGHTS if f in products.columns} if fields is None else fields
    table = SYNONYMS if synonyms is None else synonyms
    related = F.create_map(
        *[x for t, words in table.items() for x in (F.lit(t), F.array(*map(F.lit, words)))]
    ) if table else F.lit(None).cast("map<string,array<string>>")
    wanted = (
        queries.select("query_id", tokenize(F.col("query")).alias("tokens"))
        .select("query_id", F.size("tokens").alias("needed"), F.posexplode("tokens").alias("pos", "word"))
        .select(
            "query_id",
            "needed",
            "pos",
            F.explode(
                F.concat(F.array("word"), F.coalesce(F.try_element_at(related, F.col("word")), F.array().cast("array<string>")))
            ).alias("candidate"),
        )
    )
    postings = _postings(products, key, fields, weights)
    vocabulary = pinned(postings.groupBy("token").agg(F.count("*").alias("held")))
    matches = pinned(match_vocabulary(vocabulary.select("token"), wanted.select("candidate").distinct()))
    reach = matches.join(vocabulary, "token").groupBy("candidate").agg(F.sum("held").alias("reach"))
    places = wanted.join(reach, "candidate").groupBy("query_id", "needed", "pos").agg(
        F.array_sort(F.collect_set("candidate")).alias("any_of"), F.sum("reach").alias("reach")
    )
    asked = places.groupBy("query_id", "needed").agg(F.array_sort(F.collect_list(F.struct("reach", "pos", "any_of"))).alias("places"))
    asked = pinned(asked.filter(F.size("places") == F.col("needed")))

    # by number and key: every task gets its share of the products however few bytes they have
    parts = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = _postings(products.select(*dict.fromkeys([key, *fields.values()])).repartition(parts, key), key, fields, weights)
    found = (
        _meeting(spread, matches, "token")
        .groupBy(key, "candidate")
        .agg(F.max(F.col("score") * F.col("weight")).alias("best"))
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("candidate", "best"))).alias("found"))
    )
    led = asked.select("query_id", F.col("places")[0]["any_of"].alias("first"), F.col("places")["any_of"].alias("places"))
    met = _meeting(
        found.select(key, "found", F.explode(F.map_keys("found")).alias("candidate")),
        led.withColumn("candidate", F.explode("first")),
        "candidate",
    )
    # a product that matches several words of the first place counts once
    once = F.filter("first", lambda c: F.map_contains_key("found", c))[0] == F.col("candidate")
    best_of = lambda place: F.array_max(F.transform(place, lambda c: F.try_element_at("found", c)))
    score = F.aggregate(F.transform("places", best_of), F.lit(0), lambda total, best: total + best)
    return met.filter(once).select("query_id", key, score.cast("int").alias("score")).filter(F.col("score").isNotNull())


def _meeting(rows: DataFrame, others: DataFrame, on: str) -> DataFrame:
    """Inner join in which ``rows`` are never broadcast; a small other side is, and rows stay where they are."""
    return rows.join(F.broadcast(others) if is_small(others) else others.hint("merge"), on)
