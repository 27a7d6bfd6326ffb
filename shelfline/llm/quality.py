"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a condition that rejects a document, computed from statistics of its text. ``order_rules`` runs every
rule over a sample of at most ``SAMPLE_ROWS`` rows and notes the share it rejects and the time it adds; rules are then
tried by decreasing rejection per cost. The cascade is one conditional expression: the first rule that rejects ends
the evaluation for that row, so costly statistics are computed only for rows that passed the cheaper rules. The order
changes cost, never the verdict.

Statistics (words are runs of characters other than ASCII white space): n_words; word_chars, code points in words;
n_symbols, characters of ``#*$%&|<>``; n_lines, lines with a word; n_dup_lines, lines with a word equal to an earlier
line; n_repeat_words, words inside three-word windows that are found twice or more in the text. Windows are compared by
64-bit hash: hashes are sorted, neighbours tell the repeated ones, and their places are summed up to covered words.

Defined results: a null or empty text has no words and fails the base rules. Rows are judged on their own, so repeated
rows and ids have equal results. Statistics cover whole texts, however long. An empty table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import ROW, WHITE_SPACE, stored, whole_text

SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 1000
WINDOW_WORDS = 3
#: Up to so many different repeated windows their places are found by comparing, beyond by sorting.
FEW_REPEATS = 24


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps statistics by name to a condition; statistics it doesn't ask for are not computed for it."""

    name: str
    rejects: Callable[[Mapping[str, Column]], Column]


BASE_RULES = (
    Rule("few_words", lambda s: s["n_words"] < 50),
    Rule("repeated_words", lambda s: 100 * s["n_repeat_words"] > 50 * s["n_words"]),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda s: 10 * s["n_symbols"] > s["n_words"]),
    Rule("word_length", lambda s: (s["word_chars"] < 2 * s["n_words"]) | (s["word_chars"] > 15 * s["n_words"])),
    Rule("repeated_lines", lambda s: 100 * s["n_dup_lines"] > 50 * s["n_lines"]),
)


def words_of(text: Column) -> Column:
    """Words of a text, as an array."""
    trimmed = F.btrim(text, F.lit(WHITE_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0b\f\r]+"))


def lines_of(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WHITE_SPACE)) != "")


def _windows(words: Column) -> Column:
    """Hash of each three-word window."""
    none = F.array().cast("array<bigint>")
    places = F.sequence(F.lit(0), F.size(words) - WINDOW_WORDS)
    return F.when(F.size(words) < WINDOW_WORDS, none).otherwise(
        F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW_WORDS)]))
    )


def _repeated(ordered: Column) -> Column:
    """Different values met more than once in a sorted array."""
    return F.array_distinct(F.filter(ordered, lambda x, i: (i > 0) & (x == F.get(ordered, i - 1))))


def _places(windows: Column, repeated: Column) -> Column:
    """Places of the repeated windows, ascending."""
    places = F.sequence(F.lit(0), F.size(windows) - 1)
    compared = F.filter(places, lambda i: F.array_contains(repeated, F.get(windows, i)))

    def beside(numbered: Column) -> Column:
        """Places whose hash stands next to an equal one in order of (hash, place)."""
        hash_at = lambda j: F.get(numbered, j)["h"]
        kept = F.filter(
            places,
            lambda j: ((j > 0) & hash_at(j).eqNullSafe(hash_at(j - 1))) | hash_at(j).eqNullSafe(hash_at(j + 1)),
        )
        return F.sort_array(F.transform(kept, lambda j: F.get(numbered, j)["i"]))

    by_sorting = _let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), beside)
    return F.when(F.size(repeated) <= FEW_REPEATS, compared).otherwise(by_sorting)


def _covered(places: Column) -> Column:
    """Words in windows that start at the ascending places."""
    return F.aggregate(
        places,
        F.struct(F.lit(-WINDOW_WORDS).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW_WORDS), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once and only if the expression is."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """n_repeat_words as one expression."""

    def of(windows: Column) -> Column:
        def covered(repeated: Column) -> Column:
            return F.when(F.size(repeated) == 0, F.lit(0)).otherwise(_covered(_places(windows, repeated)))

        return _let(_let(F.sort_array(windows), _repeated), covered)

    return F.when(F.size(words) < WINDOW_WORDS, F.lit(0)).otherwise(_let(_windows(words), of)).cast("long")


def statistics(text: Column, words: Column) -> dict[str, Column]:
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines_of(text)).cast("long"),
        "n_dup_lines": _let(lines_of(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(words),
    }


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias(ROW), F.col("doc_id"), whole_text().alias("text"))


def _from_words(body: Callable[[dict[str, Column]], Column]) -> Column:
    """``body`` of the statistics by name; words are split once per row, statistics are computed where they are used."""
    return _let(words_of(F.col("text")), lambda words: body(statistics(F.col("text"), words)))


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """Rules by decreasing rejection per cost, both measured on a sample of at most ``sample_rows`` rows.

    The sample is what Spark delivers first, so no scan of the table is needed; it decides about cost only.
    """
    sample = stored(docs.select("doc_id", "text").limit(sample_rows), "rule-sample")
    rows = _texts(sample)

    def run(condition: Callable[[dict[str, Column]], Column]) -> tuple[float, float]:
        began = time.perf_counter()
        rejected, n = rows.agg(F.count_if(_from_words(condition)), F.count("*")).first()
        return time.perf_counter() - began, rejected / max(1, n)

    plain = min(run(lambda s: s["n_words"] < 0)[0] for _ in range(3))
    gain = {}
    for rule in rules:
        took, rejects = run(rule.rejects)
        gain[rule.name] = rejects / max(took - plain, 0.001)
    return tuple(sorted(rules, key=lambda r: -gain[r.name]))


def cascade(rules: tuple[Rule, ...], stats: Mapping[str, Column]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated then."""
    out = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        out = out.when(rule.rejects(stats), F.lit(rule.name))
    return out.otherwise(F.lit(None).cast("string"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept per row.

    The base rules come first, as their statistics are part of the result; the others follow in measured order.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    found = _from_words(lambda s: F.struct(*[s[n].alias(n) for n in names]))
    counted = _texts(docs).select("doc_id", found.alias("found")).select("doc_id", "found.*")
    known = {n: F.col(n) for n in names}
    base_failed = F.lit(False)
    for rule in BASE_RULES:
        base_failed = base_failed | rule.rejects(known)
    others = order_rules(docs, tuple(r for r in rules if r not in BASE_RULES))
    return counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & cascade(others, known).isNull()).alias("kept"),
    )


def keep_clean(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects; the cascade computes statistics only as far as it gets."""
    ordered = order_rules(docs, rules)
    rejected = _from_words(lambda s: cascade(ordered, s))
    return _texts(docs).filter(rejected.isNull()).select(f"{ROW}.*")
