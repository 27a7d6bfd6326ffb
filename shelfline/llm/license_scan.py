"""License scans by a positional index of rare words, in DataFrame functions only.

A template is a licence notice with mandatory key phrases, each at its place in the notice. One pass over all
documents counts how many of them hold each word of a key phrase; the two rarest words of a phrase, those of highest
inverse document frequency, become its index words. A second pass keeps the positions of index words in each file
(most words are dropped by one set lookup) and works phrase by phrase, rarest word first: positions shifted by the
word's place in the phrase are intersected, so only starts on which both words agree are left, and at those the phrase
is verified word by word. A template is found where the starts of all its key phrases, shifted by their places in the
notice, agree. Its score is the share of the notice's words that stand at their places around that point.

Nothing is shuffled but one count per index word, and nothing depends on the number of copies or on a file's
licence count: all places of all phrases are found, each row on its own.

Defined results: a null text is empty and has no words; first_word and last_word are then null, labels are empty
strings and the score is 0. Repeated rows are rows of their own, a null doc_id is kept as it is. Whole texts are
scanned; one text is one array of words. Extra columns are kept in ``_row``. An empty table gives no rows. Words tied
in frequency are taken in alphabetical order, which changes the work but no result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import ROW, carried, whole_text


class Template(NamedTuple):
    """A notice, its label, and the phrases that have to stand in it; ``base`` phrases are counted place by place."""

    label: str
    notice: str
    keys: tuple[str, ...]
    base: bool = False


# Phrases that are counted, and their labels.
BASE = (
    Template("cc-by", "cc by", ("cc by",), base=True),
    Template("gpl", "general public license", ("general public license",), base=True),
    Template("reserved", "all rights reserved", ("all rights reserved",), base=True),
)
# Opening words of public licence notices and the phrases that tell them.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "source and binary forms")),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify", "for any purpose")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy", ("permission is hereby granted", "free of charge")),
    Template("mpl", "subject to the terms of the mozilla public license", ("mozilla public license",)),
    Template("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", ("unauthorized copying", "strictly prohibited")),
    Template("public-domain", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)

#: Everything between words, once A-Z are lower-cased.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Letters outside ASCII whose lower case has an ASCII letter: Kelvin sign and dotted capital I.
_FALSE_FRIENDS = ("\u212a", "\u0130")
_INDEX_WORDS = 2


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased. Other letters may change as well, which moves no word and makes none of them ASCII."""
    only_ascii = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = ~F.contains(text, F.lit(_FALSE_FRIENDS[0])) & ~F.contains(text, F.lit(_FALSE_FRIENDS[1]))
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(only_ascii), _GAP), "")


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES) -> DataFrame:
    """``docs`` (doc_id, text) as ``_row`` with words, places of base phrases, labels and score."""
    words = carried(docs, doc_id=F.col("doc_id"), words=words_of(whole_text()))
    rare = rarest_words(words, templates)
    index = sorted({w for chosen in rare.values() for w, _ in chosen})
    # Only files that hold an index word are looked at any further, in lambdas over those positions alone.
    placed = words.withColumn("hits", _positions(F.col("words"), index))
    starts = {p: f"_start{i}" for i, p in enumerate(rare)}
    found = placed.withColumns({c: _starts(p, rare[p]) for p, c in starts.items()})
    for i, t in enumerate(templates):
        found = found.withColumn(f"_at{i}", _agreeing(t, starts))
    base = [(i, t) for i, t in enumerate(templates) if t.base]
    places = F.flatten(F.array(*[F.col(f"_at{i}") for i, _ in base])) if base else F.array().cast("array<int>")
    found = found.withColumn("_places", places).drop("hits", *starts.values())
    names = lambda chosen: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*chosen)))), ",")
    label = lambda i, t: F.when(F.size(f"_at{i}") > 0, F.lit(t.label))
    nothing = F.lit(None).cast("string")
    return found.select(
        ROW,
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"),
        F.array_max("_places").cast("long").alias("last_word"),
        names([nothing, *[label(i, t) for i, t in base]]).alias("base_labels"),
        names([nothing, *[label(i, t) for i, t in enumerate(templates)]]).alias("labels"),
        F.greatest(F.lit(0.0), F.lit(0.0), *[_share(i, t) for i, t in enumerate(templates)]).alias("score"),
    )


def rarest_words(words: DataFrame, templates: tuple[Template, ...]) -> dict[str, list[tuple[str, int]]]:
    """For each key phrase its words of highest inverse document frequency, rarest first, with their places in it."""
    phrases = sorted({p for t in templates for p in t.keys})
    vocabulary = sorted({w for p in phrases for w in p.split()})
    held = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    counted = words.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    n = {r.word: r.n for r in counted.collect()}  # at most the words of the key phrases
    out = {}
    for p in phrases:
        parts = p.split()
        chosen = sorted(set(parts), key=lambda w: (n.get(w, 0), w))[:_INDEX_WORDS]
        # A repeated word can't tell its place; phrases are verified in full, so its first place is as good as any
        # only if it stands once.
        out[p] = [(w, parts.index(w)) for w in chosen if parts.count(w) == 1] or [(parts[0], 0)]
    return out


def _positions(words: Column, index: list[str]) -> Column:
    """Positions (from 0) of index words, with the word."""
    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(index))
    return F.when(F.size(words) > 0, F.transform(at, lambda i: F.struct(F.get(words, i).alias("word"), i.alias("at")))).otherwise(
        F.array().cast("array<struct<word:string,at:int>>")
    )


def _starts(phrase: str, index: list[tuple[str, int]]) -> Column:
    """Starts of a phrase: shifted positions of its index words that agree, verified word by word."""

    def shifted_by(word: str, place: int) -> Column:
        return F.transform(F.filter("hits", lambda h: h["word"] == word), lambda h: h["at"] - place)

    shifted = [shifted_by(w, place) for w, place in index]
    common = shifted[0]
    for other in shifted[1:]:
        common = F.array_intersect(common, other)
    parts = phrase.split()
    stands = lambda s: (s >= 0) & (F.slice("words", F.greatest(s, F.lit(0)) + 1, len(parts)) == F.array(*map(F.lit, parts)))
    return F.filter(common, stands)


def _agreeing(template: Template, starts: dict[str, str]) -> Column:
    """Starts of the notice on which all its key phrases agree; may lie before the text."""
    notice = template.notice.split()
    out = None
    for p in template.keys:
        parts = p.split()
        place = next(i for i in range(len(notice)) if notice[i : i + len(parts)] == parts)
        shifted = _minus(starts[p], place)
        out = shifted if out is None else F.array_intersect(out, shifted)
    return out


def _minus(starts: str, place: int) -> Column:
    return F.transform(starts, lambda s: s - place)


def _share(i: int, template: Template) -> Column:
    """Largest share of the notice's words at their places around a found start."""
    notice = template.notice.split()
    held = lambda s: sum((F.when(F.get("words", F.greatest(s + k, F.lit(-1))) == w, 1).otherwise(0) for k, w in enumerate(notice)), F.lit(0))
    best = F.array_max(F.transform(f"_at{i}", held))
    return F.when(F.size(f"_at{i}") > 0, best / F.lit(float(len(notice)))).otherwise(0.0)
