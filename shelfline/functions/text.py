"""Text normalisation, tokens and token scores."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space characters of an ECMAScript regular expression.
WHITESPACE = (
    "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
)
# The block of combining marks that is dropped.
COMBINING_MARKS = ("\u0300", "\u036f")

FUZZY_MIN_LENGTH = 5
FUZZY_MAX_DISTANCE = 1
EXACT_SCORE = 2
FUZZY_SCORE = 1

# Separators of tokens: any white space, hyphens, slashes and dots.
_SEPARATORS = f"[{WHITESPACE}\\-/.]+"
_ASCII_SEPARATORS = "[\\t-\\r \\-/.]+"


def _is_mark(char: str) -> bool:
    return COMBINING_MARKS[0] <= char <= COMBINING_MARKS[1]


def _accent_table() -> tuple[str, str]:
    """Characters whose decomposition is one base character plus dropped marks."""
    accented, plain = [], []
    for code in range(0x80, 0x20000):
        char = chr(code)
        base = [c for c in unicodedata.normalize("NFD", char) if not _is_mark(c)]
        if len(base) == 1 and base[0] != char:
            accented.append(char)
            plain.append(base[0])
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _accent_table()
_MARKS = "".join(map(chr, range(ord(COMBINING_MARKS[0]), ord(COMBINING_MARKS[1]) + 1)))
_FOLDING = str.maketrans(ACCENTED, PLAIN, _MARKS)
_WIDE_SPACES = "".join(
    c for c in map(chr, [*range(0xA0, 0x3001), 0xFEFF]) if re.match(f"[{WHITESPACE}]", c)
)


def _folded(text: Column, mapped: str, to: str) -> Column:
    """Lower case, then one pass that maps characters and deletes those without a counterpart.

    Plain ASCII has nothing to map and skips the pass.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.when(lowered.rlike("[^\\x00-\\x7F]"), F.translate(lowered, mapped, to)).otherwise(lowered)


def normalize_text(text: Column) -> Column:
    """Lower case without accents; NULL becomes the empty string."""
    return _folded(text, ACCENTED + _MARKS, PLAIN)


def token_text(text: Column) -> Column:
    """Normalised text in which every wide white-space character is a blank.

    Tokens can then be cut at a handful of ASCII characters, which is much cheaper to match.
    """
    return _folded(text, ACCENTED + _WIDE_SPACES + _MARKS, PLAIN + " " * len(_WIDE_SPACES))


def split_tokens(prepared: Column) -> Column:
    """Tokens of a ``token_text``, cut at white space, hyphens, slashes and dots."""
    return F.array_remove(F.split(prepared, _ASCII_SEPARATORS), "")


def tokenize(text: Column) -> Column:
    return split_tokens(token_text(text))


def literal_tokens(text: str | None) -> list[str]:
    """The same tokens for one literal search phrase, so they fold into the plan as constants."""
    folded = (text or "").lower().translate(_FOLDING)
    return [t for t in re.split(_SEPARATORS, folded) if t]


def token_score(query: Column, token: Column) -> Column:
    """2 when the token contains the query, 1 when it is one edit away from a long query, else 0."""
    close = (F.length(query) >= FUZZY_MIN_LENGTH) & (
        F.abs(F.length(query) - F.length(token)) <= FUZZY_MAX_DISTANCE
    )
    return (
        F.when(F.contains(token, query), EXACT_SCORE)
        .when(close & (F.levenshtein(query, token) <= FUZZY_MAX_DISTANCE), FUZZY_SCORE)
        .otherwise(0)
    )


def field_score(query: Column, tokens: Column) -> Column:
    """Best token score over a field; an empty or NULL field scores 0."""
    return F.coalesce(F.array_max(F.transform(tokens, lambda t: token_score(query, t))), F.lit(0))


def trim_or_null(text: Column) -> Column:
    """Strip white space at both ends (no-break space included); empty becomes NULL."""
    return F.nullif(strip(text), F.lit(""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")


def squash(text: Column, width: int | None = None) -> Column:
    """White-space runs become one blank, the ends are stripped; optionally cut to ``width``."""
    squashed = strip(F.regexp_replace(text, f"[{WHITESPACE}]+", " "))
    return squashed if width is None else F.left(squashed, F.lit(width))


def valid_email(text: Column) -> Column:
    return text.rlike(f"^[^{WHITESPACE}@]+@[^{WHITESPACE}@]+\\.[^{WHITESPACE}@]+$")
