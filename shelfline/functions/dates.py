"""Date text handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Clock part that may follow a date: hours and minutes, optional seconds, fraction and offset.
_CLOCK = (
    "^(?:[T ](?:(?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\\.[0-9]+)?)?|24:00(?::00(?:\\.0+)?)?)"
    "\\s*(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
)


def normalise_date(raw: Column) -> Column:
    """Leading ``YYYY-MM-DD`` of a date or timestamp text, NULL unless the whole text is a date."""
    day = F.regexp_extract(raw, "^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return F.when(F.substr(raw, F.lit(11)).rlike(_CLOCK), F.try_to_date(day, "yyyy-MM-dd"))


def json_ld_date(blocks: Column) -> Column:
    """First usable publication date over an array of JSON-LD texts.

    In each block (an object or an array of objects) the first entry that carries
    ``datePublished`` or ``dateCreated`` decides; malformed blocks are passed over.
    """

    def block_date(block: Column) -> Column:
        parsed = F.try_parse_json(block)
        entries = F.when(
            F.ltrim(block).startswith("["), F.try_variant_get(parsed, "$", "array<variant>")
        ).otherwise(F.array(parsed))
        dates = F.transform(
            entries,
            lambda e: F.coalesce(
                F.nullif(F.try_variant_get(e, "$.datePublished", "string"), F.lit("")),
                F.nullif(F.try_variant_get(e, "$.dateCreated", "string"), F.lit("")),
            ),
        )
        return normalise_date(F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0)))

    return F.get(F.filter(F.transform(blocks, block_date), lambda d: d.isNotNull()), F.lit(0))


def days_before(now: Column, days: int) -> Column:
    return now - F.make_dt_interval(F.lit(days))


def other_day(a: Column, b: Column) -> Column:
    """True when two instants fall on different calendar days of the session time zone."""
    return F.to_date(a) != F.to_date(b)


def published_drift(first: Column, latest: Column) -> Column:
    """True when the site changed the publication date after it was first seen."""
    return latest.isNotNull() & ~first.eqNullSafe(latest)


def short_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def backoff_ms(attempt: Column, base_ms: int = 10_000, multiplier: float = 2.0) -> Column:
    """Waiting time in front of retry number ``attempt`` (1, 2, ...)."""
    return (F.lit(base_ms) * F.pow(F.lit(multiplier), attempt - 1)).cast("bigint")
