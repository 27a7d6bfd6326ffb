"""Price text parsing and price arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency signs and the codes they stand for, in order of precedence.
CURRENCY_SIGNS = [("₡", "CRC"), ("$", "USD"), ("€", "EUR")]


def parse_price(raw: Column) -> Column:
    """Number in a price text, whichever of ``.`` and ``,`` is the decimal mark.

    With both marks the last one is the decimal mark. A lone comma is decimal when at most two
    digits follow the last comma; dots are grouping when every group after them has three digits.
    What remains is read up to the first character that does not fit a number.
    """
    digits = F.regexp_replace(raw, "[^0-9.,]", "")
    no_commas = F.replace(digits, F.lit(","), F.lit(""))
    no_dots = F.replace(digits, F.lit("."), F.lit(""))

    def first_comma_to_dot(text: Column) -> Column:
        return F.regexp_replace(text, "^([^,]*),", "$1.")

    has_comma = F.contains(digits, F.lit(","))
    has_dot = F.contains(digits, F.lit("."))
    plain = (
        F.when(has_comma & has_dot & digits.rlike("\\.[^,]*$"), no_commas)
        .when(has_comma & has_dot, first_comma_to_dot(no_dots))
        .when(has_comma & digits.rlike(",[0-9]{0,2}$"), first_comma_to_dot(digits))
        .when(has_comma, no_commas)
        .when(digits.rlike("^[0-9]*(\\.[0-9]{3})+$"), no_dots)
        .otherwise(digits)
    )
    number = F.regexp_extract(plain, "^([0-9]+\\.?[0-9]*|\\.[0-9]+)", 1)
    return number.try_cast("double")


def parse_currency(raw: Column) -> Column:
    (colon, crc), (dollar, usd), (euro, eur) = CURRENCY_SIGNS
    return (
        F.when(F.contains(raw, F.lit(colon)) | F.contains(F.lower(raw), F.lit("crc")), crc)
        .when(F.contains(raw, F.lit(dollar)), usd)
        .when(F.contains(raw, F.lit(euro)), eur)
    )


def first_integer(text: Column) -> Column:
    """First run of digits as an integer."""
    return F.regexp_extract(text, "([0-9]+)", 1).try_cast("int")


def parse_percent(text: Column) -> Column:
    """The number in front of a per cent sign."""
    return F.regexp_extract(text, "([0-9]+)\\s*%", 1).try_cast("int")


def round_half_up(value: Column) -> Column:
    """Round halves towards positive infinity (``-2.5`` gives ``-2``)."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def change_pct(price: Column, previous: Column) -> Column:
    """Change against the previous price in per cent.

    0 without a previous price or when it is 0; a missing current price counts as 0.
    """
    known = previous.isNotNull() & (previous != 0)
    return F.when(known, (F.coalesce(price, F.lit(0.0)) - previous) / previous * 100).otherwise(0.0)


def change_badge(price: Column, previous: Column) -> Column:
    """Struct(direction, pct) of the rounded change; NULL when it rounds to 0 or is unknown."""
    pct = round_half_up(F.abs(change_pct(price, previous)))
    direction = F.when(price < previous, "down").otherwise("up")
    return F.when(
        price.isNotNull() & previous.isNotNull() & (pct != 0),
        F.struct(direction.alias("direction"), pct.alias("pct")),
    )


def discount_pct(price: Column, original: Column) -> Column:
    """Rounded discount on the original price, NULL unless the original is higher."""
    return F.when(original > price, round_half_up((original - price) / original * 100))


def change_since(price: Column, reference: Column) -> Column:
    """Struct(direction, pct) of the change since a remembered price; NULL when nothing to show."""
    usable = price.isNotNull() & reference.isNotNull() & (reference != 0)
    # the divisor is nulled rather than tested, so a zero reference never reaches the division
    pct = round_half_up(F.abs((price - reference) / F.nullif(reference, F.lit(0.0))) * 100)
    return F.when(
        usable & (pct != 0),
        F.struct(
            F.when(price < reference, "down").otherwise("up").alias("direction"),
            pct.alias("pct"),
        ),
    )


def format_thousands(value: Column) -> Column:
    """Grouped digits with at most two decimals and no trailing zeros."""
    return F.call_function("format_number", value, F.lit("#,##0.##"))
