"""Stock texts and stock JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfline.functions.prices import first_integer
from shelfline.functions.text import strip

_RAW_STOCK = "array<struct<location:string,quantity:string>>"
_STOCK = "array<struct<location:string,quantity:int>>"


def json_in_stock(stock_json: Column) -> Column:
    """True when a stock JSON array has a location with a positive quantity.

    Anything that is not an array (NULL, an object, malformed text) counts as out of stock.
    """
    rows = F.from_json(stock_json, _RAW_STOCK)
    positive = F.exists(rows, lambda r: F.coalesce(r["quantity"].try_cast("double") > 0, F.lit(False)))
    return F.coalesce(F.ltrim(stock_json).startswith("[") & positive, F.lit(False))


def in_stock(stock_locations: Column) -> Column:
    """The same test on the parsed form."""
    positive = F.exists(stock_locations, lambda r: F.coalesce(r["quantity"] > 0, F.lit(False)))
    return F.coalesce(positive, F.lit(False))


def stock_to_json(stock_locations: Column) -> Column:
    """JSON text of the locations; an empty list is stored as NULL."""
    return F.when(F.size(stock_locations) > 0, F.to_json(stock_locations))


def stock_from_json(stock_json: Column) -> Column:
    return F.when(F.ltrim(stock_json).startswith("["), F.from_json(stock_json, _STOCK))


def store_status_quantity(css_class: Column, text: Column) -> Column:
    """Units behind a store's status: none, one, the stated number, or unknown (NULL)."""
    stated = first_integer(text)
    return (
        F.when(F.contains(css_class, F.lit("status-out")), 0)
        .when(F.contains(css_class, F.lit("status-available")), 1)
        .when(F.contains(css_class, F.lit("status-limited")), F.coalesce(stated, F.lit(1)))
        .otherwise(stated)
    )


def location_and_quantity(text: Column) -> Column:
    """``"Name: 3 units"`` as struct(location, quantity); NULL for other texts."""
    pattern = "^(.+?):\\s*([0-9]+)"
    return F.when(
        text.rlike(pattern),
        F.struct(
            strip(F.regexp_extract(text, pattern, 1)).alias("location"),
            F.regexp_extract(text, pattern, 2).try_cast("int").alias("quantity"),
        ),
    )


def availability(
    stock_locations: Column, out_of_stock: Column, marked_in_stock: Column, can_add: Column
) -> Column:
    """Stock rows decide when there are any, otherwise the page's own stock markers."""
    return F.when(F.size(stock_locations) > 0, in_stock(stock_locations)).otherwise(
        ~out_of_stock & (marked_in_stock | can_add)
    )


def display_status(is_active: Column, stocked: Column) -> Column:
    """``inactive``, ``out_of_stock`` or NULL when there is nothing to flag."""
    return F.when(~is_active, "inactive").when(~stocked, "out_of_stock")
