"""Turning fetched pages into product observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.dates import json_ld_date, normalise_date
from shelfline.functions.prices import first_integer, parse_currency, parse_percent, parse_price
from shelfline.functions.stock import (
    availability,
    location_and_quantity,
    store_status_quantity,
)
from shelfline.functions.text import squash, strip, trim_or_null
from shelfline.functions.urls import contains_any, is_challenge_page
from shelfline.operators.page_elements import (
    BODY_WIDTH,
    MARKUP_WIDTH,
    first,
    flatten_pages,
    having,
    inside,
)
from shelfline.schemas import OBSERVATIONS, align_schema

# Where the fields of a product page are found.
PRICE_BOXES = [".summary .price", ".entry-summary .price", ".wd-single-price .price"]
AMOUNTS = [".woocommerce-Price-amount", ".amount"]
STOCK_ROWS = [
    (".wc-stock-locations", "tr"),
    (".stock-locations", "li"),
    (".atum-stock-details", "tr"),
    (".woosq-table", "tr"),
    (".store-locator-table", "tr"),
    ("table.shop_table.stock", "tr"),
]


def _amounts(inner: str = "") -> str:
    """Selector list of the price amounts, optionally inside ``ins`` or ``del``."""
    return ", ".join(f"{box} {inner} {amount}" for box in PRICE_BOXES for amount in AMOUNTS)


ROLES = {
    "product_page": (
        "body.single-product, body.woocommerce-page, .product, "
        "[itemtype=http://schema.org/Product], [itemtype=https://schema.org/Product]"
    ),
    "title": "title",
    "body": "body",
    "name": "h1.product_title, h1.entry-title",
    "sku": ".summary .sku, .entry-summary .sku, .sku",
    "category": (
        ".summary .posted_in a, .entry-summary .posted_in a, .summary .product_meta .posted_in a, "
        ".posted_in a, .product_meta .posted_in a"
    ),
    "image": ".woocommerce-product-gallery__image img",
    "description": ".woocommerce-product-details__short-description, .product-short-description",
    "badge": ".onsale, .woocommerce-badge--onsale, span.onsale",
    "summary": ".summary, .entry-summary",
    "price_box": ", ".join(PRICE_BOXES),
    "sale_amount": _amounts("ins"),
    "original_amount": _amounts("del"),
    "amount": _amounts(),
    "store": ".store-item",
    "store_name": ".store-item .store-name",
    "store_status": ".store-item .status",
    "store_text": ".store-item .status-text",
    **{f"stock_row_{n}": f"{box} {row}" for n, (box, row) in enumerate(STOCK_ROWS)},
    "cell": ", ".join(f"{box} td" for box, _ in STOCK_ROWS),
    "out_of_stock": ".stock.out-of-stock, .out-of-stock",
    "in_stock": ".stock.in-stock, .in-stock",
    "add_to_cart": "button.single_add_to_cart_button",
    "article_date": "meta[property=article:published_time]",
    "json_ld": "script[type=application/ld+json]",
    "micro_date": "[itemprop=datePublished]",
    "time": "time.published, time.entry-date",
}


def _text(elements: Column, role: str) -> Column:
    return trim_or_null(first(having(elements, role))["text"])


def _attribute(elements: Column, role: str, name: str) -> Column:
    """An attribute of the first element, an empty one counting as missing."""
    return F.nullif(F.try_element_at(first(having(elements, role))["attrs"], F.lit(name)), F.lit(""))


def _has(elements: Column, role: str) -> Column:
    return F.exists(elements, lambda e: F.array_contains(e["roles"], role))


def _all_text(elements: Column) -> Column:
    return F.concat_ws("", F.transform(elements, lambda e: e["text"]))


def _store_boxes(elements: Column) -> Column:
    """Stock by status box: (location, quantity), NULLs where a box does not tell."""

    def read(box: Column) -> Column:
        parts = inside(elements, box)
        css = F.try_element_at(first(having(parts, "store_status"))["attrs"], F.lit("class"))
        return F.struct(
            strip(_all_text(having(parts, "store_name"))).alias("location"),
            store_status_quantity(
                F.coalesce(css, F.lit("")), strip(_all_text(having(parts, "store_text")))
            ).alias("quantity"),
        )

    return F.transform(having(elements, "store"), read)


def _stock_rows(elements: Column) -> Column:
    """Stock by table row or list item: (container, location, quantity)."""
    rows = F.filter(elements, lambda e: F.exists(e["roles"], lambda r: r.startswith("stock_row")))

    def read(row: Column) -> Column:
        cells = having(inside(elements, row), "cell")
        pair = F.struct(
            strip(F.get(cells, F.lit(0))["text"]).alias("location"),
            first_integer(F.get(cells, F.lit(1))["text"]).alias("quantity"),
        )
        stock = F.when(F.size(cells) >= 2, pair).otherwise(location_and_quantity(strip(row["text"])))
        return F.transform(
            F.filter(row["roles"], lambda r: r.startswith("stock_row")),
            lambda r: F.struct(
                r.alias("container"),
                stock["location"].alias("location"),
                stock["quantity"].alias("quantity"),
            ),
        )

    return F.flatten(F.transform(rows, read))


def _complete(rows: Column) -> Column:
    return F.filter(
        rows, lambda r: r["location"].isNotNull() & (r["location"] != "") & r["quantity"].isNotNull()
    )


def _choose_stock(boxes: Column, rows: Column) -> Column:
    """The status boxes if any was readable, else the rows of the first container that has some."""
    container = F.array_min(F.transform(rows, lambda r: r["container"]))
    from_rows = F.transform(
        F.filter(rows, lambda r: r["container"] == container),
        lambda r: F.struct(r["location"].alias("location"), r["quantity"].alias("quantity")),
    )
    return F.when(F.size(boxes) > 0, boxes).otherwise(from_rows)


def published_date(elements: Column) -> Column:
    """Article meta tag, JSON-LD, microdata, then a time element; the first source present decides.

    A meta tag or microdata value that is no date ends the search, unlike a JSON-LD block.
    """
    article = _attribute(elements, "article_date", "content")
    blocks = F.transform(having(elements, "json_ld"), lambda e: e["text"])
    micro = F.coalesce(
        _attribute(elements, "micro_date", "content"), _attribute(elements, "micro_date", "datetime")
    )
    stamp = _attribute(elements, "time", "datetime")
    after_blocks = F.when(micro.isNotNull(), normalise_date(micro)).otherwise(normalise_date(stamp))
    return F.when(article.isNotNull(), normalise_date(article)).otherwise(
        F.coalesce(json_ld_date(blocks), after_blocks)
    )


def page_diagnosis(elements: Column) -> Column:
    """What a page without a readable price shows, as JSON: title, has_summary, price_markup, body_excerpt."""
    markup = F.nullif(first(having(elements, "price_box"))["markup"], F.lit(""))
    return F.to_json(
        F.struct(
            trim_or_null(_all_text(having(elements, "title"))).alias("title"),
            _has(elements, "summary").alias("has_summary"),
            squash(markup, MARKUP_WIDTH).alias("price_markup"),
            squash(first(having(elements, "body"))["text"], BODY_WIDTH).alias("body_excerpt"),
        )
    )


def extract_products(pages: DataFrame) -> DataFrame:
    """Observations of fetched pages, one per page row.

    Challenge pages, missing pages (404), failed fetches (status 0) and pages that are no products
    give an empty record. The HTML of pages that cannot be products is dropped before the Python
    step; the test for that is a plain substring search.
    """
    fetched = ~F.col("status_code").isin(0, 404)
    challenge = fetched & is_challenge_page(F.col("html"))
    # every sign of a product page contains one of these words, unless written as character codes
    plausible = contains_any(
        F.col("html"), ["product", "schema.org/Product", "woocommerce-page", "&#"]
    )
    gated = pages.select(
        "url",
        "status_code",
        F.col("fetched_at").alias("observed_at"),
        "attempt",
        (F.col("run_id") if "run_id" in pages.columns else F.lit(None).cast("string")).alias("run_id"),
        F.coalesce(challenge, F.lit(False)).alias("is_challenge"),
        F.when(fetched & ~challenge & plausible, F.col("html")).alias("html"),
    )
    e = F.col("elements")
    # Each step materialises what the next one uses more than once.
    read = flatten_pages(gated, ROLES, ("price_box",)).select(
        "*",
        _has(e, "product_page").alias("is_product"),
        first(having(e, "sale_amount"))["text"].alias("_sale"),
        first(having(e, "amount"))["text"].alias("_regular"),
        _complete(_store_boxes(e)).alias("_boxes"),
        _complete(_stock_rows(e)).alias("_rows"),
    )
    on_sale = F.col("_sale").isNotNull()
    priced = read.select(
        "*",
        strip(F.coalesce("_sale", "_regular")).alias("_raw"),
        _choose_stock(F.col("_boxes"), F.col("_rows")).alias("stock_locations"),
    ).withColumn("price", parse_price(F.col("_raw")))
    no_price = F.col("price").isNull()
    observed = priced.withColumns(
        {
            "original_price": F.when(
                on_sale & ~no_price, parse_price(first(having(e, "original_amount"))["text"])
            ),
            "currency": parse_currency(F.col("_raw")),
            "price_debug": F.when(
                no_price,
                F.when(F.col("_raw").isNull(), "no price element on the page").otherwise(
                    F.concat(
                        F.when(on_sale, "sale").otherwise("regular"),
                        F.lit(' price element without a number: "'),
                        F.col("_raw"),
                        F.lit('"'),
                    )
                ),
            ),
            "html_debug": F.when(no_price, page_diagnosis(e)),
            "name": _text(e, "name"),
            "sku": _text(e, "sku"),
            "category": _text(e, "category"),
            "description": _text(e, "description"),
            "image_url": F.coalesce(
                _attribute(e, "image", "src"), _attribute(e, "image", "data-src")
            ),
            "discount_percentage": parse_percent(first(having(e, "badge"))["text"]),
            "is_available": availability(
                F.col("stock_locations"),
                _has(e, "out_of_stock"),
                _has(e, "in_stock"),
                _has(e, "add_to_cart"),
            ),
            "published_date": published_date(e),
        }
    )
    found = {
        f.name
        for f in OBSERVATIONS.fields
        if f.name not in ("url", "observed_at", "attempt", "run_id", "status_code", "is_product", "is_challenge")
    }
    empty = {"is_available": F.lit(False), "stock_locations": F.array()}
    record = observed.select(
        *[
            F.when(F.col("is_product"), F.col(f.name))
            .otherwise(empty.get(f.name, F.lit(None)).cast(f.dataType))
            .alias(f.name)
            if f.name in found
            else F.col(f.name)
            for f in OBSERVATIONS.fields
        ]
    )
    return align_schema(record, OBSERVATIONS)


def page_text(pages: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """Trimmed text of the first element per selector, for any stored page."""
    kept = [c for c in pages.columns if c != "html"]
    return flatten_pages(pages, selectors).select(
        *kept, *[_text(F.col("elements"), name).alias(name) for name in selectors]
    )
