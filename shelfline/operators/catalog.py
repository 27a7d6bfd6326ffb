"""The catalogue: current and previous price, filters, sort orders and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.dates import published_drift
from shelfline.functions.prices import change_badge, change_pct, discount_pct
from shelfline.functions.stock import display_status, in_stock
from shelfline.operators.intervals import open_rows, previous_price

# Fixed value: rows on one page.
PAGE_SIZE = 60


def _current(history: DataFrame) -> DataFrame:
    return open_rows(history).select(
        F.col("product_id").alias("id"), "price", "original_price", "currency"
    )


def active_with_price(products: DataFrame, history: DataFrame) -> DataFrame:
    """Active products with their open price, if any (more than one open interval fans out)."""
    return products.filter("is_active").join(_current(history), "id", "left")


def current_and_previous(products: DataFrame, history: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Products that have an open price, with the most recently closed one as ``prev_price``.

    ``previous`` is the view of closed prices that ingest and merges keep; with it only open rows of ``history`` are read.
    """
    known = previous_price(history) if previous is None else previous.select("product_id", "prev_price")
    previous = known.withColumnRenamed("product_id", "id")
    return products.join(_current(history), "id").join(previous, "id", "left")


def with_derived(catalog: DataFrame) -> DataFrame:
    """Adds the display columns: change, badge, discount, stock, status and date drift."""
    price, previous = F.col("price"), F.col("prev_price")
    stocked = in_stock(F.col("stock_locations"))
    return catalog.withColumns(
        {
            "change_pct": change_pct(price, previous),
            "change_badge": change_badge(price, previous),
            "discount_pct": discount_pct(price, F.col("original_price")),
            "in_stock": stocked,
            "status": display_status(F.col("is_active"), stocked),
            "published_drift": published_drift(F.col("published_first"), F.col("published_latest")),
        }
    )


def filter_catalog(
    catalog: DataFrame,
    include_inactive: bool = False,
    only_in_stock: bool = True,
    favorites: DataFrame | None = None,
) -> DataFrame:
    """Favourites, existence and stock filters; inactive products pass whatever their stock."""
    keep = F.lit(True)
    if not include_inactive:
        keep = keep & F.col("is_active")
    if only_in_stock:
        keep = keep & (~F.col("is_active") | F.col("in_stock"))
    kept = catalog.filter(keep)
    if favorites is not None:
        kept = kept.join(favorites.select(F.col("product_id").alias("id")), "id", "left_semi")
    return kept


def base_order() -> list[Column]:
    """Active first, then by name; the id makes the order total."""
    return [F.col("is_active").desc(), F.col("name").asc_nulls_first(), F.col("id").asc()]


def sort_order(sort: str | None) -> list[Column]:
    """Ordering of a named sort, the base order deciding between equal keys."""
    name = F.collate(F.coalesce("name", F.lit("")), "UNICODE")
    change = change_pct(F.col("price"), F.col("prev_price"))
    leading = {
        "name-asc": [name.asc()],
        "name-desc": [name.desc()],
        "price-asc": [F.col("price").asc_nulls_last()],
        "price-desc": [F.col("price").desc_nulls_last()],
        "discount-desc": [change.asc()],
        "increase-desc": [change.desc()],
    }
    return leading.get(sort, []) + base_order()


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page of the ordered rows; planned as a top-k, not as a full sort."""
    top = df.orderBy(*order).limit(number * size)
    return top.offset((number - 1) * size) if number > 1 else top


def total(df: DataFrame) -> DataFrame:
    """How many rows the page was taken from."""
    return df.agg(F.count("*").alias("total"))


def product_by_url(products: DataFrame, url: str) -> DataFrame:
    return products.filter(F.col("url") == url)


def product_urls(products: DataFrame) -> DataFrame:
    return products.select("url")


def history_of(products: DataFrame, history: DataFrame, url: str) -> DataFrame:
    """Price history of one URL, oldest first."""
    wanted = product_by_url(products, url).select(F.col("id").alias("product_id"))
    return history.join(wanted, "product_id", "left_semi").orderBy("start_ts")


def stale_first(products: DataFrame, limit: int, include_inactive: bool = False) -> DataFrame:
    """The ``limit`` longest unchecked products."""
    pool = products if include_inactive else products.filter("is_active")
    return pool.orderBy(F.col("last_checked_at").asc(), F.col("url").asc()).limit(limit)
