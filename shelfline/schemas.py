"""Table schemas and additive schema alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STOCK = T.ArrayType(
    T.StructType(
        [
            T.StructField("location", T.StringType()),
            T.StructField("quantity", T.IntegerType()),
        ]
    )
)

PRODUCTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("sku", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("stock_locations", STOCK),
        T.StructField("first_seen_at", T.TimestampType()),
        T.StructField("last_checked_at", T.TimestampType()),
        T.StructField("is_active", T.BooleanType()),
        T.StructField("published_first", T.DateType()),
        T.StructField("published_latest", T.DateType()),
        T.StructField("published_first_scraped_at", T.TimestampType()),
        T.StructField("published_latest_scraped_at", T.TimestampType()),
    ]
)

HISTORY = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("original_price", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("start_ts", T.TimestampType()),
        T.StructField("end_ts", T.TimestampType()),
    ]
)

#: The view of the most recently closed interval of each product (``intervals.latest_closed``).
PREVIOUS = T.StructType(
    [
        T.StructField("product_id", T.LongType()),
        T.StructField("prev_price", T.DoubleType()),
        T.StructField("closed_at", T.TimestampType()),
        T.StructField("opened_at", T.TimestampType()),
    ]
)

OBSERVATIONS = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("observed_at", T.TimestampType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("sku", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("currency", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("original_price", T.DoubleType()),
        T.StructField("discount_percentage", T.IntegerType()),
        T.StructField("stock_locations", STOCK),
        T.StructField("is_available", T.BooleanType()),
        T.StructField("is_product", T.BooleanType()),
        T.StructField("is_challenge", T.BooleanType()),
        T.StructField("published_date", T.DateType()),
        T.StructField("price_debug", T.StringType()),
        T.StructField("html_debug", T.StringType()),
        T.StructField("run_id", T.StringType()),
    ]
)

PAGES = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("attempt", T.IntegerType()),
        # the crawl a fetch belongs to; retries of one crawl share it
        T.StructField("run_id", T.StringType()),
    ]
)

SITEMAP_DOCS = T.StructType(
    [T.StructField("loc", T.StringType()), T.StructField("xml", T.StringType())]
)

WATCHLIST = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("added_at", T.TimestampType()),
        T.StructField("price_at_addition", T.DoubleType()),
        T.StructField("notify_by_email", T.BooleanType()),
        T.StructField("notify_email", T.StringType()),
    ]
)

# The metadata columns an observation overwrites on the product row.
METADATA = ["name", "sku", "category", "description", "image_url", "stock_locations"]


def epoch() -> Column:
    """The staleness marker of a product that was never checked."""
    return F.timestamp_seconds(F.lit(0))


def product_id(url: Column) -> Column:
    """Stable positive surrogate key of a product URL."""
    return F.xxhash64(url).bitwiseAND(F.lit((1 << 63) - 1))


def history_id(product: Column, start: Column) -> Column:
    """Stable surrogate key of a price interval."""
    return F.xxhash64(product, start)


def align_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: columns it lacks come back as typed NULLs."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
