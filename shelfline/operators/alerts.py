"""Watch lists joined with the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.prices import change_since
from shelfline.functions.text import valid_email

# Fixed value: name shown for a product without one.
UNKNOWN_NAME = "(Producto desconocido)"


def shown_name() -> Column:
    return F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit(UNKNOWN_NAME))


def add_favorites(watchlist: DataFrame, products: DataFrame, user_id: Column, now: Column) -> DataFrame:
    """Watch-list rows with the given catalogue products added or replaced."""
    added = products.select(
        user_id.alias("user_id"),
        F.col("id").alias("product_id"),
        "url",
        shown_name().alias("name"),
        now.alias("added_at"),
        F.col("price").alias("price_at_addition"),
        F.lit(False).alias("notify_by_email"),
        F.lit("").alias("notify_email"),
    )
    kept = watchlist.join(added.select("user_id", "product_id"), ["user_id", "product_id"], "left_anti")
    return kept.unionByName(added)


def remove_favorites(watchlist: DataFrame, removed: DataFrame) -> DataFrame:
    """Watch-list rows without the (user_id, product_id) pairs given."""
    return watchlist.join(removed, ["user_id", "product_id"], "left_anti")


def request_alerts(watchlist: DataFrame, requests: DataFrame) -> DataFrame:
    """Switch on e-mail alerts for (user_id, product_id, email) requests."""
    asked = requests.select("user_id", "product_id", F.col("email").alias("_email"))
    on = F.col("_email").isNotNull()
    return watchlist.join(asked, ["user_id", "product_id"], "left").select(
        *[
            F.when(on, F.lit(True)).otherwise(F.col(c)).alias(c)
            if c == "notify_by_email"
            else F.coalesce("_email", c).alias(c)
            if c == "notify_email"
            else F.col(c)
            for c in watchlist.columns
        ]
    )


def favorite_counts(watchlist: DataFrame) -> DataFrame:
    return watchlist.groupBy("user_id").agg(F.count("*").alias("favorites"))


def change_since_added(watchlist: DataFrame, catalog: DataFrame) -> DataFrame:
    """Watch-list rows with the current price and its change since the product was added."""
    current = catalog.select(F.col("id").alias("product_id"), "price")
    return watchlist.join(current, "product_id").withColumn(
        "change_since", change_since(F.col("price"), F.col("price_at_addition"))
    )


def price_alerts(watchlist: DataFrame, catalog: DataFrame) -> DataFrame:
    """What an alert would say, for entries that ask for one and have a valid address."""
    wanted = watchlist.filter(F.col("notify_by_email") & valid_email(F.col("notify_email")))
    current = catalog.select(
        F.col("id").alias("product_id"),
        shown_name().alias("product_name"),
        F.col("url").alias("product_url"),
        F.col("price").alias("current_price"),
    )
    return wanted.select("user_id", "product_id", "notify_email", "price_at_addition").join(
        current, "product_id"
    ).select(
        "user_id",
        "product_id",
        F.col("notify_email").alias("to_email"),
        "product_name",
        "product_url",
        "current_price",
        F.coalesce("price_at_addition", "current_price").alias("price_at_addition"),
    )
