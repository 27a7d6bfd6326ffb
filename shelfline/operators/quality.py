"""Data-quality checks and run gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.operators.intervals import open_rows

# The share from which a check fails, and the tolerated null prices of one run.
ALERT_RATIO = 0.8
NULL_PRICE_LIMIT = 50

OUTCOMES = ("priced", "null_price", "inactive", "challenge", "not_product")


def unpriced_products(products: DataFrame, history: DataFrame) -> DataFrame:
    """Active products without an open price interval."""
    priced = open_rows(history).select(F.col("product_id").alias("id"))
    return products.filter("is_active").join(priced, "id", "left_anti")


def integrity_report(
    products: DataFrame, history: DataFrame, alert_ratio: float = ALERT_RATIO
) -> DataFrame:
    """One row per check: numerator, denominator, ratio, severity and whether it failed.

    Checks the share of active products without a price, without a name, and with the most
    frequent name. Products are reduced to one row per name before anything is compared, so a
    name shared by most products is only a counter. Without active products nothing fails.
    """
    priced = open_rows(history).select(F.col("product_id").alias("id")).distinct()
    per_name = (
        products.filter("is_active")
        .select("id", "name")
        .join(priced.withColumn("_priced", F.lit(True)), "id", "left")
        .groupBy("name")
        .agg(F.count("*").alias("n"), F.count_if(F.col("_priced").isNull()).alias("unpriced"))
    )
    named = F.when(F.col("name").isNotNull(), F.struct("n", "name"))
    totals = per_name.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("unpriced"), F.lit(0)).alias("unpriced"),
        F.coalesce(F.sum(F.when(F.col("name").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"),
        F.max(named).alias("dominant"),
    )
    checks = F.array(
        F.struct(
            F.lit("no_price").alias("check"),
            F.lit("CRITICAL").alias("severity"),
            F.col("unpriced").alias("numerator"),
            F.lit(None).cast("string").alias("detail"),
        ),
        F.struct(
            F.lit("no_name").alias("check"),
            F.lit("CRITICAL").alias("severity"),
            F.col("unnamed").alias("numerator"),
            F.lit(None).cast("string").alias("detail"),
        ),
        F.struct(
            F.lit("dominant_name").alias("check"),
            F.lit("WARNING").alias("severity"),
            F.coalesce("dominant.n", F.lit(0)).cast("bigint").alias("numerator"),
            F.col("dominant.name").alias("detail"),
        ),
    )
    ratio = F.try_divide("numerator", "denominator")
    return (
        totals.select(F.col("total").alias("denominator"), F.inline(checks))
        .withColumn("ratio", ratio)
        .withColumn("failed", F.coalesce(F.col("ratio") >= alert_ratio, F.lit(False)))
        .select("check", "severity", "numerator", "denominator", "ratio", "detail", "failed")
    )


def active_count(products: DataFrame) -> DataFrame:
    return products.agg(F.count_if("is_active").alias("active"))


def last_updated(products: DataFrame) -> DataFrame:
    return products.agg(F.max("last_checked_at").alias("last_updated"))


def run_counters(classified: DataFrame) -> DataFrame:
    """Observations per outcome; processed ones are ``priced`` plus ``null_price``."""
    return classified.groupBy("outcome").agg(F.count("*").alias("n"))


def outcome_metrics() -> list[Column]:
    """Counters of settled observations, to be taken in flight by ``DataFrame.observe``."""
    counted = [F.count_if((F.col("outcome") == o) & ~F.col("is_late")).alias(o) for o in OUTCOMES]
    return [*counted, F.count_if("is_late").alias("late")]


class TooManyNullPrices(RuntimeError):
    """More products of a run came without a price than are tolerated."""


def require_prices(null_prices: int, limit: int = NULL_PRICE_LIMIT) -> None:
    if null_prices > limit:
        raise TooManyNullPrices(f"{null_prices} products without a price, {limit} are tolerated")


def null_price_gate(counters: DataFrame, limit: int = NULL_PRICE_LIMIT) -> None:
    """Raise when a run produced more null prices than tolerated (reads one counter)."""
    row = counters.filter(F.col("outcome") == "null_price").agg(F.sum("n").alias("n")).first()
    require_prices(row["n"] or 0, limit)
