"""Choosing the attempt that counts when a page was fetched several times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.dates import backoff_ms

# Retries after the first attempt, first wait and its growth.
MAX_RETRIES = 2
RETRY_BASE_MS = 10_000
RETRY_MULTIPLIER = 2.0


def is_retryable(is_challenge: Column, is_product: Column, price: Column) -> Column:
    """A challenge page, or a product page without a price."""
    return is_challenge | (is_product & price.isNull())


def outcome(status: Column, is_challenge: Column, is_product: Column, price: Column) -> Column:
    return (
        F.when(status == 404, "inactive")
        .when(is_challenge, "challenge")
        .when(~is_product, "not_product")
        .when(price.isNull(), "null_price")
        .otherwise("priced")
    )


def resolve_attempts(
    attempts: DataFrame,
    keys: list[str] | None = None,
    attempt: str = "attempt",
    retryable: Column | None = None,
    max_retries: int = MAX_RETRIES,
) -> DataFrame:
    """One row per key: the first attempt that needs no retry, else the last allowed one.

    Attempts count from 0. A 404 never asks for a retry because its record is empty. Written as a
    reduction, so copies of one URL are combined before the shuffle.
    """
    keys = ["url"] if keys is None else keys
    again = (
        is_retryable(F.col("is_challenge"), F.col("is_product"), F.col("price"))
        if retryable is None
        else retryable
    )
    row = F.struct(*[c for c in attempts.columns if c not in keys])
    settled = F.when(~again, F.col(attempt))
    picked = (
        attempts.filter(F.col(attempt) <= max_retries)
        .groupBy(*keys)
        .agg(F.min_by(row, settled).alias("_settled"), F.max_by(row, F.col(attempt)).alias("_last"))
    )
    return picked.select(*keys, F.coalesce("_settled", "_last").alias("_row")).select(
        *keys, "_row.*"
    )


def crawl_key(observations: DataFrame) -> Column:
    """What tells the crawls of a URL apart: the run, or the instant of a row that names none."""
    instant = F.concat(F.lit("at "), F.col("observed_at").cast("string"))
    return F.coalesce("run_id", instant) if "run_id" in observations.columns else instant


def split_unusable(
    observations: DataFrame, attempt: str = "attempt", max_retries: int = MAX_RETRIES
) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejected rows with ``reason``): no URL, no time, or an attempt beyond the allowed retries.

    A missing attempt number is the first attempt.
    """
    reason = (
        F.when(F.coalesce("url", F.lit("")) == "", "no_url")
        .when(F.col("observed_at").isNull(), "no_time")
        .when(F.col(attempt) > max_retries, "retry_limit")
    )
    usable = observations.filter(reason.isNull()).withColumn(attempt, F.coalesce(attempt, F.lit(0)))
    return usable, observations.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def classify(observations: DataFrame) -> DataFrame:
    """Adds ``outcome``: inactive, challenge, not_product, null_price or priced."""
    return observations.withColumn(
        "outcome",
        outcome(
            F.col("status_code"), F.col("is_challenge"), F.col("is_product"), F.col("price")
        ),
    )


def backoff_schedule(attempts: DataFrame, attempt: str = "attempt") -> DataFrame:
    """Adds ``wait_ms``, the pause in front of each retry (NULL for the first attempt)."""
    wait = backoff_ms(F.col(attempt), RETRY_BASE_MS, RETRY_MULTIPLIER)
    return attempts.withColumn("wait_ms", F.when(F.col(attempt) > 0, wait))
