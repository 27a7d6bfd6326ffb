"""Stored tables and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.schemas import HISTORY, OBSERVATIONS, PAGES, PRODUCTS, align_schema

POINTER = "LATEST"


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """The product table; columns missing in older files read as NULL."""
    return spark.read.schema(PRODUCTS).parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(path)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OBSERVATIONS).parquet(path)


def write_snapshot(products: DataFrame, history: DataFrame, base: str, run_id: str) -> None:
    """Write both tables under a folder of their own, then point readers to it.

    Pointers are appended, one file per run, and the newest counts: a reader sees the old snapshot
    until the new pointer is committed, and never none. Products are laid out by their
    key, history by product and start so that row groups can be skipped by product or time.
    """
    home = f"{base}/runs/{run_id}"
    align_schema(products, PRODUCTS).write.mode("overwrite").parquet(f"{home}/products")
    (
        align_schema(history, HISTORY)
        .repartitionByRange("product_id", "start_ts")
        .sortWithinPartitions("product_id", "start_ts")
        .write.mode("overwrite")
        .parquet(f"{home}/price_history")
    )
    pointer = products.sparkSession.createDataFrame([(run_id,)], "run_id string")
    pointer = pointer.withColumn("written_at", F.current_timestamp())
    pointer.coalesce(1).write.mode("append").json(f"{base}/{POINTER}")


def latest_run(spark: SparkSession, base: str) -> str:
    pointers = spark.read.schema("run_id string, written_at timestamp").json(f"{base}/{POINTER}")
    newest = F.struct(F.coalesce("written_at", F.timestamp_seconds(F.lit(0))), "run_id")
    return pointers.agg(F.max_by("run_id", newest).alias("run_id")).first()["run_id"]


def read_snapshot(spark: SparkSession, base: str, run_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(products, history) of the latest snapshot, or of a given run."""
    home = f"{base}/runs/{run_id or latest_run(spark, base)}"
    return read_products(spark, f"{home}/products"), read_history(spark, f"{home}/price_history")
