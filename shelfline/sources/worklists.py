"""Lists of URLs to work on: literal overrides, chunk files and the stale-first default."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions.text import strip


def override_urls(spark: SparkSession, override: str) -> DataFrame:
    """URLs of a comma-separated text, trimmed, blanks dropped."""
    parts = spark.range(1).select(F.explode(F.split(F.lit(override), ",")).alias("url"))
    return parts.select(strip(F.col("url")).alias("url")).filter("url <> ''")


def read_chunk(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("url string").json(path)


def choose_urls(
    spark: SparkSession, default: DataFrame, override: str | None = None, chunk_path: str | None = None
) -> DataFrame:
    """An override wins over a chunk file, a chunk file over the default list."""
    if override:
        return override_urls(spark, override)
    if chunk_path:
        return read_chunk(spark, chunk_path)
    return default.select("url")


def write_chunks(planned: DataFrame, path: str) -> None:
    """One folder of JSON lines per chunk."""
    planned.select("url", "chunk").write.mode("overwrite").partitionBy("chunk").json(path)
