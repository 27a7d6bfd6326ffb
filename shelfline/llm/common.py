"""Helpers shared by the operators of this subpackage.

Operators pack the rows they are given into one struct column and add their own columns beside it, so columns
of the input never clash with theirs and extra columns are carried through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.session import scratch_dir

ROW = "_row"
WHITE_SPACE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def carried(docs: DataFrame, **columns: Column) -> DataFrame:
    """The input rows as struct ``_row`` and new columns computed from them."""
    return docs.select(F.struct("*").alias(ROW), *[c.alias(name) for name, c in columns.items()])


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read again."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))
