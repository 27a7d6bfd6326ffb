"""Watch lists: a table at rest, a versioned JSON document at the edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 1
_ENTRY = (
    "struct<productId:bigint,url:string,name:string,addedAt:string,priceAtAddition:double,"
    "notifyByEmail:boolean,notifyEmail:string>"
)
_DOCUMENT = f"version int, favorites map<string,{_ENTRY}>"
# Favourites in one JSON document; a longer list is spread over several.
ENTRIES_PER_DOCUMENT = 10_000


def explode_documents(documents: DataFrame, raw: str = "raw") -> DataFrame:
    """Watch-list rows of (user_id, raw JSON); unreadable or other versions give none."""
    parsed = documents.select("user_id", F.from_json(raw, _DOCUMENT).alias("_d"))
    entries = parsed.filter(F.col("_d.version") == VERSION).select(
        "user_id", F.explode("_d.favorites").alias("_key", "_e")
    )
    return entries.select(
        "user_id",
        F.coalesce("_e.productId", F.col("_key").try_cast("bigint")).alias("product_id"),
        "_e.url",
        "_e.name",
        F.try_to_timestamp("_e.addedAt").alias("added_at"),
        F.col("_e.priceAtAddition").alias("price_at_addition"),
        F.coalesce("_e.notifyByEmail", F.lit(False)).alias("notify_by_email"),
        F.coalesce("_e.notifyEmail", F.lit("")).alias("notify_email"),
    )


def to_documents(watchlist: DataFrame, entries_per_document: int = ENTRIES_PER_DOCUMENT) -> DataFrame:
    """(user_id, part, raw JSON); nearly always one part per user.

    The number of parts follows from a count that is combined before the shuffle, so no task has
    to hold more entries than fit in a few documents.
    """
    counts = watchlist.groupBy("user_id").agg(F.count("*").alias("_n"))
    parts = F.ceil(F.col("_n") / entries_per_document)
    entry = F.struct(
        F.col("product_id").alias("productId"),
        "url",
        "name",
        F.date_format("added_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("addedAt"),
        F.col("price_at_addition").alias("priceAtAddition"),
        F.col("notify_by_email").alias("notifyByEmail"),
        F.col("notify_email").alias("notifyEmail"),
    )
    keyed = F.struct(F.col("product_id").cast("string").alias("key"), entry.alias("value"))
    return (
        watchlist.join(counts, "user_id")
        .withColumn("part", F.pmod(F.xxhash64("product_id"), parts).cast("int"))
        .groupBy("user_id", "part")
        .agg(F.map_from_entries(F.collect_list(keyed)).alias("favorites"))
        .select(
            "user_id",
            "part",
            F.to_json(F.struct(F.lit(VERSION).alias("version"), "favorites")).alias("raw"),
        )
    )


def favorites_size(documents: DataFrame, raw: str = "raw") -> DataFrame:
    """(user_id, favorites) counted on the documents themselves."""
    parsed = F.from_json(raw, _DOCUMENT)
    count = F.when(parsed["version"] == VERSION, F.size(parsed["favorites"])).otherwise(0)
    return documents.select("user_id", count.alias("_n")).groupBy("user_id").agg(
        F.sum("_n").alias("favorites")
    )
