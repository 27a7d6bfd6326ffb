"""Merging change sets of parallel shards into the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.schemas import METADATA, history_id

# The product columns a merge copies. Publication dates are not among them.
MERGED_COLUMNS = [*METADATA, "last_checked_at", "is_active"]


def touched_products(
    products: DataFrame, deltas: DataFrame, columns: list[str] | None = None
) -> DataFrame:
    """Shard rows of known products that are strictly newer than the stored row.

    Overlapping shards are settled first: the newest row per URL wins, then the lower shard name.
    The strict comparison makes a repeated merge a no-op.
    """
    columns = MERGED_COLUMNS if columns is None else columns
    # of equally new rows the one of the alphabetically first shard is kept
    newest = deltas.groupBy("url", "last_checked_at").agg(
        F.min_by(F.struct("id", "shard", *[c for c in columns if c != "last_checked_at"]), "shard").alias("r")
    )
    newest = newest.groupBy("url").agg(
        F.max_by(F.struct("last_checked_at", "r"), "last_checked_at").alias("n")
    )
    delta = newest.select(
        "url",
        F.col("n.r.id").alias("shard_product_id"),
        F.col("n.r.shard").alias("shard"),
        F.col("n.last_checked_at").alias("last_checked_at"),
        *[F.col(f"n.r.{c}").alias(c) for c in columns if c != "last_checked_at"],
    )
    stored = products.select(
        "url", F.col("id").alias("product_id"), F.col("last_checked_at").alias("_stored")
    )
    return (
        delta.join(stored, "url")
        .filter(F.col("last_checked_at") > F.col("_stored"))
        .drop("_stored")
    )


def merged_products(
    products: DataFrame, touched: DataFrame, columns: list[str] | None = None
) -> DataFrame:
    """Stored products with the merged columns of the touched ones replaced."""
    columns = MERGED_COLUMNS if columns is None else columns
    changes = touched.select("url", F.struct(*columns).alias("_new"))
    kept = [
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
        if c in columns
        else F.col(c)
        for c in products.columns
    ]
    return products.join(changes, "url", "left").select(*kept)


def history_actions(
    history: DataFrame, delta_history: DataFrame, touched: DataFrame
) -> DataFrame:
    """What the merge does to the history of each touched product, one row per product.

    ``close``: inactive, its open interval ends at the shard's check time. ``extend``: both sides
    end in the same interval, take over the shard's end. ``insert``: close the open interval where
    the shard's newest starts and add that one. ``none``: nothing to do.
    """
    interval = F.struct("id", "start_ts")
    # a merge touches few products, so their history is picked out before anything is grouped
    concerned = history.join(touched.select("product_id"), "product_id", "left_semi")
    main = concerned.groupBy("product_id").agg(
        F.max_by(interval, F.struct("start_ts", "id")).alias("latest"),
        F.max_by(
            interval, F.when(F.col("end_ts").isNull(), F.struct("start_ts", "id"))
        ).alias("open"),
    )
    # every shard holds a full copy of the history, of which only touched products matter
    wanted = touched.select("shard", F.col("shard_product_id").alias("product_id"))
    delta_concerned = delta_history.join(wanted, ["shard", "product_id"], "left_semi")
    theirs = delta_concerned.groupBy("shard", F.col("product_id").alias("shard_product_id")).agg(
        F.max_by(
            F.struct("price", "original_price", "currency", "start_ts", "end_ts"),
            F.struct("start_ts", F.col("id")),
        ).alias("shard_latest")
    )
    has_delta = F.col("shard_latest").isNotNull()
    same_start = F.col("latest.start_ts") == F.col("shard_latest.start_ts")
    action = (
        F.when(~F.col("is_active"), F.when(F.col("open").isNotNull(), "close").otherwise("none"))
        .when(~has_delta, "none")
        .when(F.coalesce(same_start, F.lit(False)), "extend")
        .otherwise("insert")
    )
    return (
        touched.select("shard", "shard_product_id", "product_id", "is_active", "last_checked_at")
        .join(theirs, ["shard", "shard_product_id"], "left")
        .join(main, "product_id", "left")
        .withColumn("action", action)
        .select(
            "product_id",
            "shard",
            "action",
            F.when(F.col("action") == "extend", F.col("latest.id"))
            .when(F.col("action").isin("close", "insert"), F.col("open.id"))
            .alias("target_id"),
            F.when(F.col("action") == "extend", F.col("shard_latest.end_ts"))
            .when(F.col("action") == "close", F.col("last_checked_at"))
            .when(F.col("action") == "insert", F.col("shard_latest.start_ts"))
            .alias("new_end"),
            F.when(F.col("action") == "insert", F.col("shard_latest")).alias("inserted"),
        )
    )


def merged_history(history: DataFrame, actions: DataFrame) -> DataFrame:
    """Stored history with the actions applied.

    Joined on product and interval id: the hash of an interval alone may meet that of another product's,
    and with it a product with very many intervals does not gather in one task.
    """
    changes = actions.filter(F.col("target_id").isNotNull()).select(
        "product_id", F.col("target_id").alias("id"), F.col("new_end"), F.lit(True).alias("_hit")
    )
    rewritten = history.join(changes, ["product_id", "id"], "left").select(
        *[
            F.when(F.col("_hit"), F.col("new_end")).otherwise(F.col("end_ts")).alias("end_ts")
            if c == "end_ts"
            else F.col(c)
            for c in history.columns
        ]
    )
    inserted = actions.filter(F.col("action") == "insert").select(
        history_id(F.col("product_id"), F.col("inserted.start_ts")).alias("id"),
        "product_id",
        *[
            F.col(f"inserted.{c}").alias(c)
            for c in ("price", "original_price", "currency", "start_ts", "end_ts")
        ],
    )
    return rewritten.unionByName(inserted.select(*history.columns))


def merge_counts(touched: DataFrame) -> DataFrame:
    """Merged products per shard, and over all shards in the row with a NULL shard."""
    return touched.rollup("shard").agg(F.count("*").alias("merged"))

