"""Change sets that parallel workers left behind, one folder or file per worker."""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.schemas import HISTORY, PRODUCTS

# The path part that names a shard; anything else in the folder is passed over.
SHARD_NAME = "/(worker-[0-9]+)(?:\\.parquet)?(?:/[^/]*)?$"
#: How Spark names a file that it can't read, or that has gone.
UNREADABLE = re.compile("FAILED_READ_FILE|CANNOT_READ_FILE_FOOTER|FileNotFoundException")
LEFT_OUT = "shard string, source string, reason string"


class Shards(NamedTuple):
    """Rows of the whole shards, and (shard, source, reason) of those left out; source is the folder at fault."""

    products: DataFrame
    history: DataFrame
    left_out: DataFrame


def _files(spark: SparkSession, path: str, schema) -> dict[str, set[str]]:
    """Entries of the folder (worker-N, worker-N.parquet) by shard; an empty file, which Spark's reader passes over, counts as ''."""
    try:
        listed = spark.read.schema(schema).parquet(f"{path}/worker-*").inputFiles()
        filled = spark.read.format("binaryFile").load(f"{path}/worker-*").select("path").collect()  # names, not contents
    except AnalysisException as missing:
        raise ValueError(f"no worker shards in {path}") from missing
    entries: dict[str, set[str]] = {}
    sizes: Counter = Counter()
    for sign, names in ((1, listed), (-1, [r["path"] for r in filled])):
        for name in names:
            if found := re.search(SHARD_NAME, name):
                shard = found[1]
                sizes[shard] += sign
                entry = f"{shard}.parquet" if f"/{shard}.parquet" in found[0] else shard
                entries.setdefault(shard, set()).add(entry)
    for shard, n in sizes.items():
        if n:
            entries[shard].add("")
    return entries


def _read(spark: SparkSession, path: str, schema, entries: dict[str, set[str]], shards) -> DataFrame:
    paths = [f"{path}/{entry}" for s in sorted(shards) for entry in sorted(entries.get(s, ())) if entry]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    file = F.col("_metadata.file_path") if paths else F.lit("")
    return rows.withColumn("shard", F.regexp_extract(file, SHARD_NAME, 1)).filter(F.col("shard") != "")


def _unreadable(spark: SparkSession, path: str, schema, entries: dict[str, set[str]], shards: list[str]) -> dict[str, str]:
    """Shards with a file that can't be read to its end: all are read at once, and halves of them where that fails."""
    if not shards:
        return {}
    try:
        _read(spark, path, schema, entries, shards).write.format("noop").mode("overwrite").save()
        return {}
    except (PySparkException, Py4JJavaError) as error:
        found = UNREADABLE.search(str(error))
        if not found:
            raise
        if len(shards) == 1:
            return {shards[0]: found[0]}
    half = len(shards) // 2
    return {s: why for part in (shards[:half], shards[half:]) for s, why in _unreadable(spark, path, schema, entries, part).items()}


def read_whole_shards(spark: SparkSession, directory: str) -> Shards:
    """All shards under ``products/`` and ``price_history/`` of which every file can be read.

    A shard with an unreadable file in either folder is left out of both, so nothing is merged in part. A file that
    vanishes after it was probed is an error when the rows are used. A folder without any shard is an error.
    """
    sources = [(f"{directory}/{name}", name, schema) for name, schema in (("products", PRODUCTS), ("price_history", HISTORY))]
    held = [_files(spark, path, schema) for path, _, schema in sources]
    if not held[0]:
        raise ValueError(f"no worker shards in {directory}")
    left = []
    for (path, name, schema), entries in zip(sources, held, strict=True):
        empty = {s: "EMPTY_FILE" for s, found in entries.items() if "" in found}
        found = _unreadable(spark, path, schema, entries, sorted(entries.keys() - empty))
        left += [(s, name, why) for s, why in (empty | found).items()]
    lost = {s for s, _, _ in left}
    products, history = (
        _read(spark, path, schema, entries, entries.keys() - lost) for (path, _, schema), entries in zip(sources, held, strict=True)
    )
    return Shards(products, history, spark.createDataFrame(sorted(left), LEFT_OUT))


def read_shards(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """(products, history) of ``read_whole_shards``, which also tells what was left out."""
    whole = read_whole_shards(spark, directory)
    return whole.products, whole.history
