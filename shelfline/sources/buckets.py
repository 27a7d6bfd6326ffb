"""Tables that are changed bucket by bucket: a hash-bucketed, copy-on-write layout with a manifest per batch.

Rows lie in ``<base>/<table>/version=V/bucket=B``, where V is the batch that wrote the bucket last. A batch rewrites
the buckets it touches under its own number and leaves the others where they are; its manifest, one small JSON file in
``<base>/manifest/batch=V``, lists the version of every bucket and the counters of the batch. The manifest is the
commit: files of a batch without one are never read, and repeating a batch overwrites its own folders only, so a failed
or repeated batch gives the same tables. Readers name the folders of one manifest, so a table is read as of a batch.

The number of buckets is fixed when the tables are made and bounds the manifest; choose it so that a bucket is a good
unit of rewriting (some 100 MB).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 256
#: Manifests whose data are kept: the newest and the one a repeated batch starts from.
KEPT_BATCHES = 2

_ENTRY = "kind string, name string, bucket int, version long, n long"


class Manifest(NamedTuple):
    """State after a batch: buckets of each table with the batch that wrote them, and counters of the batch."""

    batch: int
    versions: dict[tuple[str, int], int]
    counters: dict[str, int]


def bucket_of(product_id: Column, buckets: int) -> Column:
    return F.pmod(product_id, F.lit(buckets)).cast("int")


def _files(spark: SparkSession, path: str):
    """(Hadoop file system, path) for anything Spark can read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def committed_batches(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the committed batches, in order; reads folder names only."""
    fs, folder = _files(spark, f"{base}/manifest")
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name.removeprefix("batch=")))
    return sorted(found)


def read_manifest(spark: SparkSession, base: str, batch: int) -> Manifest:
    """The manifest of a committed batch; batch -1 is the empty state before the first."""
    if batch < 0:
        return Manifest(-1, {}, {})
    rows = spark.read.schema(_ENTRY).json(f"{base}/manifest/batch={batch}").collect()
    return Manifest(
        batch,
        {(r["name"], r.bucket): r.version for r in rows if r.kind == "bucket"},
        {r["name"]: r.n for r in rows if r.kind == "counter"},
    )


def commit(spark: SparkSession, base: str, manifest: Manifest) -> None:
    rows = [("bucket", t, b, v, None) for (t, b), v in sorted(manifest.versions.items())]
    rows += [("counter", c, None, None, n) for c, n in sorted(manifest.counters.items())]
    made = spark.createDataFrame(rows, _ENTRY).coalesce(1)
    made.write.mode("overwrite").json(f"{base}/manifest/batch={manifest.batch}")


def read_buckets(
    spark: SparkSession, base: str, table: str, schema: T.StructType, manifest: Manifest, only: set[int] | None = None
) -> DataFrame:
    """Rows of a table as of a manifest, of all buckets or some."""
    paths = [
        f"{base}/{table}/version={v}/bucket={b}"
        for (t, b), v in sorted(manifest.versions.items())
        if t == table and (only is None or b in only)
    ]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def rewrite_buckets(df: DataFrame, base: str, table: str, key: Column, buckets: int, batch: int, touched: set[int], before: Manifest) -> dict:
    """Write the touched buckets of a table as of ``batch``; returns the versions of all its buckets.

    A large bucket is split over several files by the rebalance, small ones share a task. Buckets that became
    empty have no folder and leave the manifest.
    """
    where = f"{base}/{table}/version={batch}"
    placed = df.withColumn("bucket", bucket_of(key, buckets)).hint("rebalance", "bucket")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(where)
    kept = {(t, b): v for (t, b), v in before.versions.items() if t == table and b not in touched}
    return kept | {(table, b): batch for b in _bucket_folders(df.sparkSession, where)}


def _bucket_folders(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _files(spark, path)
    names = (s.getPath().getName() for s in fs.listStatus(folder))
    return sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))


def remove_superseded(spark: SparkSession, base: str, kept_batches: int = KEPT_BATCHES) -> int:
    """Delete buckets that none of the newest ``kept_batches`` manifests names; returns how many."""
    batches = committed_batches(spark, base)
    recent, old = batches[-kept_batches:], batches[:-kept_batches]
    if not old:
        return 0
    needed = {(t, b, v) for n in recent for (t, b), v in read_manifest(spark, base, n).versions.items()}
    gone = {(t, b, v) for (t, b), v in read_manifest(spark, base, old[-1]).versions.items()} - needed
    for t, b, v in gone:
        fs, folder = _files(spark, f"{base}/{t}/version={v}/bucket={b}")
        fs.delete(folder, True)
    return len(gone)
