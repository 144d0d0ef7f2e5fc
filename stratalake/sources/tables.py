"""Reading and replacing landed files and tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType



def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, is_pdf, bytes, sha256) of the files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def id_from_filename(path: Column) -> Column:
    """What stands before the first ``__`` of the file name."""
    return F.split(F.element_at(F.split(path, "/"), -1), "__")[0]


def write_edges(edges: DataFrame, path: str) -> None:
    """Edges as Parquet, one folder per type, each file in order of src and dst."""
    edges.repartitionByRange("edge_type", "src", "dst").sortWithinPartitions("edge_type", "src", "dst").write.mode("overwrite").partitionBy("edge_type").parquet(path)


def replace_keys(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with all rows of the keys that ``new`` has replaced by ``new``'s."""
    return table.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def _files(spark: SparkSession, path: str):
    """Hadoop's path of ``path`` and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifest(spark: SparkSession, path: str) -> dict:
    """The newest manifest of a table: version, number of buckets, folder of each full bucket, last batch of each stream."""
    home, fs = _files(spark, f"{path}/_manifests")
    if not fs.exists(home):
        return {"version": 0, "count": 0, "buckets": {}, "batches": {}}
    newest = max(f.getPath().getName() for f in fs.listStatus(home) if f.getPath().getName().endswith(".json"))
    stream = fs.open(_files(spark, f"{path}/_manifests/{newest}")[0])
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, state: dict) -> None:
    """Make ``state`` the newest manifest by one rename; a version that another writer has made is an error."""
    draft, fs = _files(spark, f"{path}/_manifests/draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    final = _files(spark, f"{path}/_manifests/{state['version']:012d}.json")[0]
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"another writer has replaced version {state['version']} of {path}")


def _clean(spark: SparkSession, path: str, state: dict) -> None:
    """Delete what neither this version nor the one before it, which readers may have open, refers to."""
    home, fs = _files(spark, f"{path}/_manifests")
    older = sorted(f.getPath().getName() for f in fs.listStatus(home))
    for name in older:
        if name.endswith(".json") and int(name[:-5]) < state["version"] - 1:
            fs.delete(_files(spark, f"{path}/_manifests/{name}")[0], False)
    kept = {folder.split("/")[1] for folder in state["buckets"].values()} | set(state.get("before", []))
    for folder in fs.listStatus(_files(spark, f"{path}/data")[0]):
        if folder.getPath().getName() not in kept:
            fs.delete(folder.getPath(), True)


def replace_on_disk(rows: DataFrame, keys: DataFrame, path: str, key: str, buckets: int = 64, most_bytes: int = 256 << 20, batch: tuple[str, int] | None = None) -> None:
    """Replace in the table at ``path`` all rows of ``keys`` (one column, called ``key``) by ``rows``; a key without rows is emptied.

    The table lies in buckets by a hash of the key, and only buckets that a key falls into are read and written anew, into a folder of
    their own.  A manifest names the folder of each bucket; a new one, put in place by one rename at the end, is what replaces the table.
    So whoever reads sees the old table or the new one, and a job that fails in between leaves the old one.
    Buckets of over ``most_bytes`` on average are split in two by the next replacement.  ``batch``: name and number of a stream's batch; one that the
    manifest already holds does nothing.  One writer at a time: a second one fails at its commit.
    """
    spark, state = rows.sparkSession, _manifest(rows.sparkSession, path)
    if batch is not None and state["batches"].get(batch[0], -1) >= batch[1]:
        return
    count, full = state["count"] or buckets, state["buckets"]
    split = bool(full) and sum(_files(spark, f"{path}/{f}")[1].getContentSummary(_files(spark, f"{path}/{f}")[0]).getLength() for f in full.values()) > most_bytes * count
    count *= 2 if split else 1
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(count)).cast("int")
    # numbers below ``count``
    touched = set(range(count)) if split else {r[0] for r in keys.select(bucket.alias("b")).distinct().collect()}
    read = sorted(set(full.values())) if split else [full[str(b)] for b in touched if str(b) in full]
    new = rows
    if read:
        old = spark.read.schema(rows.schema).parquet(*[f"{path}/{folder}" for folder in read])
        new = old.join(keys.select(key).distinct(), key, "left_anti").select(*rows.columns).unionByName(rows)
    folder = f"data/{uuid.uuid4().hex}"
    new.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    at, fs = _files(spark, f"{path}/{folder}")
    made = {name.split("=")[1]: f"{folder}/{name}" for f in fs.listStatus(at) for name in [f.getPath().getName()] if name.startswith("_bucket=")}
    kept = {b: f for b, f in full.items() if not split and int(b) not in touched}
    batches = state["batches"] | ({batch[0]: batch[1]} if batch else {})
    state = {"version": state["version"] + 1, "count": count, "buckets": kept | made, "batches": batches, "before": sorted({f.split("/")[1] for f in full.values()})}
    _commit(spark, path, state)
    _clean(spark, path, state)


def read_buckets(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A table of ``replace_on_disk`` as its newest manifest has it; empty, which needs a ``schema``, if nothing is left of it or nothing was written yet."""
    folders = sorted(_manifest(spark, path)["buckets"].values())
    if not folders:
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*[f"{path}/{folder}" for folder in folders])


def write_pages(rows: DataFrame, path: str, pages: DataFrame | None = None, batch: tuple[str, int] | None = None) -> None:
    """Replace the pages ``pages`` (src_offset), or those that ``rows`` has rows of; other pages stay."""
    replace_on_disk(rows, rows if pages is None else pages, path, "src_offset", batch=batch)


def refresh(rows: DataFrame, path: str, expected: int | None = None) -> bool:
    """Replace a whole table; whether its number of rows is as expected (another number is no error)."""
    rows.write.mode("overwrite").parquet(path)
    return expected is None or rows.sparkSession.read.parquet(path).count() == expected


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """Long-form vocabulary (column, value, idx) as JSON lines, in order."""
    vocabulary.repartitionByRange("column", "idx").sortWithinPartitions("column", "idx").write.mode("overwrite").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Long-form results (tag, fold, metric, value) as JSON lines."""
    metrics.write.mode("overwrite").json(path)
