"""Where jobs put tables that several executors read."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir.

    Where that is unset a local session gets a temporary folder of its own; on a cluster executors would not see
    one machine's folder, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="stratalake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, free: bool = False, by: list[str] | None = None) -> DataFrame:
    """``df`` written once to the shared folder (``by``: in folders of these columns' values) and read back, which cuts its lineage.

    ``free``: ask the driver to collect garbage after it.  Spark drops the shuffle files of finished jobs only then,
    and a chain of large steps would else hold all of them at once.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    df.write.parquet(path, partitionBy=by)
    if free:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` written once to the shared folder in one file per hash bucket of ``key``, in no order: Spark's joins sort a bucket again in any case.

    There are as many buckets as shuffle partitions, so joins and aggregates on ``key`` shuffle nothing of it, and what
    they meet it with is shuffled once at most.  A ``df`` that an aggregate has just dealt by ``key`` is not dealt again
    by the writer; any other should be repartitioned by it, or its buckets are split over all tasks' files.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table)
    return spark.table(table)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def partitions_for(spark: SparkSession, rows: int, each: int) -> Iterator[int]:
    """Within it, shuffles and buckets are as many as ``rows`` need at ``each``, and two a core or what the session has, if that is fewer, at least.

    Every task of a join or sort takes its pages of memory, however few its rows; those of the whole input's bytes are too many for a table that is a small part of it.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    parts = max(min(int(before), 2 * spark.sparkContext.defaultParallelism), -(-rows // each))
    spark.conf.set(name, str(parts))
    try:
        yield parts
    finally:
        spark.conf.set(name, before)


#: Bytes of input tables for each partition of a shuffle, the most bytes to which adaptive execution joins partitions (compressed: sorted in memory
#: they are some ten times as many), and which tables count.
PARTITION_BYTES = 4 << 20
JOINED_MB = 16
_SIZED = "/(customer|supplier|part|orders|lineitem|events)[.]parquet"


def deal_by_size(spark: SparkSession, sf_dir: str) -> int:
    """Raise spark.sql.shuffle.partitions to the size of the input, so that a task's share stays the same as tables grow.

    What the session had set is the least; where adaptive execution is on it joins partitions that turn out small.
    """
    joined = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark.conf.get(joined, "64MB").upper() in ("64MB", "67108864B", "67108864"):  # Spark's own; what a user has set stays
        spark.conf.set(joined, f"{JOINED_MB}MB")
    name, own, least = "spark.sql.shuffle.partitions", "stratalake.partitions", "stratalake.partitions.least"
    now = spark.conf.get(name)
    if now != spark.conf.get(own, None):  # set by the user since
        spark.conf.set(least, now)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/*.parquet").where(F.col("path").rlike(_SIZED))
    size = files.agg(F.sum("length")).first()[0] or 0
    parts = max(int(spark.conf.get(least)), -(-size // PARTITION_BYTES))
    spark.conf.set(name, str(parts))
    spark.conf.set(own, str(parts))
    return parts


def forget(*tables: DataFrame) -> None:
    """Delete the folders of ``stored`` tables, once all that was made from them is itself stored."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
