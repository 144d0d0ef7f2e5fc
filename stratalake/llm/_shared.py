"""What this subpackage's modules share: the library's shared folder, Arrow batches of texts, names for helper columns."""

from pyspark.sql import DataFrame, SparkSession

from stratalake.storage import forget, shared_dir, stored

__all__ = ["forget", "shared_dir", "set_aside", "small_batches", "stored", "unused"]

_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Batches of whole texts: at most ``rows`` a batch from here on, unless the session asks for fewer."""
    if int(spark.conf.get(_RECORDS)) > rows:
        spark.conf.set(_RECORDS, str(rows))


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores until no column of ``tables`` is called so (in any case)."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns renamed by number, and the new name of each, so that any other name is free."""
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names
