"""Resumable ingestion of landed files: each file once, a page or log that comes again replaces what it held; a replayed batch does nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.operators.logs import parse_log_text
from stratalake.sources.geojson import page_rows, parse_pages
from stratalake.sources.tables import replace_on_disk, write_pages


def _landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New rows with the time and name of their file."""
    return spark.readStream.schema(schema).parquet(path).select("*", F.col("_metadata.file_modification_time").alias("landed"), F.col("_metadata.file_name").alias("file"))


def newest(batch: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the file that landed last; of one moment that with the greatest name, of one file the greatest value."""
    return batch.groupBy(key).agg(F.max_by(value, F.struct("landed", "file", value)).alias(value))


def _drain(stream: DataFrame, replace, checkpoint: str) -> None:
    stream.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_pages(spark: SparkSession, landed: str, table: str, checkpoint: str, layer: str = "borings") -> None:
    """Take what is new in ``landed`` (Parquet rows src_offset, payload) into ``table``, then stop.  A page without features empties its offset."""

    def replace(batch: DataFrame, number: int) -> None:
        pages = newest(batch, "src_offset", "payload")
        write_pages(page_rows(parse_pages(pages), layer), table, pages, (checkpoint, number))

    _drain(_landed(spark, landed, "src_offset bigint, payload string"), replace, checkpoint)


def ingest_logs(spark: SparkSession, landed: str, table: str, checkpoint: str) -> None:
    """Parse new logs (Parquet rows boring_id, text); a boring's intervals are replaced as a whole, by none if none are found."""

    def replace(batch: DataFrame, number: int) -> None:
        logs = newest(batch, "boring_id", "text")
        replace_on_disk(parse_log_text(logs), logs, table, "boring_id", batch=(checkpoint, number))

    _drain(_landed(spark, landed, "boring_id string, text string"), replace, checkpoint)
