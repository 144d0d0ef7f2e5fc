"""From raw documents to packed training rows, stage by stage; each stage calls one operator of stratalake.llm.

Defined cases, for all stages: a null or empty text has no language and goes in the first stage, and would pass all others
but the mix, which takes no document without words, and the packing, which has no row for it; a null doc_id, lang or source
is kept (a null source is a source of its own); rows that repeat are near duplicates and all but one of them go; ties are broken by
the smallest doc_id, then by a hash; texts of any length are read whole; other columns pass through all stages but the last,
whatever their names; an empty table gives an empty table of the same columns, and no packed rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.llm import decontaminate, language_id, mixing, ngram_join, packing
from stratalake.llm._shared import set_aside, shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language the calibrated classifier rejects."""
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.keep_accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return ngram_join.keep_one_per_group(docs, n=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents as the mix takes them, to the nearest whole document."""
    read = ("doc_id", "text", "source")
    aside, name = set_aside(docs)  # columns may be called as what the mix adds
    mixed = mixing.mix_sources(aside.withColumnsRenamed({name[c]: c for c in read}))
    copies = F.when(F.col("size") > 0, F.expr("(2 * taken + size) div (2 * size)")).otherwise(F.lit(0)).cast("int")
    taken = mixed.withColumn("size", F.explode(F.array_repeat(F.lit(0), copies)))
    return taken.select(*[F.col(c if c in read else name[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in packed rows."""
    return packing.pack_tokens(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mixing", mix),
    ("token_packing", pack),
]

#: The learned language filter and the tokenizer have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
