"""Token counts with a digest cache.

A text's key is the SHA-256 of its normalised content (null counts as empty; nothing else may change, since
any change could change the count) with a digest of the tokenizer file.  Keys found in the cache take the
stored count; of the rest each distinct text is encoded once and its count appended.

Copies are brought together before they are shuffled, and the counts lie in a table of their own when the rows meet
them, so Spark can split a digest that a third of all rows share.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows each get their count; null
doc_id is kept; texts of any length are counted whole, one at a time beyond a megabyte; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm._shared import shared_dir, small_batches, stored

_CHUNK_BYTES = 1 << 20
_CACHE = "digest binary, version string, n_tokens long"


def tokenizer_path(name_or_path: str) -> str:
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


@functools.lru_cache(maxsize=4)
def _counter(name_or_path: str):
    """texts -> token counts, by the library that reads the file."""
    path = tokenizer_path(name_or_path)
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread: Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about a megabyte, so that encodings in memory stay few."""
    chunk, size = [], 0
    for text in texts:
        chunk.append(text)
        size += len(text)
        if size >= _CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _encode(name_or_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(name_or_path)
        for batch in batches:
            counts = [n for chunk in _chunks(batch.column("text").to_pylist()) for n in count(chunk)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", cache: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, digest.  ``cache``: path of the store, kept between calls."""
    spark = docs.sparkSession
    cache = cache or shared_dir(spark, "token-counts")
    with open(tokenizer_path(tokenizer), "rb") as f:
        version = hashlib.sha256(f.read()).hexdigest()[:16]
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    small_batches(spark)
    misses = docs.select(digest, text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    try:
        known = spark.read.schema(_CACHE).parquet(cache).where(F.col("version") == version).select("digest").distinct()
        misses = misses.join(known, "digest", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    counted = misses.mapInArrow(_encode(tokenizer), "digest binary, n_tokens long")
    counted.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    # two writers may have counted the same text; one row per key goes into the join
    counts = stored(spark.read.schema(_CACHE).parquet(cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), digest)
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", "digest")


def op10_query(docs: DataFrame, limit: int = 512) -> DataFrame:
    """Counts of all documents and whether they pass ``limit`` tokens."""
    return token_counts(docs).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
