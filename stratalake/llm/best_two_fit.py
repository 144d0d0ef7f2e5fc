"""Best-two-fit packing of all documents into as few sequences as it can.

A sequence is filled greedily, always with the longest unpacked piece that still fits.  If room is left, its smallest piece is given back
and two unpacked pieces take that piece's place, if two together fill the larger gap more tightly; so again with the then
smallest piece until nothing fits more tightly.

All this depends on lengths alone, so it runs on the number of pieces of each length, a table of at most ``seq_len`` rows however large
the corpus is.  A filling is repeated as long as its pieces last, which is what one sequence after the other would come to,
and a plan has some thousand fillings at most.  Pieces find their places by their number among those of their length: tasks number
their own pieces as they encode, and the counts of (task, length) are summed up over tasks.  So no task, group or driver holds
more than its share, and the packing is that of one bin-packer over all documents.

A byte-level BPE file is read by tiktoken, which gives the ids of its own library several times faster (tested); texts that hold one of the file's
special strings, and other files, go through that library itself.

A document is its ids and then ``end``; one longer than ``seq_len`` is cut into pieces of ``seq_len``, the first of which takes what
does not divide.

Defined cases: null and empty texts are one piece, the end mark; rows that repeat are packed once each; null doc_id stays null; texts
of any length are encoded whole, one at a time; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalake.llm._shared import small_batches, stored
from stratalake.llm.token_counts import tokenizer_path

_CHUNK_TOKENS = 1 << 20


@functools.lru_cache(maxsize=2)
def encoder(name_or_path: str):
    """text -> its ids, as the file's library gives them without special tokens added."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread: Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    path = tokenizer_path(name_or_path)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def slow(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    whole = not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"))
    if not (model["type"] == "BPE" and whole and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")):
        return slow
    import public_tokenizers
    import tiktoken

    # printable stand-ins of bytes: those that print stand for themselves, the others follow from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    special = [t["content"] for t in spec.get("added_tokens", [])]
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    fast = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        return slow(text) if any(s in text for s in special) else fast.encode_ordinary(text)

    return encode


@dataclass(frozen=True)
class Filling:
    """``repeats`` sequences that each hold ``pieces``: (length, how many), longest first but for replaced ones."""

    pieces: tuple[tuple[int, int], ...]
    repeats: int


def _longest(left: np.ndarray, room: int) -> int:
    """The greatest length up to ``room`` of which a piece is left; 0 if there is none."""
    at = np.flatnonzero(left[1 : room + 1])
    return int(at[-1]) + 1 if len(at) else 0


def _two(left: np.ndarray, room: int, over: int) -> tuple[int, int] | None:
    """Lengths of two pieces that together come nearest to ``room`` and are longer than ``over``; the longer one is as long as can be."""
    sizes = np.flatnonzero(left[: room + 1])
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return None
    # of each length the longest partner up to itself; of a length with a single piece a shorter one
    most = np.minimum(room - sizes, np.where(left[sizes] > 1, sizes, sizes - 1))
    at = np.searchsorted(sizes, most, "right") - 1
    both = np.where(at >= 0, sizes + sizes[np.maximum(at, 0)], 0)
    k = len(both) - 1 - int(both[::-1].argmax())
    return (int(sizes[k]), int(sizes[at[k]])) if both[k] > over else None


def plan(counts: np.ndarray) -> list[Filling]:
    """Fillings for ``counts[n]`` pieces of each length n; the room of a sequence is the last index."""
    left, room, out = counts.astype(np.int64).copy(), len(counts) - 1, []
    while left.any():
        now, gap, bin_ = left.copy(), room, []
        while gap and (size := _longest(now, gap)):
            many = min(int(now[size]), gap // size)
            bin_ += [size] * many
            now[size] -= many
            gap -= many * size
        while gap and len(bin_) > 1:
            least = min(bin_)
            pair = _two(now, gap + least, least)
            if pair is None:
                break
            bin_.remove(least)
            bin_ += pair
            gap += least - sum(pair)
            now[least] += 1
            np.subtract.at(now, list(pair), 1)
        sizes, many = np.unique(bin_, return_counts=True)
        repeats = int((left[sizes] // many).min())
        left[sizes] -= repeats * many
        order = {s: k for k, s in reversed(list(enumerate(bin_)))}
        out.append(Filling(tuple(sorted(zip(sizes.tolist(), many.tolist(), strict=True), key=lambda p: order[p[0]])), repeats))
    return out


def _pieces(tokenizer: str, seq_len: int, end: int, with_ids: bool):
    """Pieces of texts, numbered per length within their task."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "task", "nth"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = encoder(tokenizer), TaskContext.get()
        task = context.partitionId() if context else 0
        numbers = np.zeros(seq_len + 1, np.int64)
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                held += len(ids)
                start, stop = 0, (len(ids) - 1) % seq_len + 1
                for piece in range(-(-len(ids) // seq_len)):
                    body, size = ids[start:stop].tobytes(), stop - start
                    rows.append((doc_id, piece, start, size, zlib.crc32(body), body if with_ids else None, task, int(numbers[size])))
                    numbers[size] += 1
                    start, stop = stop, stop + seq_len
                if held >= _CHUNK_TOKENS:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return run


def _places(fillings: list[Filling], seq_len: int) -> dict[str, np.ndarray]:
    """The plan by pieces in order of length and number: from which piece on which sequence, offset, and number a sequence."""
    used, first, rows = np.zeros(seq_len + 1, np.int64), 0, []
    for filling in fillings:
        offset = 0
        for size, many in filling.pieces:
            rows.append((size, int(used[size]), many, first, offset))
            used[size] += many * filling.repeats
            offset += many * size
        first += filling.repeats
    rows.sort()
    before = np.cumsum(used) - used
    columns = [np.array([r[i] for r in rows], np.int64) for i in range(5)]
    return {"at": columns[1] + before[columns[0]], "many": columns[2], "sequence": columns[3], "offset": columns[4]}


def _placed(shared):
    """sequence_id and offset of pieces by their number over all, in order of length and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            number = batch.column("number").to_numpy()
            k = np.searchsorted(places["at"], number, "right") - 1
            far = number - places["at"][k]
            sequence = places["sequence"][k] + far // places["many"][k]
            offset = places["offset"][k] + far % places["many"][k] * batch.column("length").to_numpy()
            names = [n for n in batch.schema.names if n != "number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", seq_len: int = 2048, end: int = 0, with_ids: bool = True) -> DataFrame:
    """Per piece of a document: doc_id, piece, start, length, ids_crc32, ids (little-endian uint32; null if not ``with_ids``), sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    pieces = stored(rows.mapInArrow(_pieces(tokenizer, seq_len, end, with_ids), f"{_PIECE}, task int, nth long"), "pieces")
    sums = stored(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = np.zeros(seq_len + 1, np.int64)
    for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length, ``seq_len`` at most
        counts[r["length"]] = r["n"]
    shared = spark.sparkContext.broadcast(_places(plan(counts), seq_len))
    # numbers go up by length, then task
    shorter = spark.createDataFrame([(n, int(c)) for n, c in enumerate(np.cumsum(counts) - counts) if counts[n]], "length long, shorter long")
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sums.withColumn("earlier", earlier).join(F.broadcast(shorter), "length").select("length", "task", (F.col("earlier") + F.col("shorter")).alias("base"))
    numbered = pieces.join(bases, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("base") + F.col("nth")).alias("number"))
    return numbered.mapInArrow(_placed(shared), f"{_PIECE}, sequence_id long, offset long")


def packed_rows(pieces: DataFrame) -> DataFrame:
    """Whole sequences from ``pack``'s rows: sequence_id, n_tokens, ids (uint32), doc_ids and cu_seqlens in order of offset."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))  # a sequence has ``seq_len`` pieces at most
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p"))
    joined = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    return rows.select("sequence_id", "n_tokens", joined.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.concat(F.col("p.offset"), F.array("n_tokens")).alias("cu_seqlens"))


def op13_query(docs: DataFrame) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(docs, with_ids=False).drop("ids")
