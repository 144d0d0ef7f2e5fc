"""Features of GeoJSON files by byte ranges: one large file is as many tasks as its size asks for.

A file is read as text cut at closing braces, which Spark does by ranges ("blocks").  What a brace means depends on all
that precedes it, so each block is first summed up on its own, for both cases that it begins inside a string or not; the
few rows of blocks are added up in order, and then every block knows how deep it begins and finds the features' borders.
A feature that a block's border cuts is put together from its pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalake.storage import stored

_BLOCK = ["file", "block"]
#: A feature within its block; what follows a cut in an object; a cut feature's begin, and that of another object.
_WHOLE, _TAIL, _HEAD, _OTHER = 0, 1, 2, 3


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch, bytes]]:
    """(block, its rows, their bytes) of each run of rows of one block."""
    for batch in batches:
        if not batch.num_rows:
            continue
        start, name = batch.column("block").to_numpy(), batch.column("file").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((start[1:] != start[:-1]) | (name[1:] != name[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = batch.slice(a, b - a)
            yield (name[a], int(start[a])), rows, b"}".join(rows.column("value").cast(pa.binary()).to_pylist()) + b"}"


def _depths(text: bytes, inside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of the braces outside strings, and after each how many braces and brackets are open more than at the
    start; and whether the text ends inside a string."""
    b = np.frombuffer(text, np.uint8)
    quotes = np.flatnonzero(b == ord('"'))
    if b"\\" in text:  # a quote after an odd number of backslashes ends nothing
        other = np.maximum.accumulate(np.where(b != ord("\\"), np.arange(len(b)), -1))
        before = np.where(quotes > 0, other[quotes - 1], quotes - 1)
        quotes = quotes[(quotes - 1 - before) % 2 == 0]
    marks = np.flatnonzero((b == ord("{")) | (b == ord("}")) | (b == ord("[")) | (b == ord("]")))
    marks = marks[(np.searchsorted(quotes, marks) + inside) % 2 == 0]
    kind = b[marks]
    braces = np.cumsum((kind == ord("{")).astype(np.int64) - (kind == ord("}")))
    brackets = np.cumsum((kind == ord("[")).astype(np.int64) - (kind == ord("]")))
    return marks, braces, brackets, (len(quotes) + inside) % 2


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run of a block: whether it ends in the other case than it begins, and what it opens in either case."""
    for (file, block), rows, text in _chunks(batches):
        out = []
        for inside in (0, 1):
            marks, braces, brackets, ends = _depths(text, inside)
            out += [int(braces[-1]), int(brackets[-1])] if len(marks) else [0, 0]
        values = [[file], [block], [rows.column("pos")[0].as_py()], [1 - ends], *([v] for v in out)]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.string(), *[pa.int64()] * 7], strict=True)], ["file", "block", "pos", "odd", "b0", "k0", "b1", "k1"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and pieces of such as a block's borders leave, with the block they lie in."""
    now, state, held, kind = None, (0, 0, 0), [], _WHOLE  # kind: what the open object is if the block ends in it

    def rows(block: tuple, kinds: list[int], texts: list[bytes]) -> pa.RecordBatch:
        k = len(kinds)
        return pa.RecordBatch.from_arrays([pa.array([block[0]] * k, pa.string()), pa.array([block[1]] * k, pa.int64()), pa.array(kinds, pa.int32()), pa.array(texts, pa.binary()).cast(pa.string())], ["file", "block", "kind", "text"])

    for block, part, text in _chunks(batches):
        if block != now:
            if held:
                yield rows(now, [kind], [b"".join(held)])
            now, state = block, tuple(part.column(c)[0].as_py() for c in ("inside", "braces", "brackets"))
            held, kind = ([b""], _TAIL) if state[1] >= 2 else ([], _WHOLE)
        marks, braces, brackets, inside = _depths(text, state[0])
        braces, brackets = braces + state[1], brackets + state[2]
        here = np.frombuffer(text, np.uint8)[marks]
        # objects of the second level, in brackets (features) or not; deeper braces lie within them
        opening = (here == ord("{")) & (braces == 2)
        begins, features = marks[opening].tolist(), (brackets[opening] == 1).tolist()
        ends = (marks[(here == ord("}")) & (braces == 1)] + 1).tolist()
        kinds, texts = [], []
        if held and ends:
            held.append(text[: ends[0]])
            if kind != _OTHER:
                kinds.append(_TAIL if kind == _TAIL else _WHOLE)
                texts.append(b"".join(held))
            held, ends = [], ends[1:]
        elif held:
            held.append(text)
        for a, b, feature in zip(begins, ends, features, strict=False):
            if feature:
                kinds.append(_WHOLE)
                texts.append(text[a:b])
        if len(begins) > len(ends):
            held, kind = [text[begins[-1] :]], _HEAD if features[-1] else _OTHER
        state = (inside, int(braces[-1]), int(brackets[-1])) if len(marks) else (inside, *state[1:])
        if kinds:
            yield rows(block, kinds, texts)
    if held:
        yield rows(now, [kind], [b"".join(held)])


def feature_texts(spark: SparkSession, path: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(file, text): the objects in the first level of arrays of each file's object, as text.

    Whitespace, escapes, braces within strings and features longer than a block are all allowed; a file that breaks off
    gives the features before that.  Compressed files are one block each.  ``broadcast_rows``: so many blocks at most are
    sent to all tasks, else texts are brought to their block's row by a sort.
    """
    read = spark.read.option("lineSep", "}").text(path)
    parts = read.select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("pos"))
    summed = stored(parts.mapInArrow(_summaries, "file string, block long, pos long, odd long, b0 long, k0 long, b1 long, k1 long"), "summaries")
    before = Window.partitionBy("file").orderBy("block", "pos").rowsBetween(Window.unboundedPreceding, -1)
    inside = summed.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    opened = inside.withColumns({k: F.when(F.col("inside") == 1, F.col(f"{k}1")).otherwise(F.col(f"{k}0")) for k in "bk"})
    depth = opened.withColumns({name: F.coalesce(F.sum(k).over(before), F.lit(0)) for k, name in (("b", "braces"), ("k", "brackets"))})
    first = F.struct("pos", "inside", "braces", "brackets")
    states = stored(depth.groupBy(*_BLOCK).agg(F.min(first).alias("s")).select(*_BLOCK, "s.inside", "s.braces", "s.brackets"), "states")
    if states.count() <= broadcast_rows:
        known = parts.join(F.broadcast(states), _BLOCK)
    else:
        known = parts.join(states, _BLOCK).repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "pos")
    pieces = stored(known.mapInArrow(_pieces, "file string, block long, kind int, text string"), "features")
    cut = pieces.where(F.col("kind") != _WHOLE)
    # a head begins an object, the tails up to the next head belong to it
    number = F.sum((F.col("kind") >= _HEAD).cast("int")).over(Window.partitionBy("file").orderBy("block", "kind"))
    numbered = cut.select(*_BLOCK, "kind").withColumn("number", number)
    joined = cut.join(numbered, [*_BLOCK, "kind"]).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p"), F.max("kind").alias("kind"))
    mended = joined.where(F.col("kind") == _HEAD).select("file", F.array_join(F.transform("p", lambda p: p["text"]), "").alias("text"))
    return pieces.where(F.col("kind") == _WHOLE).select("file", "text").unionByName(mended)
