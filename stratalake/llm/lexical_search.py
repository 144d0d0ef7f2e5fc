"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds, for blocks of documents, one bitmap of document rows per signature bit.  A document sets a few bits for each of its
terms, and again for each of the term's levels: found once, twice, four times, eight times or more.  The AND of a term's bitmaps is where it may be: never too few
documents, sometimes too many.  Weighted sums of such bitmaps, level by level, bound every document's score from above.

A search goes over all blocks twice.  First each task keeps the few documents with the highest bounds of each item; the best of these are scored
exactly, and the least of an item's ten scores is what any other document has to reach.  Then every document whose bound reaches it is
scored exactly.  Nothing else decides what is left out, so the result is exact, and copies, however many, only make more rows to score.

Items are taken in blocks of bounded size, as a broadcast holds their terms.  Statistics are exact and over all documents: terms are counted by
64-bit hashes when the index is made.

Defined cases: null and empty texts, and texts without a term, are no documents; repeated rows are documents of their own; a null doc_id ranks
after others of its score; an item without terms, or whose terms no document has, has no rows; repeated items are one; equal
scores go by doc_id; texts of any length are read whole; empty tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalake.llm._shared import small_batches, stored
from stratalake.llm._words import Words, mix
from stratalake.llm.ngram_join import text_slices

LEVELS = 4
HASHES = 4
ENTRY_BITS = 10
BLOCK_DOCS = 1024
_BLOCK_CELLS = 1 << 25
_WIDEST = 1 << 22  # wider signatures only bound more tightly
_LEXICON_ROWS = 1 << 20
_ITEM_TERMS = 200_000
_BROADCAST_SIZE = 1_000_000  # rows and items together
_SLACK = 1.00001  # of sums in single precision
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_FOLD = np.full(256, 0x20, np.uint8)
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _FOLD[_a:_b] = np.arange(_a, _b)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def terms(text: str) -> list[str]:
    return TERM.findall(text.translate(_LOWER))


def _folded(texts: pa.Array) -> pa.Array:
    """Texts with A-Z in lower case and spaces for all that is in no term."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(_FOLD[data])])


def term_hashes(texts: pa.Array) -> tuple[Words, np.ndarray]:
    words = Words(_folded(texts))
    return words, words.hashes()


def _level(hashes: np.ndarray, level: int) -> np.ndarray:
    return mix(hashes + np.full(1, level, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if level else hashes


def _bits(entries: np.ndarray, width: int) -> np.ndarray:
    """Signature bits (entries x HASHES) in signatures of ``width`` bits, a power of two."""
    step = entries >> np.uint64(32) | np.uint64(1)
    return ((entries[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(width - 1)).astype(np.int64)


def part(tf, m):
    """What one occurrence in the item adds per unit of weight; whole numbers."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def length_term(n, docs: int, length: int):
    return 100 - 75 + 75 * n * docs // length


class _Block:
    """Documents of one signature width on their way into the index."""

    def __init__(self, width: int):
        self.width, self.rows, self.entries, self.places = width, [], [], []

    def add(self, row: tuple, entries: np.ndarray) -> None:
        self.entries.append(entries)
        self.places.append(np.full(len(entries), len(self.rows), np.int64))
        self.rows.append(row)

    def full(self) -> bool:
        return len(self.rows) >= BLOCK_DOCS or len(self.rows) * self.width >= _BLOCK_CELLS

    def record(self) -> tuple:
        """(width, doc_ids, row_keys, lengths, slices): slices is width x documents, eight documents a byte."""
        across = -(-len(self.rows) // 8)
        slices = np.zeros(self.width * across, np.uint8)
        for entries, places in zip(self.entries, self.places, strict=True):  # a document at a time
            at = _bits(entries, self.width) * across + (places[:1, None] >> 3)
            slices[at.ravel()] |= np.uint8(1 << (places[0] & 7))
        return self.width, *map(list, zip(*self.rows, strict=True)), slices.tobytes()


_INDEX = "kind int, width int, doc_ids array<long>, row_keys array<long>, lengths array<long>, slices binary, terms binary, counts binary"
_INDEX_KINDS = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
_INDEX_NAMES = [c.split()[0] for c in _INDEX.split(", ")]


def _index_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_INDEX_KINDS)], _INDEX_NAMES)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (kind 0), and in how many documents of a part of the task each term is (kind 1)."""
    blocks: dict[int, _Block] = {}
    lexicon, held = [], 0

    def counted() -> pa.RecordBatch:
        hashes, counts = np.unique(np.concatenate(lexicon), return_counts=True)
        return _index_rows([(1, None, None, None, None, None, hashes.tobytes(), counts.astype(np.int64).tobytes())])

    for batch in batches:
        for some in text_slices(batch):
            words, hashes = term_hashes(some.column("text"))
            order = np.lexsort((hashes, words.doc()))
            docs, sorted_ = words.doc()[order], hashes[order]
            new = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (sorted_[1:] != sorted_[:-1])] if len(order) else np.zeros(0, bool))
            tf, distinct, owner = np.diff(np.r_[new, len(order)]), sorted_[new], docs[new]
            lexicon.append(distinct)
            held += len(distinct)
            bounds = np.searchsorted(owner, np.arange(len(words.counts) + 1))
            for d, (doc_id, row_key) in enumerate(zip(some.column("doc_id").to_pylist(), some.column("row_key").to_pylist(), strict=True)):
                a, b = bounds[d : d + 2]
                if a == b:
                    continue
                entries = np.concatenate([_level(distinct[a:b][tf[a:b] >= 1 << level], level) for level in range(LEVELS)])
                width = min(_WIDEST, 1 << max(8, int(ENTRY_BITS * len(entries) - 1).bit_length()))
                block = blocks.setdefault(width, _Block(width))
                block.add((doc_id, row_key, int(words.counts[d])), entries)
                if block.full():
                    yield _index_rows([(0, *blocks.pop(width).record(), None, None)])
            if held >= _LEXICON_ROWS:
                yield counted()
                lexicon, held = [], 0
    for block in blocks.values():
        yield _index_rows([(0, *block.record(), None, None)])
    if held:
        yield counted()


def _lexicon(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for hashes, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(hashes, np.int64)), pa.array(np.frombuffer(counts, np.int64))], ["term", "df"])


@dataclass
class Index:
    """Blocks of signatures, how many documents hold each term, and the totals N and L."""

    blocks: DataFrame
    lexicon: DataFrame
    docs: int
    length: int


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), F.col("text"))


def build_index(docs: DataFrame) -> Index:
    """Signatures of all rows of ``docs`` and the statistics of their terms."""
    small_batches(docs.sparkSession)
    made = stored(keyed(docs).mapInArrow(_index, _INDEX), "signatures", free=True)
    blocks = made.where("kind = 0").select("width", "doc_ids", "row_keys", "lengths", "slices")
    totals = blocks.agg(F.sum(F.size("doc_ids")), F.sum(F.expr("aggregate(lengths, 0L, (s, x) -> s + x)"))).first()
    lexicon = made.where("kind = 1").select("terms", "counts").mapInArrow(_lexicon, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return Index(blocks, lexicon, totals[0] or 0, totals[1] or 0)


@dataclass
class _Query:
    """Items of one block, made ready for tasks: the terms that documents hold, and per item their places and weights."""

    hashes: np.ndarray
    places: list[np.ndarray]
    weights: list[np.ndarray]
    words: list[dict[str, int]]
    docs: int
    length: int
    limit: int
    least: np.ndarray


def _bounds(query: _Query, width: int, lengths: np.ndarray, slices: bytes) -> np.ndarray:
    """Upper bounds of the scores, items x documents."""
    across = -(-len(lengths) // 8)
    bits = np.frombuffer(slices, np.uint8).reshape(width, across)
    m = length_term(lengths, query.docs, query.length)
    # of a level all that its documents may have: one less than the next level, and no more than they hold words
    most = [part(np.minimum(lengths, (2 << level) - 1) if level < LEVELS - 1 else lengths, m) for level in range(LEVELS)]
    out = np.zeros((len(query.places), len(lengths)))
    alive, there = np.arange(len(query.hashes)), None
    for level in range(LEVELS):
        at = _bits(_level(query.hashes[alive], level), width)
        found = bits[at[:, 0]]
        for k in range(1, HASHES):
            found = found & bits[at[:, k]]
        if there is not None:
            found &= there  # what is found twice is found once
        some = found.any(1)
        alive, there = alive[some], found[some]
        if not len(alive):
            break
        present = np.unpackbits(there, axis=1, count=len(lengths), bitorder="little").astype(np.float32)
        row = np.full(len(query.hashes), -1)
        row[alive] = np.arange(len(alive))
        more = most[level] - (most[level - 1] if level else 0)
        for i, (places, weights) in enumerate(zip(query.places, query.weights, strict=True)):
            at = row[places]
            use = at >= 0
            if use.any():
                out[i] += (weights[use] @ present[at[use]]) * more
    return out * _SLACK


_FOUND = "item int, row_key long, bound double"


def _found(items: np.ndarray, keys: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(keys, pa.int64()), pa.array(bounds, pa.float64())], ["item", "row_key", "bound"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes]]:
    for batch in batches:
        for k in range(batch.num_rows):
            width, keys, lengths, slices = (batch.column(c)[k] for c in ("width", "row_keys", "lengths", "slices"))
            yield width.as_py(), keys.values.to_numpy(zero_copy_only=False), lengths.values.to_numpy(zero_copy_only=False), slices.as_py()


def _highest(shared):
    """Of each item the documents of a task with the highest bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = shared.value
        best, best_keys = np.zeros((len(query.places), query.limit)), np.zeros((len(query.places), query.limit), np.int64)
        for width, keys, lengths, slices in _blocks(batches):
            bounds = np.concatenate([best, _bounds(query, width, lengths, slices)], 1)
            every = np.concatenate([best_keys, np.broadcast_to(keys, (len(best), len(keys)))], 1)
            top = np.argpartition(-bounds, query.limit - 1, axis=1)[:, : query.limit]
            best, best_keys = np.take_along_axis(bounds, top, 1), np.take_along_axis(every, top, 1)
        items, at = np.nonzero(best)
        yield _found(items, best_keys[items, at], best[items, at])

    return run


def _reaching(shared):
    """Documents whose bound reaches what their item asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = shared.value
        for width, keys, lengths, slices in _blocks(batches):
            bounds = _bounds(query, width, lengths, slices)
            items, at = np.nonzero((bounds > 0) & (bounds >= query.least[:, None]))
            if len(items):
                yield _found(items, keys[at], bounds[items, at])

    return run


def _scored(shared):
    """Exact scores of texts for their items; a task keeps the best of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = shared.value
        best: dict[int, list[tuple]] = {}
        for batch in batches:
            for doc_id, text, items in zip(*(batch.column(c) for c in ("doc_id", "text", "items")), strict=True):
                tf = Counter(terms(text.as_py() or ""))
                m = length_term(tf.total(), query.docs, query.length)
                doc_id = doc_id.as_py()
                for item in items.as_py():
                    score = sum(w * part(tf[t], m) for t, w in query.words[item].items() if t in tf)
                    if score > 0:
                        rows = best.setdefault(item, [])
                        rows.append((-score, doc_id is None, doc_id or 0))
                        if len(rows) >= 8 * query.limit:
                            rows.sort()
                            del rows[query.limit :]
        rows = [(item, None if none else doc_id, -score) for item, found in best.items() for score, none, doc_id in sorted(found)[: query.limit]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return run


def _exact(docs: DataFrame, found: DataFrame, shared, limit: int) -> DataFrame:
    """(item, doc_id, score, rank): the best documents of each item among ``found`` (item, row_key)."""
    asked = stored(found.groupBy("row_key").agg(F.collect_set("item").alias("items")), "asked")  # a text has as many items as the block at most
    size = asked.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0]
    joined = keyed(docs).join(F.broadcast(asked) if size <= _BROADCAST_SIZE else asked, "row_key").select("doc_id", "text", "items")
    scores = joined.mapInArrow(_scored(shared), "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _prepared(items: list, index: Index, limit: int) -> _Query | None:
    """The block's items with the weights of their terms; collects the terms' counts, as many as the block has terms."""
    counts = [Counter(terms(r["text"] or "")) for r in items]
    known = sorted(set().union(*counts)) if counts else []
    if not known or not index.length:
        return None
    _, hashes = term_hashes(pa.array(known))
    spark = index.blocks.sparkSession
    asked = spark.createDataFrame([(int(h),) for h in hashes.view(np.int64)], "term long")
    df = {r["term"]: r["df"] for r in index.lexicon.join(F.broadcast(asked), "term").collect()}
    weight = {t: math.floor(1000 * math.log((2 * index.docs + 2) / (2 * df[h] + 1))) for t, h in zip(known, hashes.view(np.int64).tolist(), strict=True) if h in df}
    place = {t: k for k, t in enumerate(weight)}
    words = [{t: weight[t] * c for t, c in sorted(found.items()) if t in weight} for found in counts]
    at = [np.array([place[t] for t in w], np.int64) for w in words]
    values = [np.array(list(w.values()), np.float32) for w in words]
    kept = hashes[[k for k, t in enumerate(known) if t in weight]]
    return _Query(kept, at, values, words, index.docs, index.length, limit, np.zeros(len(items)))


def search(docs: DataFrame, items: DataFrame, index: Index | None = None, limit: int = 10) -> DataFrame:
    """Per item (item_id, text) its ``limit`` best documents: item_id, rank, doc_id, score.  ``index``: that of the same ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    index = index or build_index(docs)
    kind = items.schema["item_id"].dataType
    asked = stored(items.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct(), "items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // (4 * _ITEM_TERMS)))
    out = []
    for k in range(parts):
        block = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()  # of bounded size
        query = _prepared(block, index, limit)
        if query is None:
            continue
        shared = spark.sparkContext.broadcast(query)
        top = index.blocks.mapInArrow(_highest(shared), _FOUND)
        order = Window.partitionBy("item").orderBy(F.desc("bound"), "row_key")
        seeds = top.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit).select("item", "row_key")
        for r in _exact(docs, seeds, shared, limit).where(F.col("rank") == limit).select("item", "score").collect():
            query.least[r["item"]] = r["score"]
        shared = spark.sparkContext.broadcast(query)
        found = index.blocks.mapInArrow(_reaching(shared), _FOUND).select("item", "row_key")
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item int, item_id {kind.simpleString()}")
        out.append(stored(_exact(docs, found, shared, limit).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked"))
    if not out:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def op12_query(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return search(docs, items)
