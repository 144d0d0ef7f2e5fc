"""Substring dedup with fixed-block anchors.

Blocks of ``block`` words at multiples of ``block`` are indexed; every rolling window of ``block`` words
probes them.  With ``2 * block - 1 <= n`` each run of ``n`` words holds an indexed block, so a probe meets
every repeated run.  Hits are extended to all windows of ``n`` words around them, whose full hashes decide
which start earlier elsewhere; the union of such windows is the set of maximal exact repeats.

Shape of the job: texts are dealt once into groups by a hash of doc_id and text, as many as the bytes of all texts ask for.  A group sends each *distinct* block
hash once (48 bits, sorted, so a key present in a third of all rows arrives once per group) and gets a bit
mask back; then the same with the surviving windows.  No pair of documents is ever formed.  Rows alike in doc_id and text would all
be one group's: where they are more than a group should hold, they go in once with their number, and come out again in batches.

Defined cases: null text is no words; null doc_id sorts before all ids and is kept as null; rows that share
a doc_id (or have none) are separate documents in a fixed order, by group and then by text; a text of any length is one
document of one group; an empty table gives an empty result; other columns are ignored.  Words are compared by 64-bit hashes of 64-bit word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm._shared import stored
from stratalake.llm._words import Words

_SUB = 1 << 16
_SLOTS = 1 << 20
_ROW_BYTES = 64
_BATCH = 1024
_MASKS = "g int, kind int, bucket int, bits binary"


def _segments(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])


def _bounds(buckets: int) -> np.ndarray:
    """First 16-bit prefix of each bucket, and the end."""
    return -(-np.arange(buckets + 1, dtype=np.int64) * _SUB // buckets)


class _Group:
    """One group's documents in order of doc_id, with their words."""

    def __init__(self, table: pa.Table, n: int, block: int):
        self.n, self.block = n, block
        table = table.append_column("_id", table.column("doc_id").fill_null(np.iinfo(np.int64).min)).sort_by([("_id", "ascending"), ("text", "ascending")])
        self.copies = table.column("copies")
        self.doc_id, self.ids = table.column("doc_id"), table.column("_id").to_numpy()
        self.words = Words(table.column("text"))
        self.hashes = self.words.hashes()

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct sorted 48-bit block keys, whether each is indexed, whether it repeats; key number by position."""
        at = np.flatnonzero(self.words.fits(self.block))
        keys = self.words.windows(self.hashes, self.block)[at] >> np.uint64(16)
        order = np.argsort(keys)
        keys = keys[order]
        runs = _segments(keys)
        aligned = (self.words.local()[at] % self.block == 0)[order]
        indexed = np.logical_or.reduceat(aligned, runs) if len(runs) else np.zeros(0, bool)
        sizes = np.diff(np.r_[runs, len(keys)])
        number = np.full(len(self.words), -1, np.int64)
        number[at[order]] = np.repeat(np.arange(len(runs)), sizes)
        return keys[runs], indexed, sizes > 1, number

    def spans(self, hit: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of ``n`` words that hold a hit: distinct sorted hashes, first position of each, all later ones."""
        marks = np.zeros(len(number) + self.n + 1, np.int64)
        marks[1 : len(number) + 1] = np.cumsum((number >= 0) & (hit[number] if len(hit) else False))
        marks[len(number) + 1 :] = marks[len(number)]
        reach = self.n - self.block + 1
        near = marks[reach : reach + len(number)] > marks[: len(number)]
        at = np.flatnonzero(near & self.words.fits(self.n))
        keys = self.words.windows(self.hashes, self.n, seed=7)[at]
        order = np.argsort(keys, kind="stable")
        runs = _segments(keys[order])
        firsts = at[order[runs]]
        later = np.ones(len(at), bool)
        later[order[runs]] = False
        return keys[order[runs]], firsts, at[later]


def _slices(prefix: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """Of sorted 16-bit prefixes, the range of each bucket that has any."""
    cuts = np.searchsorted(prefix, _bounds(buckets))
    for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
        yield int(b), int(cuts[b]), int(cuts[b + 1])


def _bits(masks: pa.Table, kind: int, sizes: dict[int, tuple[int, int]], total: int) -> np.ndarray:
    out = np.zeros(total, bool)
    for k, b, bits in zip(masks["kind"].to_pylist(), masks["bucket"].to_pylist(), masks["bits"].to_pylist(), strict=True):
        if k == kind:
            lo, hi = sizes[b]
            out[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
    return out


def _probe(n: int, block: int, buckets: int):
    bounds = _bounds(buckets)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, indexed, multi, _ = _Group(table, n, block).blocks()
        prefix = (keys >> np.uint64(32)).astype(np.int64)
        rows: dict[str, list] = {c: [] for c in ("g", "bucket", "counts", "rest", "indexed", "multi")}
        for b, lo, hi in _slices(prefix, buckets):
            counts = np.bincount(prefix[lo:hi] - bounds[b], minlength=bounds[b + 1] - bounds[b])
            rows["g"].append(key[0].as_py())
            rows["bucket"].append(b)
            rows["counts"].append(counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())
            rows["rest"].append((keys[lo:hi] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
            rows["indexed"].append(np.packbits(indexed[lo:hi]).tobytes())
            rows["multi"].append(np.packbits(multi[lo:hi]).tobytes())
        return pa.table(rows, pa.schema([("g", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("counts", "rest", "indexed", "multi"))]))

    return run


def _masks(kind: int, bucket: int, groups: list[int], flags: np.ndarray, sizes: list[int]) -> pa.Table:
    cuts = np.r_[0, np.cumsum(sizes)]
    rows = [(g, flags[a:b]) for g, a, b in zip(groups, cuts[:-1], cuts[1:], strict=True)]
    rows = [(g, np.packbits(f).tobytes()) for g, f in rows if f.any()]
    return pa.table(
        {"g": [r[0] for r in rows], "kind": [kind] * len(rows), "bucket": [bucket] * len(rows), "bits": [r[1] for r in rows]},
        pa.schema([("g", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())]),
    )


def _match_blocks(key: tuple, table: pa.Table) -> pa.Table:
    """Of one bucket: keys that are indexed somewhere and occur twice or more."""
    keys, indexed, multi, sizes = [], [], [], []
    for counts, rest, one, two in zip(*(table[c].to_pylist() for c in ("counts", "rest", "indexed", "multi")), strict=True):
        low = np.frombuffer(rest, np.uint32)
        counts = np.ascontiguousarray(np.frombuffer(counts, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
        keys.append((np.repeat(np.arange(len(counts), dtype=np.uint64), counts) << np.uint64(32)) | low)
        indexed.append(np.unpackbits(np.frombuffer(one, np.uint8), count=len(low)))
        multi.append(np.unpackbits(np.frombuffer(two, np.uint8), count=len(low)))
        sizes.append(len(low))
    all_keys, all_indexed, all_multi = np.concatenate(keys), np.concatenate(indexed), np.concatenate(multi)
    del keys, indexed, multi
    order = np.argsort(all_keys)
    runs = _segments(all_keys[order])
    length = np.diff(np.r_[runs, len(order)])
    good = (np.maximum.reduceat(all_indexed[order], runs) > 0) & ((length > 1) | (np.maximum.reduceat(all_multi[order], runs) > 0))
    flags = np.zeros(len(order), bool)
    flags[order] = np.repeat(good, length)
    return _masks(0, key[0].as_py(), table["g"].to_pylist(), flags, sizes)


def _hits(group: _Group, masks: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    keys, _, _, number = group.blocks()
    sizes = {b: (lo, hi) for b, lo, hi in _slices((keys >> np.uint64(32)).astype(np.int64), buckets)}
    return _bits(masks, 0, sizes, len(keys)), number


def _span_slices(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    return _slices((keys >> np.uint64(48)).astype(np.int64), buckets)


def _extend(n: int, block: int, buckets: int):
    schema = pa.schema([("g", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("ids", pa.binary())])

    def run(key: tuple, texts: pa.Table, masks: pa.Table) -> pa.Table:
        if not len(texts) or not len(masks):
            return schema.empty_table()
        group = _Group(texts, n, block)
        keys, firsts, _ = group.spans(*_hits(group, masks, buckets))
        ids = group.ids[np.searchsorted(group.words.first, firsts, "right") - 1]
        rows: dict[str, list] = {c: [] for c in schema.names}
        for b, lo, hi in _span_slices(keys, buckets):
            rows["g"].append(key[0].as_py())
            rows["bucket"].append(b)
            rows["hashes"].append(keys[lo:hi].tobytes())
            # by byte planes: the high bytes of ids are alike, and the shuffle's compression takes them out
            rows["ids"].append(np.ascontiguousarray(ids[lo:hi]).view(np.uint8).reshape(-1, 8).T.tobytes())
        return pa.table(rows, schema)

    return run


def _match_spans(key: tuple, table: pa.Table) -> pa.Table:
    """Of one bucket: the groups' first windows that start earlier in another group."""
    hashes = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
    sizes = [len(x) for x in hashes]
    ids = np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.int64).ravel() for x in table["ids"].to_pylist()])
    keys = np.concatenate(hashes)
    order = np.lexsort((np.repeat(table["g"].to_numpy(), sizes), ids, keys))
    flags = np.ones(len(order), bool)
    flags[order[_segments(keys[order])]] = False
    return _masks(1, key[0].as_py(), table["g"].to_pylist(), flags, sizes)


def _remove(n: int, block: int, buckets: int):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.utf8()), ("removed", spans), ("copies", pa.int64())])

    def run(key: tuple, texts: pa.Table, masks: pa.Table) -> pa.Table:
        if not len(texts):
            return schema.empty_table()
        group = _Group(texts, n, block)
        words = group.words
        gone = np.zeros(len(words), bool)
        if len(masks):
            keys, firsts, later = group.spans(*_hits(group, masks, buckets))
            sizes = {b: (lo, hi) for b, lo, hi in _span_slices(keys, buckets)}
            flagged = np.zeros(len(words), bool)
            flagged[firsts[_bits(masks, 1, sizes, len(keys))]] = True
            flagged[later] = True
            gone = words.covered(flagged, n)
        total = np.r_[0, np.cumsum(gone)]
        local, rows = words.local(), words.doc()
        if len(gone):
            begin = gone & (np.r_[True, ~gone[:-1]] | (local == 0))
            end = gone & (np.r_[~gone[1:], True] | (np.arange(len(gone)) + 1 == words.first[1:][rows]))
            a, b = np.flatnonzero(begin), np.flatnonzero(end)
        else:
            a = b = np.zeros(0, np.int64)
        cuts = np.searchsorted(a, words.first).astype(np.int32)
        removed = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(local[a]), pa.array(local[b] + 1)], ["start", "end"]))
        return pa.table([group.doc_id, pa.array(words.counts), pa.array(total[words.first[1:]] - total[words.first[:-1]]), words.joined(~gone), removed, group.copies], schema)

    return run


def _weights(docs: DataFrame) -> tuple[int, int]:
    """Bytes of all rows, and of the fullest of many hash slots of (doc_id, text)."""
    slots = docs.groupBy(F.pmod(F.xxhash64("doc_id", "text"), F.lit(_SLOTS)).alias("slot")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + _ROW_BYTES).alias("bytes"))
    total, fullest = slots.agg(F.sum("bytes"), F.max("bytes")).first()
    return total or 0, fullest or 0


def _copies_out(found: DataFrame, n: int) -> DataFrame:
    """A row for each copy: all but the first lose every window, so all their words if they have one."""
    batch = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1 + {_BATCH - 1}) div {_BATCH}")))
    rows = found.withColumn("batch", batch)
    whole = (F.col("batch") > 0) & (F.col("n_words") >= n)
    span = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    rows = rows.select(
        "doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        F.when(whole, span).otherwise(F.col("removed")).alias("removed"), "batch", F.when(F.col("batch") == 0, F.lit(1).cast("long")).otherwise(F.least(F.lit(_BATCH).cast("long"), F.col("copies") - 1 - (F.col("batch") - 1) * _BATCH)).alias("times"),
    )
    dealt = rows.repartition("doc_id", "batch")
    return dealt.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("batch", "times", "copy")


def substring_dedup(docs: DataFrame, n: int = 20, block: int = 10, groups: int | None = None, group_bytes: int = 1 << 26) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_text and the removed word spans.

    A word goes if a window of ``n`` words over it also starts earlier (smaller doc_id, or earlier in the
    same document).  ``groups``: into how many groups texts are dealt; if unset one for each ``group_bytes`` of text, and
    twice the shuffle partitions at least.  Hashes meet in half as many buckets, since each group
    and bucket exchange one row.
    """
    if 2 * block - 1 > n:
        raise ValueError("a window of n words must hold an aligned block: 2 * block - 1 <= n")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total, fullest = _weights(docs)
    collapsed = fullest > group_bytes + 4 * total // _SLOTS
    if groups is None:
        groups = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // group_bytes))
    buckets = max(1, min(groups // 2, _SUB))
    counted = stored(docs.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies")), "once") if collapsed else docs.withColumn("copies", F.lit(1).cast("long"))
    texts = counted.select("doc_id", "text", "copies", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("g"))
    blocks = texts.groupBy("g").applyInArrow(_probe(n, block, buckets), "g int, bucket int, counts binary, rest binary, indexed binary, multi binary")
    hits = blocks.groupBy("bucket").applyInArrow(_match_blocks, _MASKS)
    spans = texts.groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(_extend(n, block, buckets), "g int, bucket int, hashes binary, ids binary")
    earlier = spans.groupBy("bucket").applyInArrow(_match_spans, _MASKS)
    found = texts.groupBy("g").cogroup(hits.unionByName(earlier).groupBy("g")).applyInArrow(
        _remove(n, block, buckets), "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>, copies long"
    )
    return _copies_out(found, n) if collapsed else found.drop("copies")


def op1_query(docs: DataFrame) -> DataFrame:
    """Digest columns of the dedup of all documents."""
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"), F.size("removed").alias("n_spans"))
