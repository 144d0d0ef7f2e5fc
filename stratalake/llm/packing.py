"""Token-ID output: best-fit-decreasing packing into fixed-length rows.

Each text is encoded, an end mark appended, and cut into pieces of at most ``seq_len`` ids, so overlong texts
are split without loss.  Pieces go, longest first, into the open row with the least room that still holds
them; a segment tree over remaining room finds it in log2(seq_len) steps.  Tasks pack chunks of bounded size
as they stream their partition, so memory follows the chunk and no shuffle is needed.

A row is (bin_id, n_tokens, input_ids, position_ids, cu_seqlens, doc_ids, offsets): ids and positions are
little-endian uint16 or int32 matrices rows of ``seq_len`` entries (padding: the end mark), positions restart
at 0 with each segment, ``cu_seqlens`` holds the running segment lengths from 0, and segment k is the piece of
document ``doc_ids[k]`` that begins at its token ``offsets[k]``.

Defined cases: null and empty texts have no ids and are in no row; repeated rows are packed once each; null
doc_id stays null in ``doc_ids``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm._shared import small_batches
from stratalake.llm.token_counts import tokenizer_path

CHUNK_TOKENS = 1 << 20
SCHEMA = "bin_id long, n_tokens long, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, offsets array<long>"


@functools.lru_cache(maxsize=4)
def _encoder(name_or_path: str):
    """text -> array of ids, and the id that no text yields (the end mark)."""
    import public_tokenizers
    import tiktoken

    with open(tokenizer_path(name_or_path), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encoding = tiktoken.Encoding(name_or_path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return (lambda text: np.array(encoding.encode_ordinary(text), np.int32)), len(ranks)


class RoomTree:
    """Open rows by remaining room; finds the least room of at least a given size."""

    def __init__(self, seq_len: int):
        self.leaves = 1 << seq_len.bit_length()
        self.any = [0] * (2 * self.leaves)  # open rows below each node
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = self.leaves + room
        while node:
            self.any[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) of a best fit, taken out; None if no open row has the room."""
        node = self.leaves + size
        while not self.any[node]:
            # the next subtree to the right: up while this is a right child, then over
            while node & 1:
                node >>= 1
            if node == 0:
                return None
            node += 1
            if node & (node - 1) == 0:  # wrapped to the next level's first node
                return None
        while node < self.leaves:
            node *= 2
            if not self.any[node]:
                node += 1
        room = node - self.leaves
        row = self.rows[room].pop()
        while node:
            self.any[node] -= 1
            node >>= 1
        return room, row


def best_fit_decreasing(sizes: list[int], seq_len: int) -> list[list[int]]:
    """Items of each row; items by size descending, ties in order."""
    tree, rows = RoomTree(seq_len), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[item])
        room, row = found if found else (seq_len, len(rows))
        if not found:
            rows.append([])
        rows[row].append(item)
        if room > sizes[item]:
            tree.put(room - sizes[item], row)
    return rows


def _pack(pieces: list[tuple[int | None, int, np.ndarray]], seq_len: int, end: int, first_bin: int) -> pa.RecordBatch:
    kind = np.dtype("<u2") if end < 1 << 16 and seq_len <= 1 << 16 else np.dtype("<i4")
    rows = best_fit_decreasing([len(p[2]) for p in pieces], seq_len)
    out: list[tuple] = []
    for k, items in enumerate(rows):
        ids, positions = np.full(seq_len, end, kind), np.zeros(seq_len, kind)
        cuts = [0]
        for i in items:
            size = len(pieces[i][2])
            ids[cuts[-1] : cuts[-1] + size] = pieces[i][2]
            positions[cuts[-1] : cuts[-1] + size] = np.arange(size)
            cuts.append(cuts[-1] + size)
        positions[cuts[-1] :] = np.arange(seq_len - cuts[-1])
        out.append((first_bin + k, cuts[-1], ids.tobytes(), positions.tobytes(), cuts, [pieces[i][0] for i in items], [pieces[i][1] for i in items]))
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = ["bin_id", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "offsets"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)


def _run(tokenizer: str, seq_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(tokenizer)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 36
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                text = text.as_py()
                if not text:
                    continue
                ids = np.append(encode(text), np.int32(end))
                for a in range(0, len(ids), seq_len):
                    pieces.append((doc_id.as_py(), a, ids[a : a + seq_len]))
                held += len(ids)
                if held >= CHUNK_TOKENS:
                    packed = _pack(pieces, seq_len, end, number)
                    number += packed.num_rows
                    yield packed
                    pieces, held = [], 0
        if pieces:
            yield _pack(pieces, seq_len, end, number)

    return run


def pack_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", seq_len: int = 2048) -> DataFrame:
    """Packed rows of the texts of ``docs``; bin_id is unique within the result."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_run(tokenizer, seq_len), SCHEMA)


def op4_query(docs: DataFrame) -> DataFrame:
    """All documents as packed rows."""
    return pack_tokens(docs)
