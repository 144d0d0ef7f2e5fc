"""Whole-batch word work on Arrow string columns with numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D; documents never share a word.  All
functions work on one Arrow batch or group, so their memory follows that batch and not the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SLICE = 1 << 18
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = _constants(256, 11)
_BYTE[_SEPARATOR] = 0
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]
_BASE = 0x5851F42D4C957F2D
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = max(_SLICE, n)
    if size not in _powers:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        if size > _SLICE:
            return tables[0], tables[1]
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


class Words:
    """Words of a batch: byte ranges ``starts``/``ends`` in ``data`` and word ranges ``first`` per document."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if n else None
        self.data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.offsets = offsets = offsets - offsets[0]
        inside = ~_SEPARATOR[self.data]
        edge = np.empty(len(inside) + 1, bool)
        edge[[0, -1]] = True
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[offsets] = True
        self.starts = np.flatnonzero(inside & edge[:-1])
        self.ends = np.flatnonzero(inside & edge[1:]) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def doc(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def local(self) -> np.ndarray:
        """Position of each word in its document."""
        return np.arange(len(self)) - np.repeat(self.first[:-1], self.counts)

    def hashes(self, fold_case: bool = False) -> np.ndarray:
        """64-bit hash of each word; ``fold_case`` lower-cases A-Z first."""
        table, out = (_BYTE_FOLDED if fold_case else _BYTE), np.zeros(len(self), np.uint64)
        cuts = np.unique(np.r_[0, np.searchsorted(self.starts, np.arange(_SLICE, len(self.data), _SLICE)), len(self)])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            lo, hi = self.starts[a], self.ends[b - 1]
            forward, back = _power_tables(hi - lo)
            at = self.starts[a:b] - lo
            terms = table[self.data[lo:hi]]
            terms *= forward[: hi - lo]
            out[a:b] = np.add.reduceat(terms, at) * back[at]
        return mix(out + (self.ends - self.starts).astype(np.uint64))

    def windows(self, hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
        """Hash of the ``n`` words from each word on; those past a document's end are to be masked by ``fits``."""
        out, consts = np.zeros(len(hashes), np.uint64), _constants(n, 1000 + seed) | np.uint64(1)
        for k in range(min(n, len(hashes))):
            out[: len(hashes) - k] += hashes[k:] * consts[k]
        return mix(out)

    def fits(self, n: int) -> np.ndarray:
        """Whether ``n`` words of one document start at each word."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self)) >= n

    def covered(self, flagged: np.ndarray, n: int) -> np.ndarray:
        """Words inside any flagged window of ``n`` words (windows stay within documents)."""
        at = np.flatnonzero(flagged)
        step = np.zeros(len(self) + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + n, -1)
        return np.cumsum(step[:-1]) > 0

    def joined(self, keep: np.ndarray) -> pa.Array:
        """Per document its kept words, joined by one space."""
        pieces = []
        per_doc = np.zeros(len(self.counts), np.int64)
        rows = self.doc()
        sizes = np.where(keep, self.ends - self.starts + 1, 0)
        np.add.at(per_doc, rows, sizes)
        lengths = np.maximum(per_doc - 1, 0)
        cuts = np.unique(np.r_[0, np.searchsorted(self.starts, np.arange(_SLICE, len(self.data), _SLICE)), len(self)])
        last = np.zeros(len(self), bool)
        kept = np.flatnonzero(keep)
        if len(kept):
            last[kept[np.r_[rows[kept][1:] != rows[kept][:-1], True]]] = True
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            use = np.flatnonzero(keep[a:b]) + a
            if not len(use):
                continue
            size = self.ends[use] - self.starts[use] + ~last[use]
            begin = np.cumsum(size) - size
            take = np.repeat(self.starts[use] - begin, size) + np.arange(size.sum())
            piece = self.data[np.minimum(take, len(self.data) - 1)]
            space = ~last[use]
            piece[(begin + size - 1)[space]] = 0x20
            pieces.append(piece)
        body = np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)
        if lengths.sum() >= 1 << 31:
            raise OverflowError("a batch's joined texts pass 2 GiB: deal the texts into more groups")
        out_offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
        return pa.Array.from_buffers(pa.utf8(), len(self.counts), [None, pa.py_buffer(out_offsets), pa.py_buffer(body)])
