import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from stratalake.llm import best_two_fit as b2f


def one_by_one(sizes: list[int], room: int) -> list[tuple[int, ...]]:
    """The same rule, a sequence at a time over a list of pieces."""
    left, out = sorted(sizes, reverse=True), []
    while left:
        bin_, gap = [], room
        for s in list(left):
            if s <= gap:
                bin_.append(s)
                left.remove(s)
                gap -= s
        while gap and len(bin_) > 1:
            least = min(bin_)
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if least < a + b <= gap + least]
            if not pairs:
                break
            _, a, b = max(pairs)
            bin_.remove(least)
            bin_ += [a, b]
            left.remove(a)
            left.remove(b)
            left = sorted([*left, least], reverse=True)
            gap += least - a - b
        out.append(tuple(sorted(bin_)))
    return out


def test_plan_equals_one_by_one():
    rng = random.Random(7)
    for _ in range(150):
        room = rng.choice([9, 20, 64])
        sizes = [rng.choice([rng.randrange(1, room + 1), rng.randrange(1, room // 2 + 1), 3]) for _ in range(rng.randrange(0, 60))]
        fillings = b2f.plan(np.bincount(sizes, minlength=room + 1) if sizes else np.zeros(room + 1))
        got = [tuple(sorted(s for s, n in f.pieces for _ in range(n))) for f in fillings for _ in range(f.repeats)]
        assert sorted(got) == sorted(one_by_one(sizes, room))


def test_two_replace_the_smallest():
    # greedy: 6 + 3, room for 1; the 3 goes back and 2 + 2 fit exactly
    (first, *_) = b2f.plan(np.bincount([6, 3, 2, 2], minlength=11))
    assert sorted(s for s, n in first.pieces for _ in range(n)) == [2, 2, 6]


def test_a_plan_of_huge_counts_is_small():
    rng = np.random.default_rng(1)
    counts = np.r_[0, rng.integers(1, 10**9, 2048)]
    fillings = b2f.plan(counts)
    assert len(fillings) < 20_000
    tokens, used = int((counts * np.arange(2049)).sum()), sum(f.repeats for f in fillings)
    assert -(-tokens // 2048) <= used <= 1.34 * tokens / 2048
    total = np.zeros(2049, np.int64)
    for f in fillings:
        for s, n in f.pieces:
            total[s] += n * f.repeats
    assert (total == counts).all()


def _check(rows, pieces, seq_len, encode, end=0):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        assert 0 < p.length <= seq_len
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= seq_len
    want = {}
    for doc_id, text, *_ in rows:
        ids = np.array([*encode(text or ""), end], "<u4")
        first = (len(ids) - 1) % seq_len + 1
        cuts = [0, *range(first, len(ids) + 1, seq_len)]
        want.setdefault(doc_id, []).extend((k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
    assert {d: sorted((p.piece, p.start, p.length, p.ids_crc32) for p in parts) for d, parts in by_doc.items()} == {d: sorted(w) for d, w in want.items()}
    return len(by_sequence)


def library(text: str) -> list[int]:
    import public_tokenizers
    from tokenizers import Tokenizer

    library.tokenizer = getattr(library, "tokenizer", None) or Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return library.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_and_places(spark, docs, rows):
    pieces = b2f.pack(docs, seq_len=64).collect()
    n = _check(rows, pieces, 64, library)
    lengths = np.bincount([p.length for p in pieces], minlength=65)
    assert n == sum(f.repeats for f in b2f.plan(lengths))
    for r in b2f.packed_rows(b2f.pack(docs, seq_len=64)).collect():
        assert len(r.ids) == 4 * r.n_tokens and r.cu_seqlens[-1] == r.n_tokens and len(r.doc_ids) == len(r.cu_seqlens) - 1


def test_repeated_rows_long_texts_special_strings(spark):
    rows = [(1, "a b", "x", 1)] * 500 + [(2, "word " * 50_000, "x", 1), (3, None, "x", 1), (None, "", "x", 1), (4, "x <|endoftext|> y", "x", 1), (5, "é \U0001f600 \t\n  " * 40, "x", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids string, task int").repartition(3)
    pieces = b2f.op13_query(table).collect()
    n = _check(rows, pieces, 2048, library)
    assert n == -(-sum(p.length for p in pieces) // 2048)


@pytest.mark.parametrize("name", ["documents", "benchmark"])
def test_fast_ids_are_the_library_s(name):
    encode = b2f.encoder("byte_bpe_50k.json")
    for text in pq.read_table(f"/root/testdata/sf0.001/{name}.parquet").column("text").to_pylist():
        assert encode(text or "") == library(text or "")


def test_another_file_goes_through_its_library(spark):
    encode = b2f.encoder("word_bpe_49k.json")
    assert encode("Some Words, lower-cased")


def test_empty_table(empty):
    assert b2f.op13_query(empty).collect() == []
