import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalake.llm import ngram_join as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=4):
    words = WORD.findall((text or "").translate(FOLD))
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n=4, percent=85):
    sets = [shingles(r[1], n) for r in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    low = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted((-1 if r[0] is None else r[0], len(sets[i]), low[find(i)] if sets[i] else r[0]) for i, r in enumerate(rows))


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_equals_brute_force(docs, rows):
    assert got(N.op8_query(docs)) == brute(rows)


def dense(seed=2, groups=4, size=60, length=150):
    """Groups of near copies on both sides of the threshold, and a line that all texts share."""
    rng = random.Random(seed)
    rows, line = [], "this very line is in each and every text of them all"
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(300)}" for _ in range(length)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(0, 6)):
                text[rng.randrange(length)] = f"r{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text) + " " + line))
    return rows


@pytest.mark.parametrize("settings", [{}, {"frequent": 1e9}, {"broadcast_rows": 0}])
def test_dense_groups(spark, settings):
    rows = dense()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(N.similar_groups(df, **settings)) == brute(rows)


@pytest.mark.parametrize("parts", [{"part_rows": 3}, {"part_bytes": 4000}])
def test_tiles_in_parts(spark, parts):
    """Large tiles in many parts give the links of all pairs."""
    rows = dense(seed=9, groups=2, size=40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(N.similar_groups(df, frequent=1e9, **parts)) == brute(rows)


def test_own_names_do_not_clash(spark):
    rows = [(1, "a b c d e f", "r"), (2, "a b c d e f", "s"), (3, "z", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ROW_KEY string").withColumn("set_id", F.lit("u")).withColumn("root", F.lit(1.5))
    kept = N.keep_one_per_group(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [(1, "a b c d e f", "r", "u", 1.5), (3, "z", "t", "u", 1.5)]


def test_signatures_bound_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.r_[a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, 20).astype(np.uint64)])
        x, y = (np.frombuffer(N.signature(s), np.uint64) for s in (a, b))
        while len(x) != len(y):
            if len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            else:
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_one_row_of_each_group_stays(spark, docs, rows):
    kept = N.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect())
    expected = sorted({low for d, n, low in brute(rows) if n} | {d for d, n, _ in brute(rows) if not n})
    assert ids == expected


def test_repeated_rows_and_empty(spark, empty):
    assert got(N.op8_query(empty)) == []
    twins = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (5, "q"), (6, None), (6, None)], "doc_id long, text string")
    assert got(N.op8_query(twins)) == [(5, 1, 5), (5, 2, 5), (5, 2, 5), (6, 0, 6), (6, 0, 6)]
    assert sorted((r.doc_id, r.text or "") for r in N.keep_one_per_group(twins).collect()) == [(5, "a b c d e"), (5, "q"), (6, ""), (6, "")]
