import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stratalake.llm import lexical_search as search

ITEMS = "item_id long, text string, score long, row_key int"


def brute(docs, items, limit=10):
    """(item_id, rank, doc_id, score) by scoring every document."""
    counted = [(d, Counter(search.terms(t or ""))) for d, t, *_ in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, length = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in {(i, t) for i, t, *_ in items if t is not None}:
        scored = []
        for d, c in counted:
            m = 100 - 75 + 75 * c.total() * n_docs // length
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in Counter(search.terms(text)).items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item_id, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(scored)[:limit])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(rows):
    texts = [t for _, t, *_ in rows if t]
    rng = random.Random(2)
    out = [(i, " ".join(rng.choice(texts).split()[5:25]), 0, 0) for i in range(12)]
    return [*out, (20, None, 0, 0), (21, " .,; ", 0, 0), (22, "nowhere at-all", 0, 0), (23, "ÉTÉ été W1-w1,THE", 0, 0), (24, "x", 0, 0), out[0], (None, "w2 w3", 0, 0)]


def ranked(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_equals_brute_force(spark, docs, rows, items):
    assert ranked(search.op12_query(docs, spark.createDataFrame(items, ITEMS))) == brute(rows, items)


def test_items_in_blocks_and_small_blocks_of_documents(spark, docs, rows, items, monkeypatch):
    monkeypatch.setattr(search, "_ITEM_TERMS", 40)
    monkeypatch.setattr(search, "BLOCK_DOCS", 3)
    monkeypatch.setattr(search, "_LEXICON_ROWS", 50)
    monkeypatch.setattr(search, "_BROADCAST_SIZE", -1)
    assert ranked(search.search(docs, spark.createDataFrame(items, ITEMS), limit=3)) == brute(rows, items, 3)


def test_saturated_signatures_still_find_all(spark, docs, rows, items, monkeypatch):
    monkeypatch.setattr(search, "_WIDEST", 64)
    list(search._index(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "row_key": [1], "text": ["a b"]})])))
    assert ranked(search.search(docs, spark.createDataFrame(items, ITEMS))) == brute(rows, items)


def test_many_equal_rows_and_a_long_text(spark):
    docs = [(7, "alpha beta gamma", 0)] * 300 + [(k, "alpha beta gamma", 0) for k in range(100, 140)] + [(1, "alpha " * 100_000 + "beta", 0), (2, "delta alpha", 0), (3, None, 0), (4, "?!", 0)]
    items = [(1, "alpha beta"), (2, "delta"), (3, "gamma gamma beta")]
    got = search.search(spark.createDataFrame(docs, "doc_id long, text string, items int").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    assert ranked(got) == brute(docs, items)


def test_bounds_are_never_below_scores_and_mostly_tell(rows):
    texts = [(d, t) for d, t, *_ in rows if search.terms(t or "")]
    counted = [Counter(search.terms(t)) for _, t in texts]
    docs, length = len(counted), sum(c.total() for c in counted)
    df = Counter(t for c in counted for t in c)
    known = sorted(df)
    _, hashes = search.term_hashes(pa.array(known))
    weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1))) for t in known], np.float32)
    rng = random.Random(4)
    places = [np.array(sorted(rng.sample(range(len(known)), 15))) for _ in range(20)]
    query = search._Query(hashes, places, [weight[p] for p in places], [], docs, length, 10, np.zeros(20))
    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in texts], "row_key": list(range(len(texts))), "text": [t for _, t in texts]})
    seen, above = 0, 0
    for made in search._index(iter([batch])):
        for r in made.to_pylist():
            if r["kind"]:
                continue
            bounds = search._bounds(query, r["width"], np.array(r["lengths"]), r["slices"])
            for j, k in enumerate(r["row_keys"]):
                m = search.length_term(counted[k].total(), docs, length)
                for i, at in enumerate(places):
                    exact = sum(int(weight[p]) * search.part(counted[k][known[p]], m) for p in at if counted[k][known[p]])
                    assert bounds[i, j] >= exact
                    seen, above = seen + 1, above + (bounds[i, j] > 1.3 * exact + 1)
    assert seen == 20 * len(texts) and above < 0.25 * seen


def test_terms_fold_ascii_only():
    text = "Été É_x A1-b2\x7fc\x00D ñÑ"
    assert search.terms(text) == ["Été", "É", "x", "a1", "b2", "c", "d", "ñÑ"]
    words, hashes = search.term_hashes(pa.array([text]))
    assert len(hashes) == 8 and words.counts.tolist() == [8]


def test_empty_tables(spark, empty, items):
    table = spark.createDataFrame(items, ITEMS)
    assert search.op12_query(empty, table).collect() == []
    assert search.op12_query(spark.createDataFrame([(1, "a", 0, 0)], ITEMS.replace("item_id", "doc_id")), table.limit(0)).collect() == []
