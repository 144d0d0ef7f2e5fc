import re

import pytest
from pyspark.sql import functions as F

from stratalake.llm.decontaminate import decontaminate, leaks

ITEM = "the quick brown fox jumps over the lazy dog while seven small birds watch from a tall green tree"
SHORT = "only a few words here"


@pytest.fixture(scope="module")
def tables(spark):
    swapped = ITEM.replace("lazy", "sleepy").replace("watch", "look")
    loud = "".join(w.upper() + "!! " for w in ITEM.split())
    docs = [
        (1, "noise before " + ITEM + " and after"), (2, swapped), (3, loud), (4, "nothing of the kind in this text at all, nor over there, nor anywhere else"), (5, None), (6, ""),
        (7, " ".join(reversed(ITEM.split()))), (8, SHORT), (9, " ".join(ITEM.split()[:13])), (10, " ".join(ITEM.split()[:8])), (None, ITEM), (1, "another row of one"), (11, "a " * 500 + ITEM),
    ]
    bench = [(3, ITEM), (1, ITEM.upper()), (2, SHORT), (4, None), (5, "a " * 20)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")


def brute(docs, items, window=13, share=0.84):
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for doc_id, text in docs:
        d = tokens(text)
        for item_id, it in items:
            b = tokens(it)
            if len(b) < 4:
                continue
            c = min(window, len(b))
            least = c if c < 9 else -(-c * share // 1)
            for shift in range(-len(b), len(d)):
                e = [int(0 <= shift + q < len(d) and d[shift + q] == b[q]) for q in range(len(b))]
                if max(sum(e[i : i + c]) for i in range(len(b) - c + 1)) >= least:
                    out.add((doc_id, item_id))
    return out


def test_equals_brute_force(tables):
    docs, bench = tables
    got = {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()}
    assert got == brute([tuple(r) for r in docs.collect()], [(1, ITEM), (2, SHORT), (5, "a " * 20)])


def test_shuffled_join_gives_the_same(tables):
    docs, bench = tables
    assert {tuple(r) for r in leaks(docs, bench, broadcast_seeds=0).collect()} == {tuple(r) for r in leaks(docs, bench).collect()}


def test_rows_that_stay(tables):
    docs, bench = tables
    kept = decontaminate(docs, bench).collect()
    assert sorted(r.text[:7] for r in kept if r.doc_id == 1) == ["another"]
    assert {4, 5, 6, 7, 10} <= {r.doc_id for r in kept} and None not in {r.doc_id for r in kept}


def test_empty_tables(tables):
    docs, bench = tables
    assert leaks(docs.limit(0), bench).collect() == [] and leaks(docs, bench.limit(0)).collect() == []


def test_short_items_match_whole_or_not_at_all(spark):
    items = [(n, " ".join(f"v{n}w{k}" for k in range(n))) for n in range(3, 9)] + [(50, "\u4ec0\u4e48\u662f\u91cf\u5b50\u529b\u5b66")]
    rows = [(n, "so " + t + " it is") for n, t in items] + [(100 + n, t.rsplit(" ", 1)[0] + " other") for n, t in items[:-1]] + [(200, "\u6211\u95ee\u4ec0\u4e48\u662f\u91cf\u5b50\u529b\u5b66\u5417")]
    got = leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.matched) for r in got) == [(n, n, n) for n in range(4, 9)] + [(50, 50, 7), (200, 50, 7)]


def test_clashing_names_and_very_long_texts(spark):
    rows = [(1, "x " * 300_000 + ITEM, "k", "a"), (2, "y " * 300_000, "k2", "b"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, KEY string, doc_key string").withColumn("pos", F.lit(1)).withColumn("_words", F.lit(2))
    kept = decontaminate(df, spark.createDataFrame([(1, ITEM, "z")], "item_id long, text string, item_key string"))
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.KEY, r.doc_key, r.pos, r._words) for r in kept.collect()) == [(2, "k2", "b", 1, 2), (3, None, None, 1, 2)]
