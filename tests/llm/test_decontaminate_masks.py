import math
from itertools import combinations

from stratalake.llm.decontaminate import MASKS, leaks

WORDS = "the quick brown fox jumps over lazy dogs while seven small birds watch".split()


def patterns(n):
    return combinations(range(n), n - math.ceil(n * 0.84))


def test_every_allowed_pattern_is_hit():
    for n in range(9, 14):
        for bad in map(set, patterns(n)):
            assert any(bad.isdisjoint(s + k for k in m) for m in MASKS for s in range(n - m[-1])), (n, bad)


def test_leaks_under_every_allowed_pattern(spark):
    items = [(n, " ".join(f"{w}{n}" for w in WORDS[:n])) for n in range(9, 14)]
    rows = [("cut", 9, items[0][1].rsplit(" ", 1)[0])]
    for n, text in items:
        rows += [(bad, n, " ".join("other" if i in bad else w for i, w in enumerate(text.split()))) for bad in patterns(n)]
    docs = spark.createDataFrame([(i, text) for i, (_, _, text) in enumerate(rows)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [r[:2] for i, r in enumerate(rows) if (i, r[1]) not in got] == []


def test_each_of_equal_seeds_is_an_alignment(spark):
    item = "one two p q a b c d k l a b c d e f g h i one two three four a b c d e f g h i"
    docs = spark.createDataFrame([(1, "one two x y a b c d e f g h i")], "doc_id long, text string")
    got = leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.matched) for r in got] == [(1, 11)]
