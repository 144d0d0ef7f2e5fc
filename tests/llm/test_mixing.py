import pytest
from pyspark.sql import functions as F

from stratalake.llm import mixing as M


def targets(sizes, repeats=3):
    """Share by weight, cap, share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > repeats * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 1000, None: 40}, {"é": 10, "z": 10, "A": 10}, {"a": 7}, {"a": 0, "b": 9}, {None: 3, "k": 2000, "l": 1, "m": 1, "n": 50}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in M.source_targets(df).collect()}
    assert got == pytest.approx(targets(sizes))


def test_schedule_equals_brute_force(spark):
    df = M.source_targets(spark.createDataFrame([("a", 500), ("b", 300), ("c", 200)], "source string, source_size long"))
    plan = df.orderBy("sid").collect()
    blocks = {r.sid: max(1, round(r.source_size / max(1000 / 64, 1))) for r in plan}
    quota = {r.sid: r.target * blocks[r.sid] / r.source_size for r in plan}
    edges, acc = [], 0.0
    for r in plan:
        acc += quota[r.sid] / sum(quota.values())
        edges.append((acc, r.sid))
    expected = {}
    for k in range(1, 65):
        x = k * M.PHI - int(k * M.PHI)
        sid = next(s for e, s in edges if x < e)
        expected.setdefault(sid, []).append(k)
    got = {}
    for r in M.schedule(df, 64).where("order <= 64").orderBy("order").collect():
        got.setdefault(r.sid, []).append(r.order)
        assert r.block == r["rank"] % blocks[r.sid]
    for sid, orders in got.items():
        assert orders == expected[sid][: len(orders)] and len(orders) >= int(quota[sid]) - 2


def test_whole_mix(docs, rows):
    got = M.op9_query(docs).collect()
    again = M.op9_query(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    source = {r[0]: r[3] for r in rows}
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = source[r.doc_id]
        sizes[s], taken[s], target[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken, r.target
        assert r.size == len((next(x[1] for x in rows if x[0] == r.doc_id) or "").split())
    assert target == pytest.approx(targets(sizes))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2


def test_taken_equals_blocks(spark):
    """Words taken of each document, counted block by block from the schedule."""
    data = [(i, "w " * (i * 7 % 23), "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = {r.doc_id: r.taken for r in M.mix_sources(df, slots=32, bin_rows=7).collect()}
    sizes = df.groupBy("source").agg(F.sum(M.word_count(F.col("text"))).alias("source_size"))
    t = {r.source: r for r in M.source_targets(sizes).collect()}
    slots = {}
    for r in M.schedule(M.source_targets(sizes), 32).collect():
        slots.setdefault(r.sid, []).append(r)
    order = df.withColumn("k", F.xxhash64(F.lit(29), "doc_id", "text")).withColumn("b", F.pmod(F.shiftright("k", 20), F.lit(6))).orderBy("b", "k", "doc_id").collect()
    for source, info in t.items():
        stream = [r.doc_id for r in order if r.source == source for _ in range((r.doc_id * 7) % 23)]
        n, counts = slots[info.sid][0].blocks, {}
        for s in slots[info.sid]:
            a, b = s.block * len(stream) // n, (s.block + 1) * len(stream) // n
            end = b if s.part >= 1 else a + int(s.part * (b - a) + 0.5)
            for d in stream[a:end]:
                counts[d] = counts.get(d, 0) + 1
        for d in set(stream):
            assert got[d] == counts.get(d, 0)


def test_many_sources_and_no_broadcast(spark):
    """As many sources as rows, and tables of blocks that are shuffled."""
    df = spark.createDataFrame([(i, "w " * (1 + i % 9), None if i == 7 else f"host{i}.example") for i in range(300)], "doc_id long, text string, source string").repartition(3)
    got = M.mix_sources(df, slots=512, bin_rows=20).collect()
    sizes = {r.source: r.size for r in got}
    assert {r.source: r.target for r in got} == pytest.approx(targets(sizes))
    assert all(r.source_size == r.size and abs(r.taken - r.target) <= 1 for r in got)
    assert sorted(map(str, M.mix_sources(df, slots=512, bin_rows=20, broadcast_rows=0).collect())) == sorted(map(str, got))


def test_clashing_names_and_very_long_texts(spark):
    rows = [(1, "w " * 400_000, "a", 1, "k"), (2, "w", "b", 2, None), (None, None, None, None, "x"), (1, "w", "b", 3, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bin int, name string").withColumn("SID", F.lit("s")).withColumn("in_0", F.lit(4)).withColumn("taken", F.lit("mine"))
    got = M.mix_sources(df).collect()
    assert M.mix_sources(df).columns == ["doc_id", "text", "source", "bin", "name", "SID", "in_0", "size", "source_size", "target", "taken"]
    assert sorted((r.bin or 0, r.name or "", r.SID, r.in_0, r.size) for r in got) == [(0, "x", "s", 4, 0), (1, "k", "s", 4, 400_000), (2, "", "s", 4, 1), (3, "y", "s", 4, 1)]


def test_a_third_of_all_rows_alike(spark, monkeypatch):
    """Repeated rows are cut into bins of bounded size, with the result of one ordered bin."""
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 2], i) for i in range(1200)] + [(7000, "same text here", "a", i % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, g int").repartition(5)
    sizes, per_bin = [], M._per_bin
    monkeypatch.setattr(M, "_per_bin", lambda base: sizes.append(per_bin(base).agg({"bin_count": "max"}).first()[0]) or per_bin(base))
    got = sorted(map(str, M.mix_sources(df, slots=256, bin_rows=10).drop("g").collect()))
    assert sizes[0] >= 600 and len(sizes) == 2 and sizes[1] <= 40
    monkeypatch.setattr(M, "_FULL", 1 << 20)
    assert sorted(map(str, M.mix_sources(df, slots=256, bin_rows=10).drop("g").collect())) == got
    assert sorted(r.g for r in M.mix_sources(df, slots=256, bin_rows=10).collect()) == sorted(r[3] for r in rows)


def test_empty(empty):
    assert M.op9_query(empty).collect() == []
