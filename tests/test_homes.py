"""Searches by homes against all pairs, and reachability that looks only at what is not reached."""

import random

import pytest
from pyspark.sql import functions as F
from test_geometry import circles

from stratalake.operators import delaunay, graph, knn, quadtree

POINTS = "id string, x double, y double, unit string"


def _points(n, seed=3):
    rng = random.Random(seed)
    spot = lambda i: (rng.gauss(50, 2), rng.gauss(50, 2)) if i % 3 == 0 else (rng.uniform(0, 100), rng.uniform(0, 100))
    return [(f"p{i:04d}", *spot(i), rng.choice(["u", "v", "", None])) for i in range(n)] + [(f"z{i}", 7.0, 7.0, "u") for i in range(5)]


@pytest.fixture
def small_homes(monkeypatch):
    for module, name, value in ((quadtree, "BULK", 128), (knn, "CAP", 8), (knn, "BLOCK", 48), (delaunay, "CAP", 8), (delaunay, "NEAREST", 8)):
        monkeypatch.setattr(module, name, value)


def test_nearest_over_many_homes_and_blocks(spark, small_homes):
    rows, k, few = _points(130), 7, 2
    df = spark.createDataFrame(rows, POINTS)
    want = set()
    for q, x, y, unit in rows:
        near = sorted((((x - a) ** 2 + (y - b) ** 2) ** 0.5, i, u) for i, a, b, u in rows if i != q)[:k]
        want |= {(q, i, n + 1, bool(unit) and u == unit) for n, (_, i, u) in enumerate(near) if n < few or (unit and u == unit)}
    got = knn.knn(df, df, k, same=True, alike="unit", few=few).collect()
    assert {(r.qid, r.id, r["rank"], r.alike) for r in got} == want and len(got) == len(want)
    points = {i: (x, y) for i, x, y, _ in rows if i[0] == "p" or i == "z0"}
    assert {(r.src, r.dst) for r in delaunay.delaunay_edges(df.select("id", "x", "y")).collect()} == circles(points)


def test_a_point_goes_to_homes_and_not_to_every_near_leaf(spark, monkeypatch):
    monkeypatch.setattr(quadtree, "BULK", 1 << 11)
    rng = random.Random(6)
    df = spark.createDataFrame([(f"p{i:05d}", rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(4000)], "qid string, x double, y double")
    rows = df.select(F.explode(F.array(F.lit(True), F.lit(False))).alias("ask"), "qid", F.col("qid").alias("id"), "x", "y")
    tree = quadtree.build(rows, 16)
    by_leaf = quadtree.near_leaves(tree, 9).join(tree.steps[-1].select(F.col("node").alias("p"), "np"), "p").agg(F.sum("np")).first()[0]
    by_home = knn.at_home(tree, 9).where("NOT ask").count()
    assert 4000 <= by_home < 4 * 4000 < by_leaf / 2


def _plain_share(edges, hops):
    beside = {}
    for a, b in edges:
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    reached = {n for n in beside if n.startswith("b:")}
    for _ in range(hops):
        reached |= {m for n in reached for m in beside[n]}
    labels = {n for n in beside if n.startswith("l:")}
    return len(labels), len(labels & reached)


def test_late_labels_equal_a_search(spark):
    rng = random.Random(9)
    edges = [(f"l:{rng.randrange(90)}", f"l:{rng.randrange(90)}") for _ in range(85)] + [(f"l:{i}", f"b:{i}") for i in range(6)] + [("b:1", "b:2")]
    table = spark.createDataFrame([(*e, "a") for e in edges], "src string, dst string, edge_type string")
    for hops in (0, 1, 3, 5):
        row = graph.reachability(table, hops).first()
        assert (row["labels"], row["reached"]) == _plain_share(edges, hops)


def test_no_hop_is_stored_if_every_label_is_beside_a_boring(spark, monkeypatch):
    def never(*_):
        raise AssertionError("stored ways")

    monkeypatch.setattr(graph, "bucketed", never)
    table = spark.createDataFrame([("b:1", f"l:{i}", "a") for i in range(5)] + [("l:1", "l:2", "a")], "src string, dst string, edge_type string")
    row = graph.reachability(table).first()
    assert (row["labels"], row["reached"], row["share"]) == (5, 5, 1.0)


def test_union_context_over_numbers_equals_that_over_ids_even_of_repeated_ones(spark):
    rows = [(f"{'bl'[i % 2]}:{i}", x, y, u) for i, (_, x, y, u) in enumerate(_points(60))]
    nodes = spark.createDataFrame([*rows, rows[3]], POINTS).withColumn("v", F.col("x") / 7)
    point = nodes.drop("v")
    edges = graph.boring_graph(point).unionByName(graph.label_edges(point.where("id LIKE 'l:%'"), point.where("id LIKE 'b:%'")))
    plain = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select("id", "v", "v_1", "v_2", "v_3").collect())
    got = plain(graph.union_context(nodes, ["v"]))
    assert got == plain(graph.graph_context(edges, nodes, ["v"])) and len(got) == 64 + 16


def test_buckets_of_the_hops_follow_the_nodes(spark, monkeypatch):
    seen, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    bucketed = graph.bucketed
    monkeypatch.setattr(graph, "bucketed", lambda df, name, key: seen.append(spark.conf.get("spark.sql.shuffle.partitions")) or bucketed(df, name, key))
    edges = spark.createDataFrame([("b:1", "l:1", "a")], "src string, dst string, edge_type string")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        graph.graph_context(edges, spark.createDataFrame([("b:1", 1.0), ("l:1", 2.0)], "id string, x double"), ["x"], 1).collect()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "400"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(seen) == {str(2 * spark.sparkContext.defaultParallelism)}
