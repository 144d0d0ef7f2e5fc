"""Graph hops over buckets and bands of boxes against plain loops."""

import random
import re

from pyspark.sql import functions as F

from stratalake.operators import graph, logs
from stratalake.storage import bucketed


def _edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, edge_type string")


def _plain_context(edges, values, hops):
    ways = [(s, d, k) for s, d, k in edges] + [(d, s, k) for s, d, k in edges]
    now, out = dict(values), {n: [v] for n, v in values.items()}
    for _ in range(hops):
        new = {}
        for node in values:
            means = []
            for kind in {k for _, d, k in ways if d == node}:
                got = [now[s] for s, d, k in ways if d == node and k == kind and s in now and now[s] is not None]
                if got:
                    means.append(sum(got) / len(got))
            new[node] = sum(means) / len(means) if means else 0.0
        now = new
        for node in values:
            out[node].append(now[node])
    return out


def _sample():
    rng = random.Random(5)
    edges = [(f"b:{rng.randrange(12)}", f"l:{rng.randrange(12)}", rng.choice(["knn", "same", None])) for _ in range(40)]
    edges += [("b:0", f"l:{i}", "hub") for i in range(12)]
    return edges, {**{f"b:{i}": float(i) for i in range(12)}, **{f"l:{i}": (None if i == 3 else i / 7) for i in range(12)}, "l:alone": 2.0}


def test_context_equals_plain_loops_for_few_and_for_many_relations(spark):
    edges, values = _sample()
    nodes = spark.createDataFrame(list(values.items()), "id string, x double")
    want = _plain_context(edges, values, 3)
    for most in (64, 1):
        rows = graph.graph_context(_edges(spark, edges), nodes, ["x"], most_relations=most).collect()
        assert len(rows) == len(values)
        for row in rows:
            for got, expected in zip(row[1:], want[row["id"]], strict=True):
                assert (got is None and expected is None) or abs(got - expected) < 1e-9


def test_a_hop_shuffles_once(spark):
    edges, values = _sample()
    ways = graph.ways_of(_edges(spark, edges))
    nodes = bucketed(spark.createDataFrame(list(values.items()), "id string, x double").repartition(graph.shuffle_partitions(ways), "id"), "nodes", "id")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hop = nodes.select("id").join(graph._received(ways, nodes, ["x"], ["hub", "knn"]), "id", "left")
        plan = hop._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(re.findall(r"Exchange ", plan)) == 1


def test_reachability_equals_a_search(spark):
    chain = [("b:1", "l:1", "a"), ("l:1", "l:2", "a"), ("l:2", "l:3", "a"), ("l:3", "l:4", "a"), ("l:8", "l:9", "a"), ("b:1", "b:1", "a")]
    for hops, reached in ((0, 0), (1, 1), (2, 2), (3, 3), (4, 4)):
        row = graph.reachability(_edges(spark, chain), hops).first()
        assert (row["labels"], row["reached"]) == (6, reached)
    empty = graph.reachability(_edges(spark, [])).first()
    assert (empty["labels"], empty["reached"], empty["share"]) == (0, 0, None)


BOXES = "boring_id string, page int, seq int, page_w double, page_h double, x double, y double, text string, conf double"


def _page(rng, boring):
    rows = [(boring, 1, 0, 1000.0, 2000.0, 500.0, 10.0, "Blows on Spoon", 0.9)]
    for seq in range(1, 60):
        x = rng.choice([200.0, 280.0, 300.0, 300.0, 400.0, 450.0, 700.0, 800.0, 650.0])
        text = {200.0: rng.choice(["S-1", "S2", "note"]), 700.0: "brown silty SAND", 800.0: "with gravel", 650.0: "grey CLAY"}.get(x) or rng.choice(["5", "12.5", "3|4", "7 9", "-", "120"])
        rows.append((boring, 1, seq, 1000.0, 2000.0, x, float(rng.randrange(0, 2000, 35)), text, 0.9))
    return rows


def _numbers(text):
    parts = [re.sub(r"^[.:\-]+|[.:\-]+$", "", p) for p in re.split(r"[|/\s]+", text)]
    return [float(p) for p in parts if re.fullmatch(r"\d{1,3}(?:\.\d+)?", p)]


def _plain_spoon(rows):
    anchors = sorted((r[6], r[2], r[7]) for r in rows if 160 < r[5] < 240 and re.fullmatch(r"[A-Z]-?\d{1,2}", r[7]))
    out = []
    for y, _, sid in anchors:
        band = [r for r in rows if abs(r[6] - y) < 70]
        depths = sorted((r[5], r[2], v) for r in band if 240 < r[5] < 360 for v in _numbers(r[7]) if v < 100)
        blows = [v for r in sorted(band, key=lambda r: r[2]) if 370 < r[5] < 530 for v in _numbers(r[7]) if v < 100]
        n = None if not blows else int(blows[1] + blows[2]) if len(blows) > 2 else int(sum(blows))
        out.append((sid.replace("-", ""), depths[0][2] if depths else None, depths[1][2] if len(depths) > 1 else None, n))
    return out


def test_spoon_bands_equal_all_pairs_of_anchor_and_box(spark):
    rng = random.Random(11)
    pages = {f"B{i}": _page(rng, f"B{i}") for i in range(6)}
    # increments are rounded half to even one by one; whole ones keep the plain loop plain
    pages = {k: [r[:7] + (r[7].replace("12.5", "12"),) + r[8:] for r in rows] for k, rows in pages.items()}
    got = logs.parse_spoon(spark.createDataFrame([r for rows in pages.values() for r in rows], BOXES)).sort("boring_id", "interval_index").collect()
    for boring, rows in pages.items():
        mine = [(r["sample_type"], r["top_depth"], r["bottom_depth"], r["spt_n"]) for r in got if r["boring_id"] == boring]
        assert mine == _plain_spoon(rows)


def test_a_page_is_shuffled_once(spark):
    boxes = spark.createDataFrame(_page(random.Random(1), "B1"), BOXES)
    for rows in (logs.parse_spoon(boxes), logs.parse_generic(boxes), logs.layout(boxes)):
        assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert logs.parse_pages(boxes)._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(page") == 0


def test_empty_boxes_and_null_places(spark):
    assert logs.parse_pages(spark.createDataFrame([], BOXES)).count() == 0
    rows = [("B1", 1, 0, 1000.0, 2000.0, None, None, "Blows on Spoon", 0.9), ("B1", 1, 1, 1000.0, 2000.0, 200.0, 50.0, "S-1", 0.9), ("B1", 1, 2, 1000.0, 2000.0, 300.0, 50.0, None, 0.9), ("B1", 1, 3, 1000.0, 2000.0, 300.0, 119.0, "7", None)]
    (row,) = logs.parse_pages(spark.createDataFrame(rows, BOXES)).collect()
    assert (row["top_depth"], row["sample_type"]) == (7.0, "S1")
