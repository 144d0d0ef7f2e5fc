import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalake.functions import geo
from stratalake.functions.vincenty import vincenty_m
from stratalake.operators import delaunay, graph, knn, normalize, pip


def test_projection_origin_and_round_trip(spark):
    x, y = geo.project("lon", "lat")
    rows = spark.createDataFrame([(-74.5, 38 + 50 / 60), (-74.1, 40.7), (-75.4, 39.2)], "lon double, lat double").select("*", x.alias("x"), y.alias("y"))
    assert (rows.first().x, rows.first().y) == pytest.approx((492125.0, 0.0), abs=1e-6)
    lon, lat = geo.unproject("x", "y")
    for r in rows.select("lon", "lat", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert (r.lon2, r.lat2) == pytest.approx((r.lon, r.lat), abs=1e-8)


def test_inside_excludes_edges_and_holes(spark):
    square = [(1, 0, 0, 0.0, 0.0), (1, 0, 1, 4.0, 0.0), (1, 0, 2, 4.0, 4.0), (1, 0, 3, 0.0, 4.0), (1, 0, 4, 0.0, 0.0), (1, 1, 0, 1.0, 1.0), (1, 1, 1, 2.0, 1.0), (1, 1, 2, 2.0, 2.0), (1, 1, 3, 1.0, 2.0), (1, 1, 4, 1.0, 1.0)]
    polygons = pip.polygons_from_vertices(spark.createDataFrame(square, "objectid long, ring int, seq int, x double, y double"))
    points = {1: (3.0, 3.0), 2: (0.0, 2.0), 3: (4.0, 4.0), 4: (1.5, 1.5), 5: (2.0, 1.5), 6: (9.0, 9.0), 7: (None, 1.0), 8: (0.5, 0.5)}
    got = pip.match_polygons(spark.createDataFrame([(k, *v) for k, v in points.items()], "id long, lon double, lat double"), polygons)
    assert sorted(r.id for r in got.collect()) == [1, 8]


def test_polygons_of_many_sizes(spark):
    rng = random.Random(1)
    boxes, vertices = [], []
    for k in range(40):
        x, y, s = rng.uniform(0, 10), rng.uniform(0, 10), 10 ** rng.uniform(-3, 1)
        boxes.append((x, y, s))
        vertices += [(k, i, x + s * a, y + s * b) for i, (a, b) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)])]
    pts = [(i, rng.uniform(0, 12), rng.uniform(0, 12)) for i in range(300)]
    got = pip.match_polygons(spark.createDataFrame(pts, "id long, lon double, lat double"), pip.polygons_from_vertices(spark.createDataFrame(vertices, "objectid long, seq int, x double, y double")))
    expected = {(i, k) for i, px, py in pts for k, (x, y, s) in enumerate(boxes) if x < px < x + s and y < py < y + s}
    assert {(r.id, r.objectid) for r in got.collect()} == expected


def test_polygon_of_many_vertices_and_repeated_polygons(spark):
    """A jagged ring of 10,000 vertices with a hole, by the even-odd rule over the whole ring; points on vertices are outside."""
    rng = random.Random(2)
    ring = [(math.cos(a) * r, math.sin(a) * r) for k in range(10_000) for a, r in [(2 * math.pi * k / 10_000, 5 + rng.random())]]
    hole = [(math.cos(2 * math.pi * k / 50), math.sin(2 * math.pi * k / 50)) for k in range(50)]
    rings = [[*r, r[0]] for r in (ring, hole)]
    vertices = [(1, k, i, *p) for k, r in enumerate(rings) for i, p in enumerate(r)]
    polygons = pip.polygons_from_vertices(spark.createDataFrame(vertices, "objectid long, ring int, seq int, x double, y double"))
    points = [(i, rng.uniform(-6, 6), rng.uniform(-6, 6)) for i in range(1500)] + [(2000 + i, *ring[i * 97]) for i in range(50)]

    def odd(px, py):
        n = 0
        for r in rings:
            for (x1, y1), (x2, y2) in zip(r[:-1], r[1:]):
                n += (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1
        return n % 2 == 1

    table = spark.createDataFrame(points, "id long, lon double, lat double")
    got = [r.id for r in pip.match_polygons(table, polygons).collect()]
    assert sorted(got) == sorted(i for i, px, py in points if i < 2000 and odd(px, py))
    twice = pip.match_polygons(table, polygons.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))))
    assert sorted((r.id, r.k) for r in twice.collect()) == sorted((i, k) for i in got for k in (1, 2))


def nearest(pts, queries, k, same):
    out = set()
    for q, qx, qy in queries:
        d = sorted((float(np.sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y))), i) for i, x, y in pts if not (same and i == q))
        out |= {(q, i, r + 1) for r, (_, i) in enumerate(d[:k])}
    return out


@pytest.mark.parametrize("k", [1, 4, 30])
def test_knn_equals_brute_force(spark, k):
    rng = random.Random(k)
    pts = [(i, rng.gauss(0, 1) if i % 3 else rng.uniform(-500, 500), rng.gauss(0, 1)) for i in range(150)] + [(200 + i, 5.0, 5.0) for i in range(6)]
    far = [(900, 1e5, 1e5), (901, 0.0, 0.0)]
    schema = "id long, x double, y double"
    got = knn.knn(spark.createDataFrame(pts, schema), spark.createDataFrame(pts, schema), k, same=True)
    assert {(r.qid, r.id, r["rank"]) for r in got.collect()} == nearest(pts, pts, k, True)
    got = knn.knn(spark.createDataFrame(far, schema), spark.createDataFrame(pts, schema), k)
    assert {(r.qid, r.id, r["rank"]) for r in got.collect()} == nearest(pts, far, k, False)


def test_knn_of_nothing(spark):
    none = spark.createDataFrame([], "id long, x double, y double")
    one = spark.createDataFrame([(1, 1.0, 1.0)], "id long, x double, y double")
    assert knn.knn(one, none, 3).collect() == [] and knn.knn(none, one, 3).collect() == [] and knn.knn(one, one, 3, same=True).collect() == []


def circles(points):
    """Pairs with an empty circle, over every third point's circumcircle."""
    ids = sorted(points)
    edges = set()
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            p, q = np.array(points[ids[a]]), np.array(points[ids[b]])
            m, n, h = (p + q) / 2, np.array([-(q - p)[1], (q - p)[0]]), ((q - p) ** 2).sum() / 4
            low, high, ok = -np.inf, np.inf, True
            for c in ids:
                if c in (ids[a], ids[b]):
                    continue
                r = np.array(points[c]) - m
                s, g = r @ n, (r * r).sum() - h
                if abs(s) < 1e-12:
                    ok &= g >= 0
                elif s > 0:
                    high = min(high, g / (2 * s))
                else:
                    low = max(low, g / (2 * s))
            if ok and low <= high + 1e-12:
                edges.add((ids[a], ids[b]))
    return edges


@pytest.mark.parametrize("n,nearest", [(1, 4), (3, 4), (45, 5), (120, 12)])
def test_delaunay_equals_empty_circles(spark, n, nearest, monkeypatch):
    monkeypatch.setattr(delaunay, "CAP", 8)
    monkeypatch.setattr(delaunay, "NEAREST", nearest)
    rng = random.Random(n)
    points = {f"p{i:03d}": (rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(n)}
    rows = [(k, *v) for k, v in points.items()] + [("z", *points["p000"])]
    got = {(r.src, r.dst) for r in delaunay.delaunay_edges(spark.createDataFrame(rows, "id string, x double, y double")).collect()}
    assert got == circles(points)


def test_square_has_both_diagonals(spark):
    rows = [("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 1.0, 1.0), ("d", 0.0, 1.0)]
    got = {(r.src, r.dst) for r in delaunay.delaunay_edges(spark.createDataFrame(rows, "id string, x double, y double")).collect()}
    assert got == {("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("a", "c"), ("b", "d")}


def test_one_diagonal_is_that_of_the_least_id(spark):
    rows = [(f"g{i}{j}", float(i), float(j)) for i in range(4) for j in range(4)] + [("h0", 20.0, 0.0), ("h1", 24.0, 0.0), ("h2", 20.0, 3.0), ("h3", 24.0, 3.0), ("h4", 22.0, 1.5 + 2.5)]
    got = {(r.src, r.dst) for r in delaunay.delaunay_edges(spark.createDataFrame(rows, "id string, x double, y double"), one_diagonal=True).collect()}
    at = {k: (x, y) for k, x, y in rows}
    diagonals = {(a, b) for a, b in got if a[0] == b[0] == "g" and at[a][0] != at[b][0] and at[a][1] != at[b][1]}
    assert diagonals == {(f"g{i}{j}", f"g{i + 1}{j + 1}") for i in range(3) for j in range(3)}
    assert ("h0", "h3") in got and ("h1", "h2") not in got
    # a triangulation: 3 n - 3 - h edges, h of 21 points on the hull or its sides
    assert got <= circles(at)


def test_same_unit_cap_counts_before_the_unit(spark):
    rows = [("a", 0.0, 0.0, "u"), ("b", 1.0, 0.0, "v"), ("c", 2.0, 0.0, "u"), ("d", 3.0, 0.0, ""), ("e", 4.0, 0.0, "")]
    df = spark.createDataFrame(rows, "id string, x double, y double, unit string")
    assert graph.same_unit_edges(df, k=2).collect() == []
    assert [(r.src, r.dst, r.weight) for r in graph.same_unit_edges(df, k=3).collect()] == [("a", "c", 1.0)]


def test_vincenty_known_lines():
    lon1, lat1, lon2, lat2 = (np.array(v, float) for v in ((0, 144.42486788, 10, 0), (0, -37.95103341, 50, 0), (1, 143.92649552, 10, 180), (0, -37.65282113, 50, 0)))
    got = vincenty_m(lon1, lat1, lon2, lat2)
    assert got[0] == pytest.approx(111319.491, abs=0.01) and got[1] == pytest.approx(54972.271, abs=0.05) and got[2] == 0 and 1.9e7 < got[3] < 2.1e7


def test_haversine_fixed_values(spark):
    """A degree of the equator and of a meridian, a quarter and half of a great circle: R times the angle."""
    lines = {(0, 0, 1, 0): 111195.0802, (10, 45, 10, 46): 111195.0802, (0, 0, 90, 0): 10007557.2210, (0, -90, 0, 90): 20015114.4420, (-74.5, 40.0, -74.5, 40.0): 0.0}
    rows = spark.createDataFrame([tuple(map(float, k)) for k in lines], "a double, b double, c double, d double")
    got = [r[0] for r in rows.select(F.expr(geo.haversine_sql("a", "b", "c", "d"))).collect()]
    assert got == pytest.approx(list(lines.values()), abs=1e-3)


def test_null_geometry_is_flagged(spark):
    rows = spark.createDataFrame([(None, None, None, None), (-80.0, 40.0, None, None), (-74.5, 40.0, 0.0, 0.0), (-74.5, 40.0, None, None)], "lon double, lat double, point_x double, point_y double")
    assert [r.coord_quality_flag for r in normalize.coord_quality(rows).collect()] == ["no_geom", "out_of_nj_bbox", "xy_geom_mismatch", "ok"]
    assert rows.select(F.lit(1)).count() == 4


def test_delaunay_of_crowded_places_and_lines(spark, monkeypatch):
    """A dense cluster far from a few others, a grid of cocircular points, and points on one line."""
    monkeypatch.setattr(delaunay, "FOUND", 3)
    rng = random.Random(8)
    crowd = {f"c{i:02d}": (5000 + rng.gauss(0, 1), 5000 + rng.gauss(0, 1)) for i in range(70)} | {f"f{i}": (rng.uniform(0, 9000), rng.uniform(0, 9000)) for i in range(12)}
    grid = {f"g{i}{j}": (float(i), float(j)) for i in range(6) for j in range(6)}
    line = {f"l{i}": (float(i * i), 3.0) for i in range(8)}
    for points in (crowd, grid, line):
        df = spark.createDataFrame([(k, *v) for k, v in points.items()], "id string, x double, y double")
        assert {(r.src, r.dst) for r in delaunay.delaunay_edges(df).collect()} == circles(points)


def test_knn_of_many_points_in_one_place(spark):
    """Ties by id, the point itself passed over, though most of the place's points are never candidates."""
    places = [(f"a{i:03d}", 5.0, 5.0) for i in range(200)] + [(f"b{i}", 5.0 + i, 6.0) for i in range(5)]
    df = spark.createDataFrame(places, "id string, x double, y double")
    got = {}
    for r in knn.knn(df, df, 3, same=True).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    at = {i: (x, y) for i, x, y in places}
    for q, near in got.items():
        order = sorted((math.dist(at[q], at[i]), i) for i in at if i != q)
        assert near == [i for _, i in order[:3]]
    assert len(got) == len(places)


def test_open_cells_ask_the_nearest_leaves_first(spark, monkeypatch):
    """Points on a ring around a few: cells of the ring are unbounded, and all leaves lie beyond some edge."""
    import math

    from stratalake.operators import delaunay

    rng = random.Random(12)
    points = [(f"p{i:04d}", 1000 * math.cos(i / 100) + rng.random(), 1000 * math.sin(i / 100) + rng.random()) for i in range(620)] + [(f"q{i}", rng.uniform(-300, 300), rng.uniform(-300, 300)) for i in range(200)]
    table = spark.createDataFrame(points, "id string, x double, y double")
    asked, inner = [], delaunay._found

    def counted(at, rows):
        asked.append(at.join(rows, "leaf").count())
        return inner(at, rows)

    monkeypatch.setattr(delaunay, "CAP", 16)
    monkeypatch.setattr(delaunay, "_found", counted)
    few = {(r.src, r.dst) for r in delaunay.delaunay_edges(table).collect()}
    low = sum(asked)
    asked.clear()
    monkeypatch.setattr(delaunay, "FIRST", 1 << 20)
    assert few == {(r.src, r.dst) for r in delaunay.delaunay_edges(table).collect()} and low < sum(asked)
