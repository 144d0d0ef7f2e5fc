"""Registered graphs with all edge types."""

import functools
import random
from types import SimpleNamespace

import pytest
from test_geometry import circles

import __spark_entry__ as entry
from stratalake.operators import ensembles, evaluate, graph
from stratalake.plans import learning, spatial


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    spot = lambda: (rng.uniform(0, 1000), rng.uniform(0, 1000))
    borings = [(f"p{i}", *spot(), "u") for i in range(25)]
    labels = [(i, *spot(), "u", "ab"[i % 2]) for i in range(12)]
    return SimpleNamespace(
        spark=spark,
        borings=spark.createDataFrame(borings, "boring_id string, x_ft double, y_ft double, pid string").coalesce(1),
        soil_labels=spark.createDataFrame(labels, "objectid long, x_ft double, y_ft double, primary_label string, drainage string").coalesce(1),
    )


def test_union_graph_has_delaunay_edges(tables):
    points = {f"b:{r[0]}": (r[1], r[2]) for r in tables.borings.collect()} | {f"l:{r[0]}": (r[1], r[2]) for r in tables.soil_labels.collect()}
    rows = spatial.union_graph(tables).collect()
    assert {(r.src, r.dst) for r in rows if r.edge_type == "delaunay"} == circles(points)
    assert {r.edge_type for r in rows} == {"knn", "delaunay", "same_geology", "label_boring"}


def test_few_points_make_no_graph_if_asked(spark):
    points = spark.createDataFrame([(f"p{i}", float(i), float(i * i), "u") for i in range(9)], "id string, x double, y double, unit string")
    assert graph.boring_graph(points, few_points=False).collect() == [] and graph.boring_graph(points).count() > 0
    assert graph.boring_graph(points, k=7, few_points=False).count() > 0


def test_graph_model_sees_the_whole_graph(tables, monkeypatch):
    seen, context = [], graph.graph_context
    monkeypatch.setattr(graph, "graph_context", lambda edges, *a, **k: seen.append({r.edge_type for r in edges.select("edge_type").distinct().collect()}) or context(edges, *a, **k))
    monkeypatch.setattr(ensembles, "forest", functools.partial(ensembles.forest, trees=2, batch=2))
    monkeypatch.setattr(evaluate, "spatial_runs", functools.partial(evaluate.spatial_runs, size=100.0))
    assert learning.graph_model_baseline(tables).count() == 12
    assert seen == [{"knn", "delaunay", "same_geology", "label_boring"}]
