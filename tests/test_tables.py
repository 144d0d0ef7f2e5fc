import json
import time

import pytest
from pyspark.sql import functions as F

from stratalake.operators import features, metrics, normalize
from stratalake.sources import geojson, tables
from stratalake.streaming.ingest import ingest_logs, ingest_pages


def page(*features_):
    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": g} for p, g in features_]})


def test_page_files(spark, tmp_path):
    (tmp_path / "0.json").write_text(page(({"OBJECTID": "1", "SRCE": "3.7", "LID": ""}, {"type": "Point", "coordinates": [-74.5, 40.0]}), ({"OBJECTID": "x"}, None)))
    (tmp_path / "2000.json").write_text(page(({"OBJECTID": "7", "POINT_X": "1e3"}, None)))
    rows = geojson.page_rows(geojson.read_pages(spark, str(tmp_path)), "borings").orderBy("src_offset", F.desc_nulls_last("objectid")).collect()
    assert [(r.src_offset, r.objectid, r.srce, r.lid, r.point_x, r.lon) for r in rows] == [(0, 1, None, None, None, -74.5), (0, None, None, None, None, None), (2000, 7, None, None, 1000.0, None)]


def test_polygons_of_both_kinds(spark):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    texts = [json.dumps({"type": "Polygon", "coordinates": [ring, ring]}), json.dumps({"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}), json.dumps({"type": "Point", "coordinates": [1, 2]}), None]
    got = spark.createDataFrame([(t,) for t in texts], "g string").select(F.size(geojson.geometry_polygon(F.col("g"))).alias("n")).collect()
    assert [r.n for r in got][:2] == [2, 3] and all(r.n in (None, -1) for r in got[2:])


def test_file_inventory(spark, tmp_path):
    (tmp_path / "B1__2__3.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "B2__2__3.pdf").write_bytes(b"<html>")
    rows = tables.file_inventory(spark, str(tmp_path)).select(tables.id_from_filename(F.col("path")).alias("id"), "is_pdf", "bytes").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("B1", True, 10), ("B2", False, 6)]


def test_page_replace_on_disk(spark, tmp_path):
    rows = lambda data: spark.createDataFrame(data, "v int, src_offset long")
    path = f"{tmp_path}/t"
    read = lambda: sorted((r.v, r.src_offset) for r in tables.read_buckets(spark, path, "v int, src_offset long").collect())
    assert read() == []
    tables.write_pages(rows([(1, 0), (2, 200), (3, 200)]), path)
    tables.write_pages(rows([(9, 200)]), path)
    assert read() == [(1, 0), (9, 200)]
    # a page that comes without rows is emptied, also if it was alone in its folder
    tables.write_pages(rows([(5, 400)]), path, rows([(0, 200), (0, 400)]))
    assert read() == [(1, 0), (5, 400)]
    tables.write_pages(rows([]), path, rows([(0, 0), (0, 400)]))
    assert read() == []


def test_refresh_tells_of_other_counts(spark, tmp_path):
    (tmp_path / "a.json").write_text(page(({"k": "1"}, None), ({"k": "2"}, None)))
    assert geojson.refresh_layer(spark, f"{tmp_path}/a.json", f"{tmp_path}/layer", 2)
    assert not geojson.refresh_layer(spark, f"{tmp_path}/a.json", f"{tmp_path}/layer", 3)
    assert spark.read.parquet(f"{tmp_path}/layer").count() == 2


def test_vocabulary_and_metric_sinks(spark, tmp_path):
    vocabulary = features.vocabulary(spark.createDataFrame([("b",), ("a",), ("",), (None,)], "unit string"), ["unit"])
    tables.write_vocabulary(vocabulary, f"{tmp_path}/v")
    assert sorted(map(tuple, spark.read.json(f"{tmp_path}/v").select("column", "value", "idx").collect())) == [("unit", "a", 2), ("unit", "b", 3)]
    tables.write_metrics(spark.createDataFrame([("rf", 0, "f1", 0.5)], "tag string, fold int, metric string, value double"), f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").first().value == 0.5


def test_ids_and_page_numbers(spark):
    rows = spark.createDataFrame([("L1", 1, "7"), (None, 2, "x"), (None, 3, "")], "lid string, objectid long, page string")
    got = rows.select(normalize.fallback_id(F.col("lid"), F.col("objectid")).alias("id"), normalize.page_number(F.col("page")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("L1", 7), ("OID-2", None), ("OID-3", None)]


def test_edge_and_feature_sinks(spark, tmp_path):
    edges = spark.createDataFrame([("b", "c", "knn", 0.5), ("a", "b", "knn", 0.1), ("a", "c", "unit", 1.0)], "src string, dst string, edge_type string, weight double")
    tables.write_edges(edges, f"{tmp_path}/e")
    assert spark.read.parquet(f"{tmp_path}/e").count() == 3
    geojson.write_features(spark.createDataFrame([(1, 2.0, 3.0), (2, None, 1.0)], "id long, lon double, lat double"), f"{tmp_path}/f")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/f").collect()]
    assert lines == [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [2.0, 3.0]}, "properties": {"id": 1}}]


def test_upsert_keeps_other_columns(spark):
    table = spark.createDataFrame([(1, "a", 5.0), (2, "b", 6.0)], "k int, name string, elevation double")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, name string")
    assert sorted(map(tuple, normalize.upsert(table, new, ["k"], ["name"]).collect())) == [(1, "a", 5.0), (2, "B", 6.0), (3, "C", None)]


def test_leaky_columns_are_refused():
    assert normalize.guard_features(["cn", "depth"]) == ["cn", "depth"]
    with pytest.raises(ValueError):
        normalize.guard_features(["cn", "n1_60"])
    assert not set(normalize.SAFE_COLUMNS) & set(normalize.LEAKY_COLUMNS)


def test_folds_keep_blocks_whole(spark):
    import random

    rng = random.Random(4)
    rows = [(str(i), rng.uniform(0, 2e5), rng.uniform(0, 2e5), rng.randrange(20) if i % 9 else None) for i in range(1000)]
    got = features.spatial_kfold(spark.createDataFrame(rows, "id string, x double, y double, class_id int"))
    per_block = got.groupBy("block").agg(F.countDistinct("fold").alias("n")).agg(F.max("n")).first()[0]
    sizes = [r["count"] for r in got.groupBy("fold").count().collect()]
    assert per_block == 1 and len(sizes) == 5 and max(sizes) < 2 * min(sizes)
    with pytest.raises(ValueError, match="larger size"):
        features.spatial_kfold(got.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1).alias("class_id")), most=0)
    roles = features.fold_roles(got).groupBy("id").pivot("role").count().select("test", "val", "train").distinct().collect()
    assert [tuple(r) for r in roles] == [(1, 1, 3)]


def test_metrics_of_few_rows(spark):
    rows = spark.createDataFrame([(0, [0.7, 0.2, 0.1, 0.0]), (1, [0.4, 0.4, 0.1, 0.1]), (3, [0.3, 0.3, 0.3, 0.1])], "y int, probs array<double>")
    m = metrics.classification_metrics(rows).first()
    assert (m.n, m.accuracy, m.top3_accuracy) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3))
    assert metrics.uncertainty_auroc(rows.where("y = 0")).first().auroc is None
    assert metrics.gaussian_crps(spark.createDataFrame([(0.0, 1.0, 0.0)], "mu double, sigma double, y double")).first().crps == pytest.approx(0.2336949, abs=1e-6)


def test_ingestion_resumes_and_replaces(spark, tmp_path):
    def land(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")

    run = lambda: ingest_pages(spark, f"{tmp_path}/pages", f"{tmp_path}/table", f"{tmp_path}/check")
    land("pages", [(0, page(({"OBJECTID": "1"}, None), ({"OBJECTID": "2"}, None))), (200, page(({"OBJECTID": "3"}, None)))], "src_offset bigint, payload string")
    run()
    run()
    assert sorted(r.objectid for r in tables.read_buckets(spark, f"{tmp_path}/table").collect()) == [1, 2, 3]
    land("pages", [(0, page(({"OBJECTID": "9"}, None)))], "src_offset bigint, payload string")
    run()
    assert sorted(r.objectid for r in tables.read_buckets(spark, f"{tmp_path}/table").collect()) == [3, 9]
    # twice in one batch: the one that landed last counts, whatever its text; an empty page empties its offset
    land("pages", [(0, page(({"OBJECTID": "8"}, None))), (200, page(({"OBJECTID": "99"}, None)))], "src_offset bigint, payload string")
    time.sleep(0.05)
    land("pages", [(0, page(({"OBJECTID": "7"}, None))), (200, page())], "src_offset bigint, payload string")
    run()
    assert sorted(r.objectid for r in tables.read_buckets(spark, f"{tmp_path}/table").collect()) == [7]
    land("logs", [("b", "0 - 2 SM\n2 - 4 CL")], "boring_id string, text string")
    ingest_logs(spark, f"{tmp_path}/logs", f"{tmp_path}/strata", f"{tmp_path}/check2")
    land("logs", [("b", "0 - 3 SP")], "boring_id string, text string")
    ingest_logs(spark, f"{tmp_path}/logs", f"{tmp_path}/strata", f"{tmp_path}/check2")
    assert [(r.top_depth, r.bottom_depth, r.uscs_class) for r in tables.read_buckets(spark, f"{tmp_path}/strata").collect()] == [(0, 3, "SP")]
    land("logs", [("b", "nothing of the kind"), ("c", "0 - 1 ML")], "boring_id string, text string")
    ingest_logs(spark, f"{tmp_path}/logs", f"{tmp_path}/strata", f"{tmp_path}/check2")
    assert [(r.boring_id, r.uscs_class) for r in tables.read_buckets(spark, f"{tmp_path}/strata").collect()] == [("c", "ML")]


def test_a_failure_before_the_swap_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    read = lambda: sorted(map(tuple, tables.read_buckets(spark, path, "k long, v string").collect()))
    first = rows(*[(k, "old") for k in range(20)])
    tables.replace_on_disk(first, first, path, "k", buckets=4)
    before = read()
    commit = tables._commit

    def fails(*a):
        raise OSError("the driver died")

    monkeypatch.setattr(tables, "_commit", fails)
    change = rows((3, "new"), (50, "new"))
    with pytest.raises(OSError):
        tables.replace_on_disk(change, change, path, "k")
    assert read() == before
    monkeypatch.setattr(tables, "_commit", commit)
    tables.replace_on_disk(change, change, path, "k")
    assert read() == sorted([(k, "old") for k in range(20) if k != 3] + [(3, "new"), (50, "new")])


def test_a_replayed_batch_does_nothing_and_two_writers_clash(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    tables.replace_on_disk(rows((1, "a")), rows((1, "a")), path, "k", batch=("s", 0))
    tables.replace_on_disk(rows((1, "b")), rows((1, "b")), path, "k", batch=("s", 0))
    assert [r.v for r in tables.read_buckets(spark, path).collect()] == ["a"]
    stale = tables._manifest(spark, path)
    tables.replace_on_disk(rows((1, "c")), rows((1, "c")), path, "k", batch=("s", 1))
    monkeypatch.setattr(tables, "_manifest", lambda *a: stale)
    with pytest.raises(RuntimeError, match="another writer"):
        tables.replace_on_disk(rows((1, "d")), rows((1, "d")), path, "k")
    monkeypatch.undo()
    assert [r.v for r in tables.read_buckets(spark, path).collect()] == ["c"]


def test_full_buckets_split_and_old_folders_go(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    first = rows(*[(k, f"v{k}") for k in range(300)])
    tables.replace_on_disk(first, first, path, "k", buckets=2, most_bytes=100)
    for step in range(3):
        change = rows((step, "x"))
        tables.replace_on_disk(change, change, path, "k", most_bytes=100)
    state = tables._manifest(spark, path)
    assert state["count"] == 16 and state["version"] == 4
    assert sorted(map(tuple, tables.read_buckets(spark, path).collect())) == sorted((k, "x" if k < 3 else f"v{k}") for k in range(300))
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2 and len([f for f in (tmp_path / "t" / "_manifests").iterdir() if f.suffix == ".json"]) == 2
    # an emptied table is empty
    tables.replace_on_disk(first.limit(0), first, path, "k", most_bytes=1 << 30)
    assert tables.read_buckets(spark, path, "k long, v string").count() == 0
