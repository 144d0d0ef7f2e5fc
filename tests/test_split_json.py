import json
import random

import pytest

from stratalake.sources import geojson
from stratalake.sources.split_json import feature_texts


def collection(count, seed=1):
    """Features with braces, quotes and backslashes in their texts, nested values and long geometries."""
    rng = random.Random(seed)
    odd = ['}', '{"', '\\', '\\"}', '],[{', 'plain', '', 'ü – 線 }', '"features": [{']
    features = []
    for k in range(count):
        ring = [[round(rng.uniform(-75, -74), 6), round(rng.uniform(39, 41), 6)] for _ in range(rng.choice([4, 30, 400]))]
        properties = {"OBJECTID": str(k), "TEXT": "".join(rng.choices(odd, k=rng.randrange(9))), "more": {"a": [{"b": 1}, {"c": "}"}]}}
        features.append({"type": "Feature", "properties": properties, "geometry": rng.choice([None, {"type": "Polygon", "coordinates": [ring]}])})
    other = {"lists": [[{"k": k, "of": [{"x": "}]"}]} for k in range(120)]]}  # objects beside the features, longer than a block
    head = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x{}"}}, "other": other, "links": [{"href": "a}"}]}
    return {**head, "features": features, "after": [1, {"x": "}"}], "more": other}


@pytest.fixture
def split_bytes(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, str(size))
    spark.conf.set(name, before)


@pytest.mark.parametrize("indent, size", [(None, 1 << 27), (None, 20_000), (2, 3_000), (None, 701), (1, 20_000)])
@pytest.mark.parametrize("ascii_only", [True, False])
def test_a_file_in_parts_is_the_file(spark, tmp_path, split_bytes, indent, size, ascii_only):
    whole = collection(60)
    (tmp_path / "a.json").write_text(json.dumps(whole, indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(collection(7, 2)) + "\n", encoding="utf-8")
    split_bytes(size)
    texts = [json.loads(r.text) for r in feature_texts(spark, str(tmp_path)).collect()]
    got = sorted((json.dumps(t) for t in texts if t.get("type") == "Feature"))
    assert got == sorted(json.dumps(f) for f in whole["features"] + collection(7, 2)["features"])
    rows = geojson.read_features(spark, str(tmp_path)).collect()
    assert sorted((r.properties["OBJECTID"], r.properties["TEXT"]) for r in rows) == sorted((f["properties"]["OBJECTID"], f["properties"]["TEXT"]) for f in whole["features"] + collection(7, 2)["features"])


def test_blocks_by_sort_and_parts_in_number(spark, tmp_path, split_bytes):
    whole = collection(40, 3)
    text = json.dumps(whole)
    (tmp_path / "a.json").write_text(text)
    split_bytes(len(text) // 8 + 1)
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() == 8
    texts = [json.loads(r.text) for r in feature_texts(spark, str(tmp_path), broadcast_rows=0).collect()]
    assert sorted(t["properties"]["OBJECTID"] for t in texts if t.get("type") == "Feature") == sorted(str(k) for k in range(40))


@pytest.mark.parametrize("text, count", [("", 0), ("{}", 0), ('{"features": []}', 0), ('{"features": null}', 0), ('{"features": [{"properties": null, "geometry": null, "type": "Feature"}]}', 1), ('{"features": [{"properties": {"a": "1"}}, {"properties": {"a"', 1)])
def test_small_and_broken_files(spark, tmp_path, text, count):
    (tmp_path / "a.json").write_text(text)
    assert geojson.read_features(spark, str(tmp_path)).where("properties IS NULL OR properties['a'] IS NOT NULL").count() == count
