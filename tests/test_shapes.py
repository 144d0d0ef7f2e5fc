"""Copies of polygons do not multiply the pairs that covariates are picked from."""

from pyspark.sql import functions as F

from stratalake.operators import pip


def _squares(spark, rows):
    ring = "array(named_struct('x', {0}D, 'y', 0D), named_struct('x', {0}D, 'y', 1D), named_struct('x', {0}D + 1, 'y', 1D), named_struct('x', {0}D + 1, 'y', 0D), named_struct('x', {0}D, 'y', 0D))"
    flat = spark.createDataFrame(rows, "objectid long, mukey string, at double")
    return flat.withColumn("rings", F.expr("array(" + ring.replace("{0}D", "at") + ")")).drop("at")


def test_first_of_equal_rings(spark):
    rows = [(i, str(9 - i % 3), float(i % 2)) for i in range(12)] + [(99, "0", 0.5)]
    polygons = _squares(spark, rows)
    kept = pip.first_of_shape(polygons, "mukey", "objectid")
    assert kept.columns == polygons.columns
    assert sorted((r["mukey"], r["objectid"]) for r in kept.collect()) == [("0", 99), ("7", 2), ("7", 5)]
    points = spark.createDataFrame([(1, 0.25, 0.5), (2, 1.75, 0.5), (3, 0.75, 0.5)], "id long, lon double, lat double")
    best = lambda p: {r["id"]: r["m"] for r in pip.match_polygons(points, p).groupBy("id").agg(F.min(F.struct("mukey", "objectid")).alias("m")).collect()}
    assert best(kept) == best(polygons)
    assert pip.match_polygons(points, kept).count() == 4 and pip.match_polygons(points, polygons).count() == 19
