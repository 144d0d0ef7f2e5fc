"""Point-in-polygon join on a grid.

The boxes of polygons, not their rings, are spread over the grid cells that they cover; points have one cell.  An equi-join on the cell
gives the polygons whose box holds the point.  A polygon's segments lie in strips of its height, about ``PER_STRIP`` of them in each, and a second
equi-join brings the point together with the one strip that it lies in: no other segment can cross its ray.  So a ring
travels once, whatever its size, and a test reads a strip of it; results are those of the whole ring to the last bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake.functions.geo import inside

PER_STRIP = 16


def polygons_from_vertices(vertices: DataFrame) -> DataFrame:
    """(objectid, rings) from rows (objectid, seq, x, y[, ring]); vertices in order of seq."""
    ring = F.col("ring") if "ring" in vertices.columns else F.lit(0)
    rings = vertices.groupBy("objectid", ring.alias("ring")).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("v"))
    one = F.struct("ring", F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("v"))
    return rings.groupBy("objectid").agg(F.transform(F.array_sort(F.collect_list(one)), lambda r: r["v"]).alias("rings"))


def _cells(lo: Column, hi: Column, side: Column) -> Column:
    return F.sequence(F.floor(lo / side), F.floor(hi / side))


def match_polygons(points: DataFrame, polygons: DataFrame, x: str = "lon", y: str = "lat", base: float = 0.01) -> DataFrame:
    """All pairs (columns of both) with the point strictly inside; points without coordinates match nothing.

    A polygon's level is the power of two of ``base`` that its larger box side needs, so it covers at most
    3 x 3 cells; points look up the levels that occur, whose number grows with the log of the size range.
    """
    every = F.flatten("rings")
    xs, ys = F.transform(every, lambda p: p["x"]), F.transform(every, lambda p: p["y"])
    boxed = polygons.withColumns({"_x0": F.array_min(xs), "_x1": F.array_max(xs), "_y0": F.array_min(ys), "_y1": F.array_max(ys), "_key": F.xxhash64("objectid", "rings"), "_strips": F.ceil(F.size(xs) / PER_STRIP).cast("int")})
    widest = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"), F.lit(base))
    boxed = boxed.withColumn("_level", F.ceil(F.log2(widest / base)).cast("int"))
    side = base * F.pow(F.lit(2.0), "_level")

    def strip(v: Column) -> Column:
        # never falls as v rises, so a segment is in the strips of its ends and all between
        return F.least(F.col("_strips") - 1, F.coalesce(F.floor(F.try_divide(v - F.col("_y0"), F.col("_y1") - F.col("_y0")) * F.col("_strips")), F.lit(0)).cast("int"))

    shapes = boxed.dropDuplicates(["_key"]).select("_key", "_strips", "_y0", "_y1", F.explode("rings").alias("r"))
    ends = F.zip_with(F.slice("r", 1, F.size("r") - 1), F.slice("r", 2, F.size("r") - 1), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    segments = shapes.where(F.size("r") > 1).select("_key", "_strips", "_y0", "_y1", F.explode(ends).alias("s"))
    reached = F.explode(F.sequence(strip(F.least("s.y1", "s.y2")), strip(F.greatest("s.y1", "s.y2"))))
    strips = segments.select("_key", reached.alias("_strip"), "s").groupBy("_key", "_strip").agg(F.collect_list("s").alias("_segments"))
    spread = boxed.drop("rings").withColumn("_cx", F.explode(_cells(F.col("_x0"), F.col("_x1"), side))).withColumn("_cy", F.explode(_cells(F.col("_y0"), F.col("_y1"), side)))
    levels = boxed.agg(F.sort_array(F.collect_set("_level")).alias("l")).first()["l"]
    at = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
    at = at.withColumns({"_cx": F.floor(F.col(x) / side), "_cy": F.floor(F.col(y) / side)})
    near = F.col(x).between(F.col("_x0"), F.col("_x1")) & F.col(y).between(F.col("_y0"), F.col("_y1"))
    met = at.join(spread, ["_level", "_cx", "_cy"]).where(near).withColumn("_strip", strip(F.col(y)))
    hit = met.join(strips, ["_key", "_strip"]).where(inside(F.col(x), F.col(y), F.col("_segments")))
    return hit.drop("_level", "_cx", "_cy", "_x0", "_x1", "_y0", "_y1", "_key", "_strip", "_strips", "_segments")


def first_of_shape(polygons: DataFrame, *order: str) -> DataFrame:
    """``polygons`` with one row of those of equal rings, the first in the given order.

    They hold the same points, so where only the first over a point counts, no other of them can be it: pairs of points and polygons
    then grow with the shapes over a place, not with their copies.
    """
    own = [c for c in polygons.columns if c != "rings"]
    return polygons.groupBy("rings").agg(F.min_by(F.struct(*own), F.struct(*order)).alias("u")).select(*[F.col(f"u.{c}").alias(c) for c in own], "rings")


def dominant_component(component: DataFrame) -> DataFrame:
    """Per mapunit its component of the largest share (nulls last, then cokey)."""
    w = Window.partitionBy("mukey").orderBy(F.desc_nulls_last("comppct_r"), "cokey")
    return component.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def point_covariates(points: DataFrame, point_id: str, surficial: DataFrame, bedrock: DataFrame, ssurgo: DataFrame, component: DataFrame, muaggatt: DataFrame) -> DataFrame:
    """One row per point with the units over it; of several, mukey (nulls last), then surficial, then bedrock decide."""
    ids = points.select(F.col(point_id).alias("id"), "lon", "lat")
    at = {
        "s": match_polygons(ids, first_of_shape(surficial, "objectid")).select("id", F.col("objectid").alias("s_id"), F.col("geoname").alias("surficial_unit"), F.col("lithology").alias("surficial_lithology"), F.col("geoage").alias("surficial_age")),
        "b": match_polygons(ids, first_of_shape(bedrock, "objectid")).select("id", F.col("objectid").alias("b_id"), F.col("geoname").alias("bedrock_unit"), F.col("lithology").alias("bedrock_lithology")),
        "m": match_polygons(ids, first_of_shape(ssurgo, "mukey", "objectid")).select("id", F.col("objectid").alias("m_id"), F.col("mukey").alias("ssurgo_mukey"), F.col("muname").alias("ssurgo_muname")),
    }
    # the row that the combined order picks has the least of each layer, so layers reduce before they meet
    order = {"s": ["s_id"], "b": ["b_id"], "m": ["ssurgo_mukey", "m_id"]}
    out = ids.select("id").distinct()
    for k, matched in at.items():
        w = Window.partitionBy("id").orderBy(*order[k])
        out = out.join(matched.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", f"{k}_id"), "id", "left")
    dom = dominant_component(component).select(F.col("mukey").alias("ssurgo_mukey"), F.col("compname").alias("ssurgo_component"), F.col("drainagecl").alias("ssurgo_drainagecl"))
    agg = muaggatt.select(F.col("mukey").alias("ssurgo_mukey"), F.col("hydgrpdcd").alias("ssurgo_hydgrp"))
    return out.join(dom, "ssurgo_mukey", "left").join(agg, "ssurgo_mukey", "left").select(
        "id", "surficial_unit", "surficial_lithology", "surficial_age", "bedrock_unit", "bedrock_lithology", "ssurgo_mukey", "ssurgo_muname", "ssurgo_component", "ssurgo_drainagecl", "ssurgo_hydgrp"
    )
