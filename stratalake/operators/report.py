"""Counts and coverage for reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def coverage(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row: total, and per name the non-null count of a column and its percentage."""
    total = F.count(F.lit(1))
    return rows.agg(total.alias("total"), *[e for name, c in columns.items() for e in (F.count(c).alias(f"with_{name}"), F.round(F.try_divide(100.0 * F.count(c), total), 2).alias(f"pct_{name}"))])


def non_null_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n)"""
    one = rows.agg(*[F.count(c).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns])).alias("e")).select("e.*")


def table_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table; counts run in one job."""
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in sorted(tables.items())))


def bounding_box(points: DataFrame) -> DataFrame:
    return points.agg(*[F.round(f(c), 3).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lon", "lat")])


def occupied_cells(points: DataFrame) -> DataFrame:
    """One row: occupied cells of a hundredth and of a tenth of a degree, and the fullest of the former."""
    placed = points.where("lon IS NOT NULL")

    def cells(digits: int) -> DataFrame:
        return placed.groupBy(F.round("lon", digits), F.round("lat", digits)).agg(F.count(F.lit(1)).alias("c"))

    fine = cells(2).agg(F.count(F.lit(1)).alias("cells_001"), F.max("c").alias("max_per_cell"))
    return fine.crossJoin(cells(1).agg(F.count(F.lit(1)).alias("cells_01")))  # one row each


def top_units(rows: DataFrame, column: str, k: int = 8) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def node_features(borings: DataFrame, covariates: DataFrame, dem: DataFrame, strata: DataFrame, own_elevation: Column | None = None) -> DataFrame:
    """Borings with covariates, elevation (the sampled one first) and their number of intervals."""
    n = strata.groupBy("boring_id").agg(F.count(F.lit(1)).alias("n_intervals"))
    rows = borings.join(covariates.withColumnRenamed("id", "boring_id"), "boring_id", "left").join(dem, "boring_id", "left").join(n, "boring_id", "left")
    elevation = F.col("elevation_m") if own_elevation is None else F.coalesce("elevation_m", own_elevation)
    return rows.withColumn("elevation", elevation).select(
        "boring_id", "lon", "lat", "elevation", "slope_deg", "coord_quality_flag", "surficial_unit", "surficial_lithology", "surficial_age", "bedrock_unit",
        "ssurgo_mukey", "ssurgo_muname", "ssurgo_component", "ssurgo_drainagecl", "ssurgo_hydgrp", "n_intervals",
    )
