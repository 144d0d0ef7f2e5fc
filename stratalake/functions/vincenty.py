"""Vincenty's inverse formula on WGS-84: iterative, so a vectorised pandas UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.functions.geo import haversine_sql

_A, _F = 6378137.0, 1 / 298.257223563
_B = _A * (1 - _F)


def vincenty_m(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray, rounds: int = 200, tolerance: float = 1e-12) -> np.ndarray:
    """Metres between points in degrees; where it does not converge, haversine; coincident points 0; NaN in, NaN out."""
    p1, p2, dl = np.radians(lat1), np.radians(lat2), np.radians(lon2 - lon1)
    u1, u2 = np.arctan((1 - _F) * np.tan(p1)), np.arctan((1 - _F) * np.tan(p2))
    lam, open_ = dl.copy(), np.ones(len(dl), bool)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            sin_s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            s = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / sin_s)
            cos2_a = 1 - sin_a**2
            cos_2m = np.where(cos2_a == 0, 0, cos_s - 2 * np.sin(u1) * np.sin(u2) / cos2_a)
            c = _F / 16 * cos2_a * (4 + _F * (4 - 3 * cos2_a))
            new = dl + (1 - c) * _F * sin_a * (s + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m**2 - 1)))
            change = np.abs(new - lam)
            lam = np.where(open_, new, lam)
            open_ &= ~(change < tolerance)
            if not open_.any():
                break
        k = cos2_a * (_A**2 - _B**2) / _B**2
        big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        ds = small * sin_s * (cos_2m + small / 4 * (cos_s * (2 * cos_2m**2 - 1) - small / 6 * cos_2m * (4 * sin_s**2 - 3) * (4 * cos_2m**2 - 3)))
        out = _B * big * (s - ds)
        h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(dl / 2) ** 2
        flat = 2 * 6371008.8 * np.arcsin(np.minimum(np.sqrt(h), 1))
    out = np.where(open_ | ~np.isfinite(out), flat, out)
    return np.where((lon1 == lon2) & (lat1 == lat2), 0.0, out)


def vincenty(lon1: str, lat1: str, lon2: str, lat2: str) -> Column:
    """Metres between two columns of points."""

    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(vincenty_m(*(s.to_numpy(float) for s in (a, b, c, d))))

    return F.pandas_udf(run, "double")(lon1, lat1, lon2, lat2)


def edge_lengths(edges: DataFrame, nodes: DataFrame, method: str = "haversine") -> DataFrame:
    """``edges`` (src, dst) with metres between their ends, from ``nodes`` (id, lon, lat)."""
    a = nodes.select(F.col("id").alias("src"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    b = nodes.select(F.col("id").alias("dst"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    ends = edges.join(a, "src").join(b, "dst")
    flat = F.expr(haversine_sql("lon1", "lat1", "lon2", "lat2"))
    metres = flat if method == "haversine" else vincenty("lon1", "lat1", "lon2", "lat2")
    return ends.withColumn("metres", metres).drop("lon1", "lat1", "lon2", "lat2")
