"""Geometry and distance as Column expressions; SQL texts where Spark and DuckDB read the same."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the New Jersey state plane (US survey feet) on GRS80.
A, INV_F = 6378137.0, 298.257222101
LAT0, LON0, K0, FALSE_EASTING_M, FT_PER_M = math.radians(38 + 50 / 60), math.radians(-74.5), 0.9999, 150000.0, 3937 / 1200
#: Mean earth radius in metres, and feet in a metre of the radius parameters.
EARTH_M, FEET = 6371008.8, 3.280839895
E2 = (2 - 1 / INV_F) / INV_F
EP2 = E2 / (1 - E2)


def _arc_terms() -> tuple[float, ...]:
    """Factors of lat, sin 2 lat, sin 4 lat and sin 6 lat in the meridian arc length."""
    e4, e6 = E2 * E2, E2**3
    return 1 - E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256, -(3 * E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024), 15 * e4 / 256 + 45 * e6 / 1024, -(35 * e6 / 3072)


def _arc(lat: str) -> str:
    """Meridian arc length from the equator."""
    t = _arc_terms()
    return f"({A!r} * (({t[0]:.17e}) * {lat} + ({t[1]:.17e}) * sin(2 * {lat}) + ({t[2]:.17e}) * sin(4 * {lat}) + ({t[3]:.17e}) * sin(6 * {lat})))"


def _arc_at(lat: float) -> float:
    t = _arc_terms()
    return A * (t[0] * lat + sum(t[k] * math.sin(2 * k * lat) for k in (1, 2, 3)))


def project_sql(lon: str, lat: str) -> tuple[str, str]:
    """(x, y) in feet of a geographic point: transverse Mercator to the sixth order."""
    p = f"radians({lat})"
    n = f"({A!r} / sqrt(1 - {E2:.17e} * sin({p}) * sin({p})))"
    t, c = f"pow(tan({p}), 2)", f"({EP2:.17e} * pow(cos({p}), 2))"
    a = f"((radians({lon}) - ({LON0:.17e})) * cos({p}))"
    x = f"{K0} * {n} * ({a} + (1 - {t} + {c}) * pow({a}, 3) / 6 + (5 - 18 * {t} + {t} * {t} + 72 * {c} - 58 * {EP2:.17e}) * pow({a}, 5) / 120)"
    y = (
        f"{K0} * ({_arc(p)} - ({_arc_at(LAT0):.17e}) + {n} * tan({p}) * (pow({a}, 2) / 2 + (5 - {t} + 9 * {c} + 4 * {c} * {c}) * pow({a}, 4) / 24"
        f" + (61 - 58 * {t} + {t} * {t} + 600 * {c} - 330 * {EP2:.17e}) * pow({a}, 6) / 720))"
    )
    return f"(({x} + {FALSE_EASTING_M}) * {FT_PER_M:.17e})", f"(({y}) * {FT_PER_M:.17e})"


def unproject_sql(x: str, y: str) -> tuple[str, str]:
    """(lon, lat) in degrees of a state-plane point in feet."""
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    mu = f"((({_arc_at(LAT0):.17e}) + {y} / {FT_PER_M:.17e} / {K0}) / {A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256):.17e})"
    f = (
        f"({mu} + {3 * e1 / 2 - 27 * e1**3 / 32:.17e} * sin(2 * {mu}) + {21 * e1**2 / 16 - 55 * e1**4 / 32:.17e} * sin(4 * {mu})"
        f" + {151 * e1**3 / 96:.17e} * sin(6 * {mu}) + {1097 * e1**4 / 512:.17e} * sin(8 * {mu}))"
    )
    c, t = f"({EP2:.17e} * pow(cos({f}), 2))", f"pow(tan({f}), 2)"
    w = f"(1 - {E2:.17e} * pow(sin({f}), 2))"
    n, r = f"({A!r} / sqrt({w}))", f"({A * (1 - E2):.17e} / pow({w}, 1.5e0))"
    d = f"(({x} / {FT_PER_M:.17e} - {FALSE_EASTING_M}) / ({n} * {K0}))"
    lat = (
        f"degrees({f} - {n} * tan({f}) / {r} * (pow({d}, 2) / 2 - (5 + 3 * {t} + 10 * {c} - 4 * {c} * {c} - 9 * {EP2:.17e}) * pow({d}, 4) / 24"
        f" + (61 + 90 * {t} + 298 * {c} + 45 * {t} * {t} - 252 * {EP2:.17e} - 3 * {c} * {c}) * pow({d}, 6) / 720))"
    )
    lon = f"degrees(({LON0:.17e}) + ({d} - (1 + 2 * {t} + {c}) * pow({d}, 3) / 6 + (5 - 2 * {c} + 28 * {t} - 3 * {c} * {c} + 8 * {EP2:.17e} + 24 * {t} * {t}) * pow({d}, 5) / 120) / cos({f}))"
    return lon, lat


def project(lon: str, lat: str) -> tuple[Column, Column]:
    x, y = project_sql(lon, lat)
    return F.expr(x), F.expr(y)


def unproject(x: str, y: str) -> tuple[Column, Column]:
    lon, lat = unproject_sql(x, y)
    return F.expr(lon), F.expr(lat)


def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    h = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(2 * {EARTH_M} * asin(least(sqrt({h}), 1e0)))"


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Planar distance."""
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def edge_weight(d: Column) -> Column:
    return F.round(1 / (1 + d), 6)


def block_id(x: Column, y: Column, size: float) -> Column:
    """Packed id of a square block."""
    return F.floor(x / size) * 1_000_003 + F.floor(y / size)


def inside(px: Column, py: Column, segments: Column) -> Column:
    """Strictly inside by even-odd over segments, array<struct<x1, y1, x2, y2>>, edges excluded.  Segments that do not reach the point's y may be left out."""

    def step(acc: Column, s: Column) -> Column:
        x1, y1, x2, y2 = s["x1"], s["y1"], s["x2"], s["y2"]
        crosses = ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)
        on = ((x2 - x1) * (py - y1) == (y2 - y1) * (px - x1)) & px.between(F.least(x1, x2), F.greatest(x1, x2)) & py.between(F.least(y1, y2), F.greatest(y1, y2))
        return F.struct((acc["n"] + F.coalesce(crosses, F.lit(False)).cast("int")).alias("n"), (acc["on"] | on).alias("on"))

    total = F.aggregate(segments, F.struct(F.lit(0).alias("n"), F.lit(False).alias("on")), step)
    return (total["n"] % 2 == 1) & ~total["on"]


def erf_sql(x: str) -> str:
    """erf by a rational approximation (absolute error below 1.5e-7)."""
    t = f"(1 / (1 + 0.3275911e0 * abs({x})))"
    poly = f"({t} * (0.254829592e0 + {t} * (-0.284496736e0 + {t} * (1.421413741e0 + {t} * (-1.453152027e0 + {t} * 1.061405429e0)))))"
    return f"(sign({x}) * (1 - {poly} * exp(-({x}) * ({x}))))"
