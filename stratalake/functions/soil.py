"""Engineering properties of soil intervals as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Moist unit weights (pcf) by class.
UNIT_WEIGHT = {
    "GW": 130.0, "GP": 125.0, "GM": 125.0, "GC": 122.0, "SW": 120.0, "SP": 118.0, "SM": 120.0, "SC": 120.0,
    "ML": 110.0, "CL": 115.0, "OL": 100.0, "MH": 105.0, "CH": 110.0, "OH": 95.0, "PT": 70.0, "FILL": 115.0,
}
#: Plasticity index and fines content (%) by class.
PLASTICITY = {
    "CL": (15.0, 85.0), "CH": (40.0, 92.0), "ML": (4.0, 75.0), "MH": (20.0, 80.0), "OL": (8.0, 75.0),
    "OH": (25.0, 82.0), "SC": (12.0, 30.0), "SM": (3.0, 18.0), "GC": (10.0, 22.0), "GM": (2.0, 14.0),
    "SP": (0.0, 4.0), "SW": (0.0, 3.0), "GP": (0.0, 3.0), "GW": (0.0, 2.0), "PT": (0.0, 0.0),
}
KPA_PER_TSF, TSF_PER_MPA, PA_TSF, PSF_PER_TSF = 95.76, 10.4427, 1.0581, 2000.0


@dataclass(frozen=True)
class SoilParams:
    """Engine settings; overrides are merged into the built-in tables row by row."""

    step_ft: float = 1.0
    water_pcf: float = 62.4
    default_unit_weight_pcf: float = 120.0
    hammer_efficiency_pct: float = 60.0
    energy_ratio_pct: float = 60.0
    borehole_in: float = 4.0
    rod_length: bool = True
    liner: bool = False
    cn_cap: float = 1.7
    footing_ft: float = 5.0
    liquefaction: bool = False
    unit_weight: dict[str, float] = field(default_factory=dict)
    plasticity: dict[str, tuple[float, float]] = field(default_factory=dict)


def _lookup(uscs: Column, table: dict[str, float], default: float) -> Column:
    """By the trimmed upper-case class, then by what stands before its first '-', else the default."""
    values = F.create_map(*[F.lit(v) for pair in sorted(table.items()) for v in pair])
    code = F.upper(F.trim(uscs))
    return F.coalesce(F.element_at(values, code), F.element_at(values, F.trim(F.split(code, "-")[0])), F.lit(default))


def unit_weight(uscs: Column, p: SoilParams = SoilParams()) -> Column:
    return _lookup(uscs, UNIT_WEIGHT | p.unit_weight, p.default_unit_weight_pcf)


def plasticity(uscs: Column, p: SoilParams = SoilParams()) -> tuple[Column, Column]:
    """(plasticity index, fines percent)."""
    table = PLASTICITY | p.plasticity
    return _lookup(uscs, {k: v[0] for k, v in table.items()}, 0.0), _lookup(uscs, {k: v[1] for k, v in table.items()}, 0.0)


def _first(uscs: Column) -> Column:
    return F.upper(F.substring(F.trim(uscs), 1, 1))


def is_granular(uscs: Column) -> Column:
    return F.coalesce(_first(uscs).isin("G", "S"), F.lit(False))


def is_cohesive(uscs: Column) -> Column:
    return F.coalesce(_first(uscs).isin("C", "M", "O"), F.lit(False))


def reference_depth(top: Column, bottom: Column) -> Column:
    """Middle of the interval, or its top where the bottom is not below; null without a top of 0 or more."""
    return F.when(top >= 0, F.when(bottom > top, (top + bottom) * 0.5).otherwise(top))


def n60(n: Column, depth: Column, p: SoilParams = SoilParams()) -> Column:
    mm = p.borehole_in * 25.4
    cb = 1.0 if mm <= 120 else 1.05 if mm <= 150 else 1.15
    z = depth * 0.3048
    cr = F.when(z < 3, 0.75).when(z < 4, 0.80).when(z < 6, 0.85).when(z < 10, 0.95).otherwise(1.0) if p.rod_length else F.lit(1.0)
    return F.when(n.between(0, 100), n * (p.hammer_efficiency_pct / p.energy_ratio_pct) * cb * (1.0 if p.liner else 1.2) * cr)


def cn(sigma_eff: Column, p: SoilParams = SoilParams()) -> Column:
    return F.least(F.sqrt(PA_TSF / sigma_eff), F.lit(p.cn_cap))


def phi_peck(n1: Column) -> Column:
    return F.greatest(F.least(27.1 + 0.3 * n1 - 0.00054 * n1 * n1, F.lit(45.0)), F.lit(20.0))


def phi_hatanaka(n: Column) -> Column:
    return F.least(3.5 * F.sqrt(F.greatest(n, F.lit(0.0))) + 22.3, F.lit(40.0))


def relative_density(n1: Column) -> Column:
    return F.least(100 * F.sqrt(F.greatest(n1 / 60, F.lit(0.0))), F.lit(100.0))


def undrained_strength(n: Column, pi: Column) -> Column:
    return F.greatest(F.least(6.0 - 0.06 * pi, F.lit(6.5)), F.lit(4.2)) * n / KPA_PER_TSF


def young_modulus(n1: Column, uscs: Column) -> Column:
    code, first = F.upper(F.trim(uscs)), F.coalesce(_first(uscs), F.lit(""))
    sand = F.when(F.substring(code, 1, 2).isin("SW", "SP"), 1.0).otherwise(0.7)
    factor = F.when(first == "G", 1.1).when(first == "S", sand).when(first == "M", 0.4).when(first == "C", 0.5).when(first == "O", 0.3).otherwise(0.5)
    return factor * n1 * TSF_PER_MPA


def constrained_modulus(es: Column) -> Column:
    return es * 1.346


def allowable_bearing(n: Column, p: SoilParams = SoilParams()) -> Column:
    b = max(p.footing_ft * 0.3048, 0.1)
    return (12.0 * n if b <= 1.2 else 8.0 * n * ((b + 0.3) / b) ** 2) / KPA_PER_TSF


def n1_60cs(n1: Column, fines: Column) -> Column:
    f = F.greatest(fines, F.lit(0.0)) + 0.01
    return n1 + F.exp(1.63 + 9.7 / f - F.pow(15.7 / f, F.lit(2.0)))


def crr(n1cs: Column) -> Column:
    x = F.greatest(F.least(n1cs, F.lit(37.5)), F.lit(0.0))
    return F.exp(x / 14.1 + F.pow(x / 126.0, F.lit(2.0)) - F.pow(x / 23.6, F.lit(3.0)) + F.pow(x / 25.4, F.lit(4.0)) - 2.8)
