"""Stress and property profiles per boring.

The overburden integral takes, of each one-foot cell, the weight of the first layer that holds its middle.  Layers in
order of their tops hold what lies below all earlier bottoms, so a running maximum says where each begins to count, and a
running sum what lies above.  All of it runs down the rows of a boring: one shuffle by boring, two sorts, and work that grows with its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake.functions import soil
from stratalake.functions.soil import SoilParams

KEY = ["boring_id", "interval_index"]


def _closed(p: SoilParams) -> Column:
    """Bottom of a layer: its own, else the next top (``_next``), else at a nominal thickness."""
    top, own, following = F.col("top_depth"), F.col("bottom_depth"), F.col("_next")
    return F.when(own > top, own).when(following > top, following).otherwise(top + max(2 * p.step_ft, 2.0))


def layer_column(strata: DataFrame, p: SoilParams = SoilParams()) -> DataFrame:
    """Rows with a top, closed at their bottom, else at the next top, else at a nominal thickness; with unit weight."""
    following = F.lead("top_depth").over(Window.partitionBy("boring_id").orderBy("top_depth", "interval_index"))
    rows = strata.where("top_depth IS NOT NULL").withColumn("_next", following)
    return rows.select("boring_id", "interval_index", F.col("top_depth").alias("layer_top"), _closed(p).alias("layer_bottom"), soil.unit_weight(F.col("uscs_class"), p).alias("gamma_pcf"))


def groundwater(strata: DataFrame, low: float = 0.0, high: float | None = None) -> DataFrame:
    """Shallowest observed groundwater per boring; readings outside [low, high] do not count."""
    ok = (F.col("gw_depth") >= low) if high is None else F.col("gw_depth").between(low, high)
    return strata.where(ok).groupBy("boring_id").agg(F.min("gw_depth").alias("gw_ft"))


def _with_stress(strata: DataFrame, p: SoilParams) -> DataFrame:
    """``strata`` with depth_ft, sigma_v0_tsf, pore_tsf, sigma_eff_v0_tsf, gamma_pcf and gw_ft; an interval of no boring has no stress."""
    step, base = p.step_ft, p.default_unit_weight_pcf
    boring = Window.partitionBy("boring_id")
    down = boring.orderBy("top_depth", "interval_index", "_weight")
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    top, known = F.col("top_depth"), F.col("boring_id").isNotNull()
    depth = soil.reference_depth(top, F.col("bottom_depth"))
    rows = strata.withColumns({"_weight": soil.unit_weight(F.col("uscs_class"), p), "depth_ft": depth}).withColumn("_next", F.lead("top_depth").over(down))
    rows = rows.withColumn("_bottom", _closed(p))
    rows = rows.withColumns({"_a": F.when(top.isNotNull(), F.greatest(F.ceil(top / step - 0.5), F.lit(0))), "_b": F.ceil(F.col("_bottom") / step - 0.5)})
    # cells [_s, _e) that the layer is the first to hold
    rows = rows.withColumn("_s", F.when(top.isNotNull(), F.greatest("_a", F.max("_b").over(above)))).withColumn("_e", F.greatest("_s", "_b"))
    over = F.col("_weight") - base
    rows = rows.withColumns({"_before": F.coalesce(F.sum(over * (F.col("_e") - F.col("_s"))).over(above), F.lit(0.0)), "_deep": F.greatest(F.max("_bottom").over(boring), F.lit(step)), "gw_ft": F.min(F.when(F.col("gw_depth") >= 0, F.col("gw_depth"))).over(boring)})
    # layers and asked depths in one order: the last layer that begins above a depth is the one that counts there
    layer = F.struct(F.col("_s").alias("s"), F.col("_e").alias("e"), over.alias("over"), F.col("_before").alias("before"))
    kept = [*strata.columns, "depth_ft", "gw_ft", "_weight"]
    event = lambda at, asks, held, row: F.struct(at.cast("double").alias("at"), F.lit(asks).alias("asks"), held.alias("layer"), row.alias("row"))
    row = F.struct(*kept)
    both = F.array(F.when(F.col("_e") > F.col("_s"), event(F.col("_s"), 0, layer, F.when(F.lit(False), row))), event(F.when(F.col("depth_ft").isNotNull(), F.least("depth_ft", "_deep") / step), 1, F.when(F.lit(False), layer), row))
    events = rows.select("boring_id", F.explode(both).alias("v")).where("v IS NOT NULL").select("boring_id", "v.*")
    events = events.withColumn("layer", F.last("layer", ignorenulls=True).over(boring.orderBy(F.asc_nulls_first("at"), "asks").rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.least("at", F.col("layer.e")) - F.col("layer.s")
    total = base * F.col("at") + F.coalesce(F.col("layer.before") + F.col("layer.over") * inside, F.lit(0.0))
    out = events.where("asks = 1").select("row.*", F.when(known, total * step / soil.PSF_PER_TSF).alias("sigma_v0_tsf")).withColumn("gw_ft", F.when(known, F.col("gw_ft")))
    # pore pressure takes the depth as it is
    pore = F.when(F.col("depth_ft").isNotNull(), p.water_pcf * F.coalesce(F.greatest(F.col("depth_ft") - F.col("gw_ft"), F.lit(0.0)), F.lit(0.0)) / soil.PSF_PER_TSF)
    effective = F.when(F.col("sigma_v0_tsf").isNotNull(), F.greatest(F.col("sigma_v0_tsf") - F.col("pore_tsf"), F.lit(0.01)))
    return out.withColumn("pore_tsf", pore).withColumns({"sigma_eff_v0_tsf": effective, "gamma_pcf": F.when(F.col("depth_ft").isNotNull(), F.col("_weight"))}).drop("_weight")


def stresses(strata: DataFrame, p: SoilParams = SoilParams()) -> DataFrame:
    """Per interval: depth_ft, sigma_v0_tsf, pore_tsf, sigma_eff_v0_tsf, gamma_pcf, gw_ft; nulls where it has no depth."""
    rows = _with_stress(strata.select(*KEY, "top_depth", "bottom_depth", "uscs_class", "gw_depth"), p)
    return rows.select(*KEY, "depth_ft", "sigma_v0_tsf", "pore_tsf", "sigma_eff_v0_tsf", "gamma_pcf", "gw_ft")


def derive(strata: DataFrame, p: SoilParams = SoilParams(), also: tuple[str, ...] = ()) -> DataFrame:
    """``strata_derived``: one row per interval with all properties, source and confidence, and columns of ``strata`` that are asked for ``also``."""
    read = dict.fromkeys([*KEY, "top_depth", "bottom_depth", "uscs_class", "gw_depth", "spt_n", "confidence", *also])
    rows = _with_stress(strata.select(*read), p)
    uscs, n, n1 = F.col("uscs_class"), F.col("n60"), F.col("n1_60")
    pi, fines = soil.plasticity(uscs, p)
    granular, cohesive = soil.is_granular(uscs), soil.is_cohesive(uscs)
    rows = rows.withColumn("n60", F.when(F.col("depth_ft").isNotNull(), soil.n60(F.col("spt_n"), F.col("depth_ft"), p)))
    rows = rows.withColumn("cn", F.when(n.isNotNull(), soil.cn(F.col("sigma_eff_v0_tsf"), p))).withColumn("n1_60", n * F.col("cn"))
    wet = granular & (F.col("depth_ft") >= F.col("gw_ft")) if p.liquefaction else F.lit(False)
    rows = rows.withColumns({
        "phi_peck_deg": F.when(granular, soil.phi_peck(n1)), "phi_hatanaka_deg": F.when(granular & n.isNotNull(), soil.phi_hatanaka(n)), "dr_pct": F.when(granular & n1.isNotNull(), soil.relative_density(n1)),
        "su_tsf": F.when(cohesive & (n > 0), soil.undrained_strength(n, pi)), "e_modulus_tsf": F.when(n > 0, soil.young_modulus(n1, uscs)),
        "allow_bearing_tsf": soil.allowable_bearing(n, p), "n1_60cs": F.when(wet & n1.isNotNull(), soil.n1_60cs(n1, fines)),
    }).withColumns({"m_constrained_tsf": soil.constrained_modulus(F.col("e_modulus_tsf")), "crr": F.when(F.col("n1_60cs").isNotNull(), soil.crr(F.col("n1_60cs")))})
    rows = rows.withColumn("phi_peck_deg", F.when(n1.isNotNull(), F.col("phi_peck_deg")))
    return rows.select(
        *KEY, "depth_ft", "sigma_v0_tsf", "sigma_eff_v0_tsf", "gamma_pcf", "n60", "cn", "n1_60", "phi_peck_deg", "phi_hatanaka_deg", "dr_pct", "su_tsf", "e_modulus_tsf", "m_constrained_tsf",
        "allow_bearing_tsf", "n1_60cs", "crr", F.lit("soil_profile").alias("source"), "confidence", *also,
    )


def sanity(derived: DataFrame) -> DataFrame:
    """One row of violation counts of the physical bounds."""
    w = Window.partitionBy("boring_id").orderBy("depth_ft", "interval_index")
    seen = derived.withColumn("_before", F.lag("sigma_v0_tsf").over(w))
    return seen.agg(
        F.count_if(F.col("sigma_eff_v0_tsf") > F.col("sigma_v0_tsf") + 0.01).alias("eff_above_total"),
        F.count_if(F.col("sigma_v0_tsf") < F.col("_before") - 1e-9).alias("not_monotone"),
        F.count_if(~F.col("dr_pct").between(0, 100)).alias("dr_out"),
        F.count_if(~F.col("phi_peck_deg").between(20, 45)).alias("phi_out"),
        F.count_if(F.col("su_tsf") <= 0).alias("su_not_positive"),
    )


def monotone_violations(rows: DataFrame, column: str = "sigma_eff_v0_tsf", tolerance: float = 1e-6) -> DataFrame:
    """(boring_id, n): per boring how often ``column`` falls with depth."""
    before = F.lag(column).over(Window.partitionBy("boring_id").orderBy("depth_ft", "interval_index"))
    return rows.where("depth_ft IS NOT NULL").withColumn("_p", before).where(F.col(column) < F.col("_p") - tolerance).groupBy("boring_id").agg(F.count(F.lit(1)).alias("n"))
