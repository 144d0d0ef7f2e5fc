import random

import pytest
from pyspark.sql import functions as F

from stratalake.functions import soil
from stratalake.functions.soil import SoilParams
from stratalake.operators import profile

STRATA = "boring_id string, interval_index int, top_depth double, bottom_depth double, uscs_class string, spt_n int, gw_depth double, confidence double"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_textbook_values(spark):
    v = lambda c: value(spark, c)
    assert v(soil.phi_peck(F.lit(20.0))) == pytest.approx(32.884)
    assert v(soil.phi_hatanaka(F.lit(25.0))) == pytest.approx(39.8) and v(soil.phi_hatanaka(F.lit(400.0))) == 40
    assert v(soil.relative_density(F.lit(60.0))) == pytest.approx(100) and v(soil.relative_density(F.lit(15.0))) == pytest.approx(50)
    assert v(soil.undrained_strength(F.lit(10.0), F.lit(40.0))) == pytest.approx(4.2 * 10 / 95.76)
    assert v(soil.allowable_bearing(F.lit(10.0), SoilParams(footing_ft=3.0))) == pytest.approx(120 / 95.76)
    assert v(soil.n60(F.lit(20), F.lit(40.0))) == pytest.approx(24)
    assert v(soil.cn(F.lit(1.0581))) == pytest.approx(1) and v(soil.cn(F.lit(0.1))) == pytest.approx(1.7)
    assert v(soil.crr(F.lit(10.0))) < v(soil.crr(F.lit(20.0))) < v(soil.crr(F.lit(37.5))) == v(soil.crr(F.lit(60.0)))


def test_lookup_merges_overrides(spark):
    p = SoilParams(unit_weight={"SP": 99.0})
    got = [value(spark, soil.unit_weight(F.lit(c), p)) for c in (" sp ", "SP-SM", "CL", "??")]
    assert got == [99.0, 99.0, 115.0, 120.0]
    assert value(spark, soil.unit_weight(F.lit(None).cast("string"))) == 120.0


def test_stress_of_one_layer(spark):
    rows = [("b", 0, 0.0, 30.0, "SW", 10, 10.0, 0.9), ("b", 1, 20.0, 20.0, "SW", 10, None, 0.9), ("c", 0, None, 5.0, "CL", 3, None, 0.1), ("d", 0, -1.0, 5.0, "CL", 3, None, 0.1)]
    got = {(r.boring_id, r.interval_index): r for r in profile.stresses(spark.createDataFrame(rows, STRATA)).collect()}
    r = got["b", 1]
    assert (r.sigma_v0_tsf, r.pore_tsf, r.sigma_eff_v0_tsf) == pytest.approx((1.2, 0.312, 0.888))
    assert got["c", 0].sigma_v0_tsf is None and got["d", 0].sigma_eff_v0_tsf is None
    derived = {(r.boring_id, r.interval_index): r for r in profile.derive(spark.createDataFrame(rows, STRATA)).collect()}
    assert len(derived) == len(rows) and derived["b", 1].crr is None and derived["c", 0].n60 is None
    wet = profile.derive(spark.createDataFrame(rows, STRATA), SoilParams(liquefaction=True)).where("boring_id = 'b' AND interval_index = 1").first()
    assert wet.crr > 0


def test_empty_profile(spark):
    assert profile.derive(spark.createDataFrame([], STRATA)).collect() == []


def plain_stress(rows, depth):
    """Overburden at a depth, foot by foot, of rows (interval, top, bottom, weight)."""
    layers = sorted((t, i, b, g) for i, t, b, g in rows if t is not None)
    tops = [t for t, *_ in layers]
    closed = [(t, b if b is not None and b > t else tops[k + 1] if k + 1 < len(tops) and tops[k + 1] > t else t + 2, g) for k, (t, _, b, g) in enumerate(layers)]
    depth = min(depth, max(1.0, max(b for _, b, _ in closed)))
    total, k = 0.0, 0
    while k < depth:
        g = next((g for t, b, g in closed if t <= k + 0.5 < b), 120.0)
        total += g * min(1.0, depth - k)
        k += 1
    return total / 2000


def test_stresses_equal_a_sum_over_feet(spark):
    rng = random.Random(9)
    classes = ["SP", "CL", "PT", None, "GW"]
    rows = []
    for b in range(40):
        for i in range(rng.randrange(1, 9)):
            top = None if rng.random() < 0.1 else rng.choice([-3.0, 0.0, 0.5, rng.randrange(60) / 2, rng.random() * 30])
            rows.append((f"b{b}", i, top, None if top is None or rng.random() < 0.3 else top + rng.randrange(-4, 24) / 2, rng.choice(classes), 10, None, 0.9))
    rows.append((None, 0, 3.0, 9.0, "SP", 10, None, 0.9))
    table = spark.createDataFrame(rows, STRATA)
    got = {(r.boring_id, r.interval_index): r for r in profile.stresses(table).collect()}
    assert len(got) == len(rows) == profile.derive(table).count() and got[None, 0].sigma_v0_tsf is None
    for b, i, top, bottom, *_ in rows[:-1]:
        own = [(r[1], r[2], r[3], soil.UNIT_WEIGHT.get(r[4], 120.0)) for r in rows if r[0] == b]
        if top is None or top < 0:
            assert got[b, i].sigma_v0_tsf is None
        else:
            assert got[b, i].sigma_v0_tsf == pytest.approx(plain_stress(own, (top + bottom) / 2 if bottom is not None and bottom > top else top))


def test_a_profile_shuffles_once(spark):
    plan = profile.derive(spark.createDataFrame([("b", 0, 0.0, 30.0, "SW", 10, 10.0, 0.9)], STRATA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
