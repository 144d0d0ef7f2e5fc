"""Registered queries: interval properties, stress profiles, log text and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.functions import logs, soil
from stratalake.functions.soil import SoilParams
from stratalake.operators import logs as log_ops
from stratalake.operators import normalize, profile, report
from stratalake.plans.fixtures import Tables
from stratalake.plans.registry import query


def _case(table: dict[str, float], default: float) -> str:
    whole = " ".join(f"WHEN '{k}' THEN {v!r}e0" for k, v in sorted(table.items()))
    return f"coalesce(CASE upper(trim(uscs_class)) {whole} END, CASE trim(split_part(upper(trim(uscs_class)), '-', 1)) {whole} END, {default!r}e0)"


_GAMMA = _case(soil.UNIT_WEIGHT, 120.0)
_PI = _case({k: v[0] for k, v in soil.PLASTICITY.items()}, 0.0)
_FINES = _case({k: v[1] for k, v in soil.PLASTICITY.items()}, 0.0)
_FIRST = "coalesce(upper(substr(trim(uscs_class), 1, 1)), '')"

#: Layers, cells and stresses of all intervals, as DuckDB common tables after the view ``strata``.
_STRESS = f"""
    lay AS (SELECT boring_id, interval_index, top_depth AS a, CASE WHEN bottom_depth > top_depth THEN bottom_depth WHEN nt > top_depth THEN nt ELSE top_depth + 2 END AS b, {_GAMMA} AS g
        FROM (SELECT *, lead(top_depth) OVER (PARTITION BY boring_id ORDER BY top_depth, interval_index) AS nt FROM strata WHERE top_depth IS NOT NULL)),
    deep AS (SELECT boring_id, greatest(max(b), 1e0) AS m FROM lay GROUP BY boring_id),
    cells AS (SELECT boring_id, m, unnest(range(CAST(ceil(m) AS BIGINT) + 2)) AS k FROM deep),
    held AS (SELECT c.boring_id, k, arg_min(g, (a, interval_index)) AS g FROM cells AS c JOIN lay USING (boring_id) WHERE k + 0.5e0 >= a AND k + 0.5e0 < b GROUP BY c.boring_id, k),
    cum AS (SELECT c.boring_id, m, k, coalesce(sum(coalesce(g, 120e0)) OVER (PARTITION BY c.boring_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM cells AS c LEFT JOIN held USING (boring_id, k)),
    gw AS (SELECT boring_id, min(gw_depth) AS w FROM strata WHERE gw_depth >= 0 GROUP BY boring_id),
    ref AS (SELECT *, CASE WHEN top_depth >= 0 THEN CASE WHEN bottom_depth > top_depth THEN (top_depth + bottom_depth) * 0.5e0 ELSE top_depth END END AS d FROM strata),
    st AS (SELECT r.*, w, greatest(least(d, e.m), 0e0) AS f, CAST(floor(greatest(least(d, e.m), 0e0)) AS BIGINT) AS fk FROM ref AS r LEFT JOIN deep AS e USING (boring_id) LEFT JOIN gw USING (boring_id)),
    sg AS (SELECT st.*, CASE WHEN d IS NOT NULL THEN (lo.s + (f - fk) * (coalesce(hi.s, lo.s) - lo.s)) / 2000 END AS sv,
        CASE WHEN d IS NOT NULL THEN 62.4e0 * coalesce(greatest(d - w, 0e0), 0e0) / 2000 END AS u
        FROM st LEFT JOIN cum AS lo ON lo.boring_id = st.boring_id AND lo.k = fk LEFT JOIN cum AS hi ON hi.boring_id = st.boring_id AND hi.k = fk + 1),
    sx AS (SELECT *, CASE WHEN sv IS NOT NULL THEN greatest(sv - u, 0.01e0) END AS se FROM sg)"""
_DERIVED = f"""{_STRESS},
    q0 AS (SELECT *, {_GAMMA} AS gam, {_FIRST} AS fi, {_PI} AS pi_, {_FINES} AS fin, CASE WHEN d IS NOT NULL AND spt_n BETWEEN 0 AND 100 THEN spt_n * 1.2e0 * CASE WHEN d * 0.3048e0 < 3 THEN 0.75e0 WHEN d * 0.3048e0 < 4 THEN 0.8e0 WHEN d * 0.3048e0 < 6 THEN 0.85e0 WHEN d * 0.3048e0 < 10 THEN 0.95e0 ELSE 1e0 END END AS n60 FROM sx),
    q1 AS (SELECT *, CASE WHEN n60 IS NOT NULL THEN least(sqrt(1.0581e0 / se), 1.7e0) END AS cn FROM q0),
    q2 AS (SELECT *, n60 * cn AS n1 FROM q1),
    q3 AS (SELECT *, fi IN ('G', 'S') AND n1 IS NOT NULL AS gr, CASE WHEN n60 > 0 THEN CASE WHEN fi = 'G' THEN 1.1e0 WHEN fi = 'S' THEN CASE WHEN upper(substr(trim(uscs_class), 1, 2)) IN ('SW', 'SP') THEN 1e0 ELSE 0.7e0 END
        WHEN fi = 'M' THEN 0.4e0 WHEN fi = 'C' THEN 0.5e0 WHEN fi = 'O' THEN 0.3e0 ELSE 0.5e0 END * n1 * 10.4427e0 END AS es FROM q2),
    derived AS (SELECT boring_id, interval_index, d AS depth_ft, sv AS sigma_v0_tsf, se AS sigma_eff_v0_tsf, CASE WHEN d IS NOT NULL THEN gam END AS gamma_pcf, n60, cn, n1 AS n1_60,
        CASE WHEN gr THEN greatest(least(27.1e0 + 0.3e0 * n1 - 0.00054e0 * n1 * n1, 45e0), 20e0) END AS phi_peck_deg, CASE WHEN gr THEN least(3.5e0 * sqrt(greatest(n60, 0e0)) + 22.3e0, 40e0) END AS phi_hatanaka_deg,
        CASE WHEN gr THEN least(100 * sqrt(greatest(n1 / 60, 0e0)), 100e0) END AS dr_pct, CASE WHEN fi IN ('C', 'M', 'O') AND n60 > 0 THEN greatest(least(6 - 0.06e0 * pi_, 6.5e0), 4.2e0) * n60 / 95.76e0 END AS su_tsf,
        es AS e_modulus_tsf, es * 1.346e0 AS m_constrained_tsf, 8e0 * n60 * {((1.524 + 0.3) / 1.524) ** 2!r}e0 / 95.76e0 AS allow_bearing_tsf,
        CASE WHEN gr AND d >= w THEN n1 + exp(1.63e0 + 9.7e0 / (fin + 0.01e0) - pow(15.7e0 / (fin + 0.01e0), 2)) END AS cs, confidence, uscs_class, spt_n, w AS gw_ft, u AS pore_tsf FROM q3)"""


def _round(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in columns)


@query("sample_sanity_gate", "SELECT boring_id, interval_index, top_depth, CASE WHEN spt_n BETWEEN 0 AND 100 THEN spt_n END AS spt_n FROM strata WHERE top_depth BETWEEN 0 AND 200")
def sample_sanity_gate(t: Tables) -> DataFrame:
    return normalize.sanity_gate(t.strata.select("boring_id", "interval_index", "top_depth", "spt_n"))


@query("gate_counts", "SELECT count_if(coalesce(top_depth BETWEEN 0 AND 200, false))::BIGINT AS kept, count_if(NOT coalesce(top_depth BETWEEN 0 AND 200, false))::BIGINT AS dropped FROM strata")
def gate_counts(t: Tables) -> DataFrame:
    return normalize.gate_counts(t.strata)


@query("sample_admission", "SELECT boring_id, interval_index FROM strata WHERE top_depth IS NOT NULL AND (spt_n IS NOT NULL OR uscs_class IS NOT NULL)")
def sample_admission(t: Tables) -> DataFrame:
    from stratalake.operators.features import sample_admission as admit

    return admit(t.strata).select("boring_id", "interval_index")


@query("unit_weight", f"SELECT boring_id, interval_index, {_GAMMA} AS gamma_pcf FROM strata")
def unit_weight(t: Tables) -> DataFrame:
    return t.strata.select("boring_id", "interval_index", soil.unit_weight(F.col("uscs_class")).alias("gamma_pcf"))


@query("plasticity_lookup", f"SELECT boring_id, interval_index, {_PI} AS pi, {_FINES} AS fines_pct, {_FIRST} IN ('G', 'S') AS granular, {_FIRST} IN ('C', 'M', 'O') AS cohesive FROM strata")
def plasticity_lookup(t: Tables) -> DataFrame:
    u = F.col("uscs_class")
    pi, fines = soil.plasticity(u)
    return t.strata.select("boring_id", "interval_index", pi.alias("pi"), fines.alias("fines_pct"), soil.is_granular(u).alias("granular"), soil.is_cohesive(u).alias("cohesive"))


@query("layer_column", f"WITH {_STRESS} SELECT boring_id, interval_index, round(a, 6) + 0e0 AS layer_top, round(b, 6) + 0e0 AS layer_bottom, g AS gamma_pcf FROM lay")
def layer_column(t: Tables) -> DataFrame:
    return profile.layer_column(t.strata)


@query("total_stress", f"WITH {_DERIVED} SELECT boring_id, interval_index, {_round('sigma_v0_tsf')} FROM derived")
def total_stress(t: Tables) -> DataFrame:
    return profile.stresses(t.strata).select("boring_id", "interval_index", "sigma_v0_tsf")


@query("effective_stress", f"WITH {_DERIVED} SELECT boring_id, interval_index, {_round('depth_ft', 'pore_tsf', 'sigma_eff_v0_tsf')} FROM derived")
def effective_stress(t: Tables) -> DataFrame:
    return profile.stresses(t.strata).select("boring_id", "interval_index", "depth_ft", "pore_tsf", "sigma_eff_v0_tsf")


def _property(name: str, *columns: str) -> None:
    @query(name, f"WITH {_DERIVED} SELECT boring_id, interval_index, {_round(*columns)} FROM derived")
    def run(t: Tables) -> DataFrame:
        return profile.derive(t.strata).select("boring_id", "interval_index", *columns)


_property("n60", "n60")
_property("n1_60", "cn", "n1_60")
_property("friction_angle", "phi_peck_deg", "phi_hatanaka_deg")
_property("relative_density", "dr_pct")
_property("undrained_strength", "su_tsf")
_property("stiffness", "e_modulus_tsf", "m_constrained_tsf")
_property("allowable_bearing", "allow_bearing_tsf")
_ALL = ("depth_ft", "sigma_v0_tsf", "sigma_eff_v0_tsf", "gamma_pcf", "n60", "cn", "n1_60", "phi_peck_deg", "phi_hatanaka_deg", "dr_pct", "su_tsf", "e_modulus_tsf", "m_constrained_tsf", "allow_bearing_tsf")


@query("liquefaction_resistance", f"""WITH {_DERIVED}, x AS (SELECT *, greatest(least(cs, 37.5e0), 0e0) AS c FROM derived) SELECT boring_id, interval_index, round(cs, 6) + 0e0 AS n1_60cs,
    round(CASE WHEN cs IS NOT NULL THEN exp(c / 14.1e0 + pow(c / 126e0, 2) - pow(c / 23.6e0, 3) + pow(c / 25.4e0, 4) - 2.8e0) END, 6) + 0e0 AS crr FROM x""")
def liquefaction_resistance(t: Tables) -> DataFrame:
    return profile.derive(t.strata, SoilParams(liquefaction=True)).select("boring_id", "interval_index", "n1_60cs", "crr")


@query("strata_derived", f"WITH {_DERIVED} SELECT boring_id, interval_index, {_round(*_ALL)}, CAST(NULL AS DOUBLE) AS n1_60cs, CAST(NULL AS DOUBLE) AS crr, 'soil_profile' AS source, confidence FROM derived")
def strata_derived(t: Tables) -> DataFrame:
    return profile.derive(t.strata)


@query("derived_sanity", f"""WITH {_DERIVED}, s AS (SELECT *, lag(sigma_v0_tsf) OVER (PARTITION BY boring_id ORDER BY depth_ft NULLS FIRST, interval_index) AS p FROM derived)
    SELECT count_if(sigma_eff_v0_tsf > sigma_v0_tsf + 0.01e0)::BIGINT AS eff_above_total, count_if(sigma_v0_tsf < p - 1e-9)::BIGINT AS not_monotone, count_if(NOT dr_pct BETWEEN 0 AND 100)::BIGINT AS dr_out,
        count_if(NOT phi_peck_deg BETWEEN 20 AND 45)::BIGINT AS phi_out, count_if(su_tsf <= 0)::BIGINT AS su_not_positive FROM s""")
def derived_sanity(t: Tables) -> DataFrame:
    return profile.sanity(profile.derive(t.strata))


_UPSET = "CASE WHEN interval_index % 4 = 3 THEN e * 0.5e0 ELSE e END"


@query("stress_monotone_violations", f"""WITH {_DERIVED}, u AS (SELECT boring_id, interval_index, depth_ft, sigma_eff_v0_tsf AS e FROM derived WHERE depth_ft IS NOT NULL),
    s AS (SELECT boring_id, {_UPSET} AS e, lag({_UPSET}) OVER (PARTITION BY boring_id ORDER BY depth_ft, interval_index) AS p FROM u)
    SELECT boring_id, count(*) AS n FROM s WHERE e < p - 1e-6 GROUP BY boring_id""")
def stress_monotone_violations(t: Tables) -> DataFrame:
    """Stresses of which every fourth is halved, so that there is something to find."""
    rows = profile.stresses(t.strata).withColumn("sigma_eff_v0_tsf", F.expr(_UPSET.replace("e *", "sigma_eff_v0_tsf *").replace("ELSE e", "ELSE sigma_eff_v0_tsf")))
    return profile.monotone_violations(rows)


_COUNTED = ("n60", "n1_60", "phi_peck_deg", "su_tsf", "sigma_v0_tsf")


@query("derived_coverage", f"WITH {_DERIVED} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n FROM derived" for c in _COUNTED))
def derived_coverage(t: Tables) -> DataFrame:
    return report.non_null_counts(profile.derive(t.strata), list(_COUNTED))


@query("boring_groundwater", "SELECT boring_id, min(gw_depth) AS gw_ft FROM strata WHERE gw_depth BETWEEN 0 AND 200 GROUP BY boring_id")
def boring_groundwater(t: Tables) -> DataFrame:
    return profile.groundwater(t.strata, 0.0, 200.0)


@query("parsed_boring_count", "SELECT count(DISTINCT boring_id) AS n FROM strata WHERE ocr_status = 'parsed'")
def parsed_boring_count(t: Tables) -> DataFrame:
    return t.strata.where("ocr_status = 'parsed'").agg(F.countDistinct("boring_id").alias("n"))


#: One log line per interval, a water line before the third; both engines read this text.
_LINES = """
    SELECT boring_id, interval_index * 2 + 1 AS line_no, CAST(top_depth AS {str}) || ' - ' || CAST(bottom_depth AS {str}) || CASE interval_index % 3 WHEN 0 THEN '  SS  ' WHEN 1 THEN '  ST  ' ELSE '  ' END
        || coalesce(CASE WHEN interval_index % 2 = 0 THEN CAST(spt_n % 7 AS {str}) || '-' || CAST(CAST(floor(spt_n / 2e0) AS INT) AS {str}) || '-' || CAST(CAST(spt_n - floor(spt_n / 2e0) AS INT) AS {str}) ELSE 'N = ' || CAST(spt_n AS {str}) END, '') || '  ' || coalesce(uscs_class, 'moist') AS line
    FROM {strata} WHERE top_depth IS NOT NULL AND bottom_depth IS NOT NULL
    UNION ALL SELECT boring_id, interval_index * 2, 'Groundwater encountered at ' || CAST(gw_depth AS {str}) || ' ft' FROM {strata} WHERE gw_depth IS NOT NULL"""


def log_texts(t: Tables) -> DataFrame:
    lines = t.spark.sql(_LINES.replace("{str}", "string"), strata=t.strata)
    return lines.groupBy("boring_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


def _re(pattern: str, group: int = 1, line: str = "line") -> str:
    return f"nullif(regexp_extract({line}, '{pattern}', {group}), '')"


_LINES_SQL = _LINES.replace("{str}", "varchar").replace("{strata}", "strata")


@query("parse_log_text", f"""
    WITH l AS ({_LINES_SQL}),
    x AS (SELECT *, last_value(CAST({_re(logs.WATER)} AS DOUBLE) IGNORE NULLS) OVER (PARTITION BY boring_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gw,
        CAST({_re(logs.DEPTH)} AS DOUBLE) AS a, CAST({_re(logs.DEPTH, 2)} AS DOUBLE) AS b, {_re(logs.USCS)} AS u, coalesce(CAST({_re(logs.BLOWS, 2)} AS INT) + CAST({_re(logs.BLOWS, 3)} AS INT), CAST({_re(logs.N_VALUE)} AS INT)) AS n, {_re(logs.SAMPLE)} AS s FROM l),
    k AS (SELECT * FROM x WHERE b >= a AND b - a <= 100)
    SELECT boring_id, CAST(row_number() OVER (PARTITION BY boring_id ORDER BY line_no) - 1 AS INT) AS interval_index, a AS top_depth, b AS bottom_depth, u AS uscs_class, n AS spt_n, s AS sample_type, gw AS gw_depth,
        round(least(1e0, 0.3e0 + 0.2e0 * ((u IS NOT NULL)::INT + (n IS NOT NULL)::INT + (s IS NOT NULL)::INT)), 2) AS confidence FROM k""")
def parse_log_text(t: Tables) -> DataFrame:
    return log_ops.parse_log_text(log_texts(t))


_PHRASES = ("brown m.-f. SAND, some silt", "gray clayey gravel", "SILT, trace sand", "fat CLAY, moist", "miscellaneous fill", "organic matter", "topsoil and roots", "no recovery here", "coarse gravel", "lean clay", "clayey sand", "Peat, dark")
_FAMILIES = ("SM", "GC", "ML", "CH", "FILL", "PT", "OL", None, "GP", "CL", "SC", "PT")
_CONFIDENCE = (0.45, 0.45, 0.45, 0.45, 0.6, 0.5, 0.5, 0.0, 0.45, 0.45, 0.45, 0.5)


def _phrase(k: str) -> str:
    return f"CASE {k} " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PHRASES)) + " END"


def _family(k: str) -> str:
    return f"CASE {k} " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_FAMILIES) if p) + " END"


def _family_conf(k: str) -> str:
    return f"CASE {k} " + " ".join(f"WHEN {i} THEN {c!r}e0" for i, c in enumerate(_CONFIDENCE)) + " END"


@query("soil_family", f"SELECT p_partkey, {_family('p_partkey % 12')} AS family, {_family_conf('p_partkey % 12')} AS confidence FROM part")
def soil_family(t: Tables) -> DataFrame:
    return t.part.withColumn("f", logs.soil_family(F.expr(_phrase("p_partkey % 12")))).select("p_partkey", "f.family", "f.confidence")


@query("nums_in", "SELECT p_partkey, CAST(p_size AS DOUBLE) + 0.5e0 AS first, CAST(p_partkey % 1000 AS DOUBLE) AS second, 3 AS n FROM part")
def nums_in(t: Tables) -> DataFrame:
    text = F.concat(F.col("p_size").cast("string"), F.lit(",5|"), (F.col("p_partkey") % 1000).cast("string"), F.lit("-  x12 / 7. 12345"))
    values = logs.numbers_in(text)
    return t.part.select("p_partkey", F.get(values, F.lit(0)).alias("first"), F.get(values, F.lit(1)).alias("second"), F.size(values).alias("n"))


@query("spt_from_increments", """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(l_quantity AS INT) WHEN 2 THEN CAST(l_quantity + 3 AS INT) ELSE CAST(3 + l_quantity + 1 AS INT) END AS n FROM lineitem""")
def spt_from_increments(t: Tables) -> DataFrame:
    k, q = F.col("l_linenumber") % 4, F.col("l_quantity").cast("double")
    values = F.when(k == 0, F.array(F.lit(100.0))).when(k == 1, F.array(q)).when(k == 2, F.array(q, F.lit(3.0), F.lit(150.0))).otherwise(F.array(F.lit(9.0), F.lit(3.0), q + 1))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", logs.spt_from_increments(values).alias("n"))


def ocr_boxes(t: Tables) -> DataFrame:
    """One page per boring: even orders are spoon logs, odd ones descriptive pages."""
    s = t.strata.withColumn("o", F.substring("boring_id", 2, 9).cast("int")).withColumns({"spoon": F.col("o") % 2 == 0, "low": 200.0 + 100.0 * F.col("interval_index")})
    # numbers of an interval's boxes; every page has an interval 0, which brings the head (0 to 2)
    own, head = ("array(9, 10, 11, 12, 13, 14, 15)", "array(9, 15)"), "array(0, 1, 2)"
    kinds = F.expr(f"CASE WHEN interval_index = 0 THEN CASE WHEN spoon THEN concat({head}, {own[0]}) ELSE concat({head}, {own[1]}) END WHEN spoon THEN {own[0]} ELSE {own[1]} END")
    kind = lambda **says: "CASE " + " ".join(f"WHEN k = {k[1:]} THEN {v}" for k, v in says.items()) + " END"
    x = f"CASE WHEN k < 3 THEN 500D WHEN spoon THEN {kind(_9='200D', _10='260D', _11='330D', _12='400D', _13='450D', _14='500D', _15='700D')} ELSE {kind(_9='50D', _15='500D')} END"
    y = f"CASE WHEN k < 3 THEN 20D + 30 * k WHEN spoon THEN low + {kind(_9='0', _10='3', _11='1', _12='0', _13='2', _14='-2', _15='0')} ELSE {kind(_9='low + (o % 7) * (interval_index % 3)', _15='low + 10')} END"
    phrase = _phrase("(o + interval_index) % 12")
    heads = {"_0": "CASE WHEN spoon THEN 'Blows on Spoon' ELSE 'Boring log' END", "_1": "concat('SURFACE ELEVATION: ', CAST(o % 300 AS string), ' ft')", "_2": "CASE WHEN o % 3 = 0 THEN concat('water level ', CAST(o % 40 AS string)) ELSE 'dry hole' END"}
    number = lambda c: f"coalesce(CAST({c} AS string), '-')"
    logged = {"_9": "concat('S-', CAST(interval_index + 1 AS string))", "_10": number("top_depth"), "_11": number("bottom_depth"), "_12": "'5'", "_13": number("spt_n"), "_14": "'1'", "_15": phrase}
    text = f"CASE WHEN k < 3 THEN {kind(**heads)} WHEN spoon THEN {kind(**logged)} ELSE {kind(_9='CAST(10 + 5 * interval_index AS string)', _15=phrase)} END"
    rows = s.select("*", F.explode(kinds).alias("k"))
    return rows.select("boring_id", F.lit(1).alias("page"), F.expr("interval_index * 20 + k").alias("seq"), F.lit(1000.0).alias("page_w"), F.lit(2000.0).alias("page_h"), F.expr(x).alias("x"), F.expr(y).alias("y"), F.expr(text).alias("text"), F.lit(0.9).alias("conf"))


_BOX = "SELECT *, CAST(substr(boring_id, 2) AS INT) AS o FROM strata"


@query("header_fields", f"SELECT DISTINCT boring_id, CAST(o % 300 AS DOUBLE) AS surface_elevation, 'ft' AS elev_units, CASE WHEN o % 3 = 0 THEN CAST(o % 40 AS DOUBLE) END AS header_gw FROM ({_BOX}) AS b")
def header_fields(t: Tables) -> DataFrame:
    return log_ops.header_fields(log_ops.page_text(ocr_boxes(t))).select("boring_id", "surface_elevation", "elev_units", "header_gw")


@query("spoon_format_pages", f"SELECT DISTINCT boring_id FROM ({_BOX}) AS b WHERE o % 2 = 0")
def spoon_format_pages(t: Tables) -> DataFrame:
    return log_ops.page_text(ocr_boxes(t)).where(log_ops.is_spoon(F.col("emitted"))).select("boring_id")


_TICK_Y = "(200e0 + 100 * interval_index + (o % 7) * (interval_index % 3))"
_AXIS = f"SELECT boring_id, regr_slope(10e0 + 5 * interval_index, {_TICK_Y}) AS a, regr_intercept(10e0 + 5 * interval_index, {_TICK_Y}) AS b FROM ({_BOX}) AS b WHERE o % 2 = 1 GROUP BY boring_id HAVING count(*) >= 3"


@query("depth_axis_fit", f"SELECT boring_id, round(a, 6) + 0e0 AS a, round(b, 6) + 0e0 AS b FROM ({_AXIS}) AS x")
def depth_axis_fit(t: Tables) -> DataFrame:
    return log_ops.depth_axis(ocr_boxes(t)).select("boring_id", "a", "b")


def _generic(where: str) -> str:
    """Intervals of descriptive pages over the boxes that ``where`` keeps."""
    box = f"(SELECT * FROM ({_BOX}) AS b WHERE o % 2 = 1 AND {where})"
    axis = _AXIS.replace(f"({_BOX})", box)
    return f"""SELECT boring_id, row_number() OVER (PARTITION BY boring_id ORDER BY i) - 1 AS k, y AS a, CASE WHEN y IS NOT NULL THEN lead(y) OVER (PARTITION BY boring_id ORDER BY i) END AS b, f,
    CAST(NULL AS INT) AS spt, CASE WHEN o % 3 = 0 THEN CAST(o % 40 AS DOUBLE) END AS gw, CAST(o % 300 AS DOUBLE) AS el, round(0.36e0 + 0.6e0 * c, 2) AS conf
    FROM (SELECT g.boring_id, o, interval_index AS i, round(a * (210e0 + 100 * interval_index) + b, 2) AS y, {_family('((o + interval_index) % 12)')} AS f, {_family_conf('((o + interval_index) % 12)')} AS c FROM {box} AS g LEFT JOIN ({axis}) AS x USING (boring_id)) AS h WHERE f IS NOT NULL"""


_GENERIC = _generic("true")
_SPOON = f"""SELECT boring_id, interval_index AS k, a, b, {_family('((o + interval_index) % 12)')} AS f, coalesce(CASE WHEN spt_n < 100 THEN spt_n END, 5) + 1 AS spt, CASE WHEN o % 3 = 0 THEN CAST(o % 40 AS DOUBLE) END AS gw, CAST(o % 300 AS DOUBLE) AS el,
    CASE WHEN a IS NULL THEN 0.7e0 ELSE 1e0 END AS conf, 'S' || (interval_index + 1) AS sample FROM (SELECT *, coalesce(t1, b1) AS a, CASE WHEN t1 IS NOT NULL THEN b1 END AS b FROM (SELECT *, CASE WHEN top_depth < 100 THEN top_depth END AS t1, CASE WHEN bottom_depth BETWEEN 0 AND 99.9 THEN bottom_depth WHEN bottom_depth < 0 THEN -bottom_depth END AS b1 FROM ({_BOX}) AS b WHERE o % 2 = 0)) AS s"""


def pages_of(t: Tables, spoon: bool) -> DataFrame:
    """Pages that are spoon logs, or those that are not."""
    return log_ops.layout(ocr_boxes(t)).where(log_ops.is_spoon(F.col("emitted")) == spoon)


@query("boxes_generic", f"SELECT boring_id, CAST(k AS INT) AS interval_index, a AS top_depth, b AS bottom_depth, f AS uscs_class, spt AS spt_n, gw AS gw_depth, el AS elevation, conf AS confidence FROM ({_GENERIC}) AS g")
def boxes_generic(t: Tables) -> DataFrame:
    return log_ops.generic_rows(pages_of(t, False)).drop("page", "sample_type")


@query("boxes_spoon", f"SELECT boring_id, interval_index, a AS top_depth, b AS bottom_depth, f AS uscs_class, spt AS spt_n, sample AS sample_type, gw AS gw_depth, el AS elevation, conf AS confidence FROM (SELECT *, CAST(k AS INT) AS interval_index FROM ({_SPOON}) AS x) AS s")
def boxes_spoon(t: Tables) -> DataFrame:
    return log_ops.spoon_rows(pages_of(t, True)).drop("page")


def paged_boxes(t: Tables) -> DataFrame:
    """Boxes over several pages: spoon logs with one interval a page, the others with four; heads on page 1 only."""
    per_page = F.when(F.substring("boring_id", 2, 9).cast("int") % 2 == 0, 20).otherwise(80)
    return ocr_boxes(t).withColumn("page", (F.floor(F.col("seq") / per_page) + 1).cast("int"))


@query("ocr_page_policy", f"""SELECT boring_id, CAST(k AS INT) AS interval_index, a AS top_depth, f AS uscs_class FROM (SELECT boring_id, k, a, f FROM ({_SPOON}) AS s WHERE k < 4
    UNION ALL SELECT boring_id, k, a, f FROM ({_generic('interval_index < 4')}) AS g) AS u""")
def ocr_page_policy(t: Tables) -> DataFrame:
    return log_ops.parse_pages(paged_boxes(t)).select("boring_id", "interval_index", "top_depth", "uscs_class")


@query("parse_outcomes", f"""WITH l AS ({_LINES_SQL}), ok AS (SELECT DISTINCT boring_id FROM (SELECT boring_id, CAST({_re(logs.DEPTH)} AS DOUBLE) AS a, CAST({_re(logs.DEPTH, 2)} AS DOUBLE) AS b FROM l) WHERE b >= a AND b - a <= 100)
    SELECT boring_id, CASE WHEN boring_id IN (SELECT boring_id FROM ok) THEN 'parsed' WHEN boring_id IN (SELECT boring_id FROM l) THEN 'pending' ELSE 'failed' END AS outcome FROM borings""")
def parse_outcomes(t: Tables) -> DataFrame:
    texts = log_texts(t)
    return log_ops.parse_outcomes(t.borings, log_ops.parse_log_text(texts), texts)
