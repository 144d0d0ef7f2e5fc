"""Registered queries: covariates, graphs, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.operators import graph, knn, pip, report
from stratalake.plans.fixtures import Tables
from stratalake.plans.registry import query
from stratalake.plans.sources import _QUALITY, quality_rows


def _within(layer: str, points: str, order: str, extra: str) -> str:
    """Common tables: per point of ``points`` (id, lon, lat) the unit of a layer strictly over it."""
    v = f"{layer}_vertices"
    return f"""
    {layer}_seg AS (SELECT objectid, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM {v} WINDOW w AS (PARTITION BY objectid ORDER BY seq)),
    {layer}_hit AS (SELECT id, objectid FROM (SELECT p.id, s.objectid, sum(((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1)::INT) AS n,
            bool_or((x2 - x1) * (lat - y1) = (y2 - y1) * (lon - x1) AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS e
            FROM {points} AS p JOIN {layer}_seg AS s ON x2 IS NOT NULL AND lon IS NOT NULL GROUP BY p.id, s.objectid) WHERE n % 2 = 1 AND NOT e),
    {layer}_one AS (SELECT id, {extra} FROM (SELECT h.id, u.*, row_number() OVER (PARTITION BY h.id ORDER BY {order}) AS k FROM {layer}_hit AS h JOIN {layer}_units AS u USING (objectid)) WHERE k = 1)"""


def _covariates(points: str, rows: str) -> str:
    return f"""pts AS ({points}), {_within('surficial', 'pts', 'u.objectid', 'geoname AS surficial_unit, lithology AS surficial_lithology, geoage AS surficial_age')},
    {_within('bedrock', 'pts', 'u.objectid', 'geoname AS bedrock_unit, lithology AS bedrock_lithology')}, {_within('ssurgo', 'pts', 'u.mukey, u.objectid', 'mukey AS ssurgo_mukey, muname AS ssurgo_muname')},
    dom AS (SELECT mukey, compname, drainagecl FROM (SELECT *, row_number() OVER (PARTITION BY mukey ORDER BY comppct_r DESC NULLS LAST, cokey) AS k FROM ssurgo_component) WHERE k = 1),
    {rows} AS (SELECT pts.id, surficial_unit, surficial_lithology, surficial_age, bedrock_unit, bedrock_lithology, ssurgo_mukey, ssurgo_muname, compname AS ssurgo_component, drainagecl AS ssurgo_drainagecl, hydgrpdcd AS ssurgo_hydgrp
        FROM pts LEFT JOIN surficial_one USING (id) LEFT JOIN bedrock_one USING (id) LEFT JOIN ssurgo_one USING (id) LEFT JOIN dom ON dom.mukey = ssurgo_mukey LEFT JOIN ssurgo_muaggatt AS m ON m.mukey = ssurgo_mukey)"""


_BORINGS = "SELECT boring_id AS id, lon, lat FROM borings"
_COV = _covariates(_BORINGS, "cov")


def covariates(t: Tables, points: DataFrame | None = None, point_id: str = "boring_id") -> DataFrame:
    points = t.borings if points is None else points
    return pip.point_covariates(points, point_id, t.polygons("surficial"), t.polygons("bedrock"), t.polygons("ssurgo"), t.ssurgo_component, t.ssurgo_muaggatt)


@query("point_in_polygon_covariates", f"WITH {_COV} SELECT * FROM cov")
def point_in_polygon_covariates(t: Tables) -> DataFrame:
    return covariates(t)


@query("label_covariates", f"WITH {_covariates('SELECT objectid AS id, lon, lat FROM soil_labels', 'cov')} SELECT * FROM cov")
def label_covariates(t: Tables) -> DataFrame:
    return covariates(t, t.soil_labels, "objectid")


@query("covariate_coverage", f"""WITH {_COV} SELECT count(*) AS total, count(surficial_unit) AS with_surficial, round(100e0 * count(surficial_unit) / count(*), 2) AS pct_surficial, count(bedrock_unit) AS with_bedrock,
    round(100e0 * count(bedrock_unit) / count(*), 2) AS pct_bedrock, count(ssurgo_mukey) AS with_ssurgo, round(100e0 * count(ssurgo_mukey) / count(*), 2) AS pct_ssurgo FROM cov""")
def covariate_coverage(t: Tables) -> DataFrame:
    return report.coverage(covariates(t), {"surficial": "surficial_unit", "bedrock": "bedrock_unit", "ssurgo": "ssurgo_mukey"})


@query("top_units", f"WITH {_COV} SELECT surficial_unit, count(*) AS n FROM cov WHERE surficial_unit IS NOT NULL GROUP BY surficial_unit ORDER BY n DESC, surficial_unit LIMIT 8")
def top_units(t: Tables) -> DataFrame:
    return report.top_units(covariates(t), "surficial_unit")


@query("ssurgo_attributes", """WITH dom AS (SELECT mukey, compname, drainagecl FROM (SELECT *, row_number() OVER (PARTITION BY mukey ORDER BY comppct_r DESC NULLS LAST, cokey) AS k FROM ssurgo_component) WHERE k = 1)
    SELECT u.objectid, u.mukey, compname, drainagecl, hydgrpdcd FROM ssurgo_units AS u LEFT JOIN dom USING (mukey) LEFT JOIN ssurgo_muaggatt USING (mukey)""")
def ssurgo_attributes(t: Tables) -> DataFrame:
    dom = pip.dominant_component(t.ssurgo_component).select("mukey", "compname", "drainagecl")
    return t.ssurgo_units.join(dom, "mukey", "left").join(t.ssurgo_muaggatt, "mukey", "left").select("objectid", "mukey", "compname", "drainagecl", "hydgrpdcd")


@query("dominant_component", "SELECT mukey, cokey, compname, comppct_r FROM (SELECT *, row_number() OVER (PARTITION BY mukey ORDER BY comppct_r DESC NULLS LAST, cokey) AS k FROM ssurgo_component) WHERE k = 1")
def dominant_component(t: Tables) -> DataFrame:
    return pip.dominant_component(t.ssurgo_component).select("mukey", "cokey", "compname", "comppct_r")


@query("ssurgo_inner_chain", "SELECT c.cokey, c.mukey, c.compname, m.muname, l.areasymbol FROM ssurgo_component AS c JOIN ssurgo_mapunit AS m ON c.mukey = m.mukey JOIN ssurgo_legend AS l ON m.lkey = l.lkey WHERE l.areasymbol LIKE 'NJ%'")
def ssurgo_inner_chain(t: Tables) -> DataFrame:
    legend = t.ssurgo_legend.where("areasymbol LIKE 'NJ%'")
    return t.ssurgo_component.join(t.ssurgo_mapunit.join(legend, "lkey"), "mukey").select("cokey", "mukey", "compname", "muname", "areasymbol")


@query("node_features", f"""WITH {_COV}, q AS ({_QUALITY}), n AS (SELECT boring_id, count(*) AS n_intervals FROM strata GROUP BY boring_id)
    SELECT b.boring_id, b.lon, b.lat, round(coalesce(elevation_m, CASE WHEN objectid % 2 = 0 THEN 12e0 END), 6) AS elevation, slope_deg, coord_quality_flag, surficial_unit, surficial_lithology, surficial_age, bedrock_unit, ssurgo_mukey, ssurgo_muname, ssurgo_component,
        ssurgo_drainagecl, ssurgo_hydgrp, n_intervals FROM borings AS b LEFT JOIN cov ON cov.id = b.boring_id LEFT JOIN q USING (boring_id) LEFT JOIN dem_samples USING (boring_id) LEFT JOIN n USING (boring_id)""")
def node_features(t: Tables) -> DataFrame:
    return report.node_features(quality_rows(t), covariates(t), t.dem_samples, t.strata, F.when(F.col("objectid") % 2 == 0, 12.0))


@query("bbox", "SELECT round(min(lon), 3) AS min_lon, round(min(lat), 3) AS min_lat, round(max(lon), 3) AS max_lon, round(max(lat), 3) AS max_lat FROM borings")
def bbox(t: Tables) -> DataFrame:
    return report.bounding_box(t.borings)


@query("sampling_bias_cells", """WITH a AS (SELECT count(*) AS c FROM borings WHERE lon IS NOT NULL GROUP BY round(lon, 2), round(lat, 2)), b AS (SELECT 1 FROM borings WHERE lon IS NOT NULL GROUP BY round(lon, 1), round(lat, 1))
    SELECT (SELECT count(*) FROM a) AS cells_001, (SELECT max(c) FROM a) AS max_per_cell, (SELECT count(*) FROM b) AS cells_01""")
def sampling_bias_cells(t: Tables) -> DataFrame:
    return report.occupied_cells(t.borings)


_COUNTED = ("borings", "soil_labels", "strata", "ssurgo_component", "ssurgo_muaggatt", "dem_samples")


@query("table_inventory", " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n FROM {c}" for c in _COUNTED))
def table_inventory(t: Tables) -> DataFrame:
    return report.table_inventory({c: getattr(t, c) for c in _COUNTED})


# --- graphs -----------------------------------------------------------------------------------------------
_RADIUS = repr(graph.RADIUS_FT) + "e0"
_PTS = "SELECT boring_id AS id, x_ft AS x, y_ft AS y, pid AS unit FROM borings"
_LAB = "SELECT CAST(objectid AS VARCHAR) AS id, x_ft AS x, y_ft AS y, primary_label AS unit FROM soil_labels"


def _near(name: str, q: str, p: str, k: int, same: bool) -> str:
    own = "AND q.id <> p.id" if same else ""
    return f"{name} AS (SELECT * FROM (SELECT q.id AS qid, p.id, q.unit AS qu, p.unit AS pu, sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS d, row_number() OVER (PARTITION BY q.id ORDER BY sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)), p.id) AS rank FROM ({q}) AS q JOIN ({p}) AS p ON true {own}) WHERE rank <= {k})"


def _edges(name: str, near: str, kind: str, weight: str, where: str = "true") -> str:
    return f"{name} AS (SELECT DISTINCT least(qid, id) AS src, greatest(qid, id) AS dst, '{kind}' AS edge_type, {weight} AS weight FROM {near} WHERE {where})"


_W = "round(1 / (1 + d), 6)"
_UNIT_WHERE = f"d <= {_RADIUS} AND qu = pu AND qu <> ''"
_KNN = f"{_near('nn', _PTS, _PTS, 8, True)}, {_edges('knn_e', 'nn', 'knn', _W)}"
_UNIT = f"{_near('n25', _PTS, _PTS, 25, True)}, {_edges('unit_e', 'n25', 'same_geology', '1e0', _UNIT_WHERE)}"
_BOTH = f"SELECT 'b:' || id AS id, x, y, unit FROM ({_PTS}) AS b UNION ALL SELECT 'l:' || id, x, y, unit FROM ({_LAB}) AS l"
_UNION = f"""u_pts AS ({_BOTH}), {_near('u8', 'SELECT * FROM u_pts', 'SELECT * FROM u_pts', 8, True)}, {_near('u25', 'SELECT * FROM u_pts', 'SELECT * FROM u_pts', 25, True)},
    {_near('u6', "SELECT * FROM u_pts WHERE id LIKE 'l:%'", "SELECT * FROM u_pts WHERE id LIKE 'b:%'", 6, False)}, {_edges('u_k', 'u8', 'knn', _W)}, {_edges('u_u', 'u25', 'same_geology', '1e0', _UNIT_WHERE)},
    u_e AS (SELECT * FROM u_k UNION ALL SELECT * FROM u_u UNION ALL SELECT qid, id, 'label_boring', {_W} FROM u6)"""




def _delaunay(name: str, points: str) -> str:
    """Delaunay edges by the empty-circle test: pairs whose interval of circle centres the nearest points leave open, then against all."""
    open_ = """coalesce(max(CASE WHEN cross_ < 0 THEN over_ / (2 * cross_) END), -1e300) <= coalesce(min(CASE WHEN cross_ > 0 THEN over_ / (2 * cross_) END), 1e300) + 1e-12
        AND NOT bool_or(cross_ = 0 AND over_ < -1e-12 * w2)"""
    measured = "qx * wy - qy * wx AS cross_, wx * wx + wy * wy - (wx * qx + wy * qy) AS over_, wx * wx + wy * wy AS w2"
    return f"""{name}_s AS (SELECT min(id) AS id, x, y FROM ({points}) AS p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY x, y),
    {name}_n AS (SELECT * FROM (SELECT a.id, b.x - a.x AS wx, b.y - a.y AS wy, row_number() OVER (PARTITION BY a.id ORDER BY (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), b.id) AS k FROM {name}_s AS a JOIN {name}_s AS b ON a.id <> b.id) WHERE k <= 8),
    {name}_p AS (SELECT src, dst, qx, qy, x, y FROM (SELECT src, dst, qx, qy, x, y, {measured} FROM (SELECT a.id AS src, b.id AS dst, b.x - a.x AS qx, b.y - a.y AS qy, a.x, a.y FROM {name}_s AS a JOIN {name}_s AS b ON a.id < b.id) JOIN {name}_n AS n ON n.id = src)
        GROUP BY src, dst, qx, qy, x, y HAVING {open_}),
    {name}_e AS (SELECT src, dst, 'delaunay' AS edge_type, round(1 / (1 + sqrt(qx * qx + qy * qy)), 6) AS weight FROM (SELECT src, dst, qx, qy, {measured} FROM (SELECT p.src, p.dst, p.qx, p.qy, w.x - p.x AS wx, w.y - p.y AS wy FROM {name}_p AS p JOIN {name}_s AS w ON w.id <> p.src))
        GROUP BY src, dst, qx, qy HAVING {open_})"""


_DEL = _delaunay("del", _PTS)
_GRAPH = f"{_KNN}, {_UNIT}, {_DEL}, g_e AS (SELECT * FROM knn_e UNION ALL SELECT * FROM unit_e UNION ALL SELECT * FROM del_e)"
_WHOLE = f"{_UNION}, {_delaunay('u_del', 'SELECT * FROM u_pts')}, w_e AS (SELECT * FROM u_e UNION ALL SELECT * FROM u_del_e)"


def graph_points(t: Tables) -> DataFrame:
    return t.borings.select(F.col("boring_id").alias("id"), F.col("x_ft").alias("x"), F.col("y_ft").alias("y"), F.col("pid").alias("unit"))


def graph_labels(t: Tables) -> DataFrame:
    return t.soil_labels.select(F.col("objectid").cast("string").alias("id"), F.col("x_ft").alias("x"), F.col("y_ft").alias("y"), F.col("primary_label").alias("unit"))


@query("knn_edges", f"WITH {_KNN} SELECT * FROM knn_e")
def knn_edges(t: Tables) -> DataFrame:
    return graph.knn_edges(graph_points(t))


@query("label_boring_edges", f"WITH {_near('nn', _LAB, _PTS, 6, False)} SELECT qid AS src, id AS dst, 'label_boring' AS edge_type, {_W} AS weight FROM nn")
def label_boring_edges(t: Tables) -> DataFrame:
    return graph.label_edges(graph_labels(t), graph_points(t))


@query("same_geology_edges", f"WITH {_UNIT} SELECT * FROM unit_e")
def same_geology_edges(t: Tables) -> DataFrame:
    return graph.same_unit_edges(graph_points(t))


@query("delaunay_edges", f"WITH {_DEL} SELECT src, dst, weight FROM del_e")
def delaunay_edges(t: Tables) -> DataFrame:
    return graph.delaunay_edges(graph_points(t).select("id", "x", "y"))


@query("boring_graph", f"WITH {_GRAPH} SELECT * FROM g_e")
def boring_graph(t: Tables) -> DataFrame:
    return graph.boring_graph(graph_points(t))


@query("edge_type_counts", f"WITH {_GRAPH} SELECT edge_type, count(*) AS n FROM g_e GROUP BY edge_type")
def edge_type_counts(t: Tables) -> DataFrame:
    return report.count_by(graph.boring_graph(graph_points(t)), "edge_type")


@query("edge_subset", f"WITH {_GRAPH} SELECT * FROM g_e WHERE edge_type IN ('knn', 'delaunay')")
def edge_subset(t: Tables) -> DataFrame:
    return graph.edge_subset(graph.boring_graph(graph_points(t)), ["knn", "delaunay"])


def union_edges(t: Tables) -> DataFrame:
    return graph.union_graph(graph_points(t), graph_labels(t))


@query("union_graph", f"WITH {_WHOLE} SELECT *, CASE WHEN src LIKE 'b:%' THEN 'boring' ELSE 'label' END AS src_type, CASE WHEN dst LIKE 'b:%' THEN 'boring' ELSE 'label' END AS dst_type FROM w_e")
def union_graph(t: Tables) -> DataFrame:
    return union_edges(t)


@query("k_hop_reachability", f"""WITH {_WHOLE}, ways AS (SELECT src, dst FROM w_e UNION SELECT dst, src FROM w_e), r0 AS (SELECT DISTINCT src AS id FROM ways WHERE src LIKE 'b:%'), r1 AS (SELECT id FROM r0 UNION SELECT dst FROM ways JOIN r0 ON src = id),
    r2 AS (SELECT id FROM r1 UNION SELECT dst FROM ways JOIN r1 ON src = id), r3 AS (SELECT id FROM r2 UNION SELECT dst FROM ways JOIN r2 ON src = id), lab AS (SELECT DISTINCT src AS id FROM ways WHERE src LIKE 'l:%')
    SELECT count(*) AS labels, count(r3.id) AS reached, round(count(r3.id) / count(*), 6) AS share FROM lab LEFT JOIN r3 USING (id)""")
def k_hop_reachability(t: Tables) -> DataFrame:
    return graph.reachability(union_edges(t))


@query("directed_edges", f"WITH {_KNN} SELECT * FROM knn_e UNION ALL SELECT dst, src, edge_type, weight FROM knn_e")
def directed_edges(t: Tables) -> DataFrame:
    return graph.directed(graph.knn_edges(graph_points(t)))


@query("neighbor_mean", f"""WITH {_GRAPH}, d AS (SELECT src, dst, edge_type FROM g_e UNION ALL SELECT dst, src, edge_type FROM g_e)
    SELECT dst AS id, edge_type, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM d JOIN ({_PTS}) AS p ON p.id = src GROUP BY dst, edge_type""")
def neighbor_mean(t: Tables) -> DataFrame:
    points = graph_points(t)
    return graph.neighbor_mean(graph.boring_graph(points), points, ["x", "y"])


@query("edge_set_diff", f"""WITH {_KNN}, {_near('n6', _PTS, _PTS, 6, True)}, {_edges('six_e', 'n6', 'knn', _W)}
    SELECT edge_type, count_if(b.src IS NULL)::BIGINT AS only_left, count_if(a.src IS NULL)::BIGINT AS only_right, count_if(a.src IS NOT NULL AND b.src IS NOT NULL)::BIGINT AS shared,
        round((count_if(b.src IS NULL) + count_if(a.src IS NULL)) / count(*), 6) AS diff_share, round(max(abs(a.weight - b.weight)), 6) AS max_weight_gap FROM knn_e AS a FULL JOIN six_e AS b USING (src, dst, edge_type) GROUP BY edge_type""")
def edge_set_diff(t: Tables) -> DataFrame:
    points = graph_points(t)
    return graph.edge_set_diff(graph.knn_edges(points), graph.knn_edges(points, 6))


@query("graph_context_features", f"""WITH {_KNN}, d AS (SELECT src, dst FROM knn_e UNION ALL SELECT dst, src FROM knn_e), p AS (SELECT id, ln(x) AS x FROM ({_PTS}) AS q),
    h1 AS (SELECT p.id, coalesce(avg(q.x), 0) AS x FROM p LEFT JOIN d ON d.dst = p.id LEFT JOIN p AS q ON q.id = d.src GROUP BY p.id), h2 AS (SELECT p.id, coalesce(avg(q.x), 0) AS x FROM p LEFT JOIN d ON d.dst = p.id LEFT JOIN h1 AS q ON q.id = d.src GROUP BY p.id),
    h3 AS (SELECT p.id, coalesce(avg(q.x), 0) AS x FROM p LEFT JOIN d ON d.dst = p.id LEFT JOIN h2 AS q ON q.id = d.src GROUP BY p.id)
    SELECT p.id, round(p.x, 6) AS x, round(h1.x, 6) AS x_1, round(h2.x, 6) AS x_2, round(h3.x, 6) AS x_3 FROM p JOIN h1 USING (id) JOIN h2 USING (id) JOIN h3 USING (id)""")
def graph_context_features(t: Tables) -> DataFrame:
    points = graph_points(t)
    return graph.graph_context(graph.knn_edges(points), points.withColumn("x", F.ln("x")), ["x"])


@query("knn_join", f"WITH {_near('nn', _LAB, _PTS, 3, False)} SELECT qid, id, round(d, 6) AS d, CAST(rank AS INT) AS rank FROM nn")
def knn_join(t: Tables) -> DataFrame:
    return knn.knn(graph_labels(t), graph_points(t), 3)


def union_points(t: Tables) -> DataFrame:
    """Nodes of the union graph."""
    b, lab = (rows.withColumn("id", F.concat(F.lit(k), F.col("id").cast("string"))) for k, rows in (("b:", graph_points(t)), ("l:", graph_labels(t))))
    return b.unionByName(lab)


_HOPS = "\n    ".join(
    f"""n{h} AS (SELECT d.dst AS id, d.edge_type, avg(v.x) AS x FROM ways AS d JOIN h{h - 1} AS v ON v.id = d.src GROUP BY d.dst, d.edge_type), h{h} AS (SELECT p.id, coalesce(m.x, 0) AS x FROM h0 AS p LEFT JOIN (SELECT id, avg(x) AS x FROM n{h} GROUP BY id) AS m USING (id)),"""
    for h in (1, 2, 3)
)


@query("graph_context_features_union", f"""WITH {_WHOLE}, ways AS (SELECT src, dst, edge_type FROM w_e UNION ALL SELECT dst, src, edge_type FROM w_e), h0 AS (SELECT id, ln(x) AS x FROM u_pts),
    {_HOPS} z AS (SELECT 1)
    SELECT h0.id, round(h0.x, 6) AS x, round(h1.x, 6) AS x_1, round(h2.x, 6) AS x_2, round(h3.x, 6) AS x_3 FROM h0 JOIN h1 USING (id) JOIN h2 USING (id) JOIN h3 USING (id)""")
def graph_context_features_union(t: Tables) -> DataFrame:
    nodes = union_points(t).withColumn("log_x", F.ln("x"))
    return graph.union_context(nodes, ["log_x"]).withColumnsRenamed({f"log_x{h}": f"x{h}" for h in ("", "_1", "_2", "_3")})
