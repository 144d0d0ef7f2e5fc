"""Stand-in views over the given tables.

Each view is one SQL text that Spark and DuckDB both read ({str} is the string type's name), so a query's
oracle can start from the very same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "borings": """
        SELECT 'B' || lpad(CAST(c_custkey AS {str}), 7, '0') AS boring_id, c_custkey AS objectid, c_mktsegment AS pid, c_name AS label,
            CASE WHEN c_custkey % 89 = 0 THEN NULL WHEN c_custkey % 97 = 0 THEN -80e0 ELSE round(-75.5e0 + (c_custkey * 7919 % 10007) * 1.5e-4, 6) END AS lon,
            CASE WHEN c_custkey % 89 = 0 THEN NULL ELSE round(38.9e0 + (c_custkey * 4639 % 10009) * 2.4e-4, 6) END AS lat,
            300000e0 + (c_custkey * 7919 % 10007) * 30e0 AS x_ft, 100000e0 + (c_custkey * 4639 % 10009) * 60e0 AS y_ft
        FROM customer""",
    "soil_labels": """
        SELECT p_partkey AS objectid, upper(substr(p_type, 1, 2)) || '-' || CAST(p_size % 6 AS {str}) AS primary_label, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END AS drainage,
            round(-75.5e0 + (p_partkey * 6367 % 10007) * 1.5e-4 + 5e-5, 6) AS lon, round(38.9e0 + (p_partkey * 8111 % 10009) * 2.4e-4 + 7e-5, 6) AS lat,
            300011e0 + (p_partkey * 6367 % 10007) * 30e0 AS x_ft, 100007e0 + (p_partkey * 8111 % 10009) * 60e0 AS y_ft
        FROM part""",
    "strata": """
        SELECT boring_id, CAST(i AS INT) AS interval_index,
            CASE WHEN l_discount = 0 THEN NULL WHEN l_quantity = 50 THEN i * 5e0 + 250e0 ELSE i * 5e0 + l_quantity % 5 END AS top_depth,
            CASE WHEN l_tax = 0 THEN NULL WHEN l_tax = 8e-2 THEN i * 5e0 - 1e0 ELSE i * 5e0 + l_quantity % 5 + 2e0 END AS bottom_depth,
            CASE l_partkey % 12 WHEN 1 THEN 'SP' WHEN 2 THEN 'SM' WHEN 3 THEN 'CL' WHEN 4 THEN 'SP-SM' WHEN 5 THEN 'CH' WHEN 6 THEN 'ML' WHEN 7 THEN 'GW' WHEN 8 THEN 'PT' WHEN 9 THEN 'FILL' WHEN 10 THEN ' sc ' WHEN 11 THEN 'XX' END AS uscs_class,
            CASE WHEN l_linestatus = 'O' AND l_quantity < 4 THEN NULL ELSE CAST(floor((l_quantity - 1) * 2.2e0) AS INT) END AS spt_n,
            CASE WHEN l_linenumber = 3 THEN 6.5e0 + l_orderkey % 7 END AS gw_depth, round(0.3e0 + l_discount, 2) AS confidence,
            CASE WHEN l_returnflag = 'R' THEN 'pending' ELSE 'parsed' END AS ocr_status
        FROM (SELECT *, 'B' || lpad(CAST(l_orderkey AS {str}), 7, '0') AS boring_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS i FROM lineitem) AS l""",
    "surficial_vertices": """
        SELECT CAST(n_nationkey AS BIGINT) AS objectid, k AS seq,
            -75.5e0 + 0.3e0 * (n_nationkey % 5) + CASE WHEN k IN (1, 2) THEN 0.3e0 ELSE 0e0 END + CASE WHEN k IN (2, 3) THEN 0.05e0 ELSE 0e0 END AS x,
            38.9e0 + 0.48e0 * floor(n_nationkey / 5e0) + CASE WHEN k IN (2, 3) THEN 0.48e0 ELSE 0e0 END AS y
        FROM nation CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS t(k) WHERE n_nationkey <> 24""",
    "bedrock_vertices": """
        SELECT CAST(r_regionkey AS BIGINT) AS objectid, k AS seq, -75.5e0 + 0.3e0 * r_regionkey + CASE WHEN k IN (1, 2) THEN 0.3e0 ELSE 0e0 END AS x, CASE WHEN k IN (2, 3) THEN 41.3e0 ELSE 38.9e0 END AS y
        FROM region CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS t(k)""",
    "ssurgo_vertices": """
        SELECT s_suppkey AS objectid, k AS seq, -75.5e0 + 0.01e0 * (s_suppkey * 37 % 150) + CASE WHEN k IN (1, 2) THEN 0.05e0 ELSE 0e0 END AS x, 38.9e0 + 0.01e0 * (s_suppkey * 53 % 240) + CASE WHEN k IN (2, 3) THEN 0.05e0 ELSE 0e0 END AS y
        FROM supplier CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS t(k)""",
    "surficial_units": "SELECT CAST(n_nationkey AS BIGINT) AS objectid, n_name AS geoname, 'L' || CAST(n_nationkey % 7 AS {str}) AS lithology, 'A' || CAST(n_regionkey AS {str}) AS geoage FROM nation WHERE n_nationkey <> 24",
    "bedrock_units": "SELECT CAST(r_regionkey AS BIGINT) AS objectid, r_name AS geoname, 'B' || CAST(r_regionkey AS {str}) AS lithology FROM region",
    "ssurgo_units": "SELECT s_suppkey AS objectid, CAST(s_suppkey % 50 AS {str}) AS mukey, 'map unit ' || CAST(s_suppkey % 50 AS {str}) AS muname FROM supplier",
    "ssurgo_component": "SELECT CAST(p_partkey AS {str}) AS cokey, CAST(p_partkey % 50 AS {str}) AS mukey, p_name AS compname, nullif(p_size, 13) AS comppct_r, p_brand AS drainagecl FROM part",
    "ssurgo_muaggatt": "SELECT CAST(n_nationkey AS {str}) AS mukey, substr('ABCD', n_nationkey % 4 + 1, 1) AS hydgrpdcd, n_nationkey * 10e0 AS brockdepmin FROM nation",
    "ssurgo_mapunit": "SELECT CAST(n_nationkey AS {str}) AS mukey, n_name AS muname, CAST(n_regionkey AS {str}) AS lkey FROM nation",
    "ssurgo_legend": "SELECT CAST(r_regionkey AS {str}) AS lkey, CASE WHEN r_regionkey < 3 THEN 'NJ' ELSE 'PA' END || lpad(CAST(r_regionkey AS {str}), 3, '0') AS areasymbol FROM region",
    "dem_samples": "SELECT 'B' || lpad(CAST(c_custkey AS {str}), 7, '0') AS boring_id, c_acctbal / 10 AS elevation_m, CAST(c_custkey % 30 AS DOUBLE) AS slope_deg FROM customer WHERE c_custkey % 4 <> 0",
    "manifest": "SELECT event_type AS kind, CAST(user_id AS {str}) AS key, CASE event_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'pending' ELSE 'failed' END AS status, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS rows_out, event_id AS version FROM events",
    "class_predictions": "SELECT vec_id AS row_id, vec_id % 5 AS fold, label AS y, embedding AS scores FROM embeddings",
    "reg_predictions": "SELECT l_orderkey * 100 + l_linenumber AS row_id, l_orderkey % 5 AS fold, ln(1 + l_quantity) AS mu, 0.1e0 + l_discount AS sigma, ln(1 + l_extendedprice / 1000) AS y FROM lineitem",
}
_NAMES = {"spark": "string", "duckdb": "varchar"}


def referenced(sql: str) -> list[str]:
    """Views that a text names, in the order in which they can be defined."""
    found: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql) and name not in found:
            found.append(name)
    return found


def oracle(sql: str) -> str:
    """DuckDB text with the views it names in front."""
    views = ",\n".join(f"{v} AS ({VIEWS[v].format(str=_NAMES['duckdb'])})" for v in referenced(sql))
    body = sql.strip()
    if not views:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{body[14:]}"
    return f"WITH {views},\n{body[4:]}" if body.upper().startswith("WITH") else f"WITH {views}\n{body}"


class Tables:
    """Given tables and stand-in views of one folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        sql = VIEWS[name].format(str=_NAMES["spark"])
        used = [b for b in BASE if re.search(rf"\b(FROM|JOIN) {b}\b", sql)]
        for b in used:
            sql = re.sub(rf"\b(FROM|JOIN) {b}\b", rf"\1 {{{b}}}", sql)
        return self.spark.sql(sql, **{b: getattr(self, b) for b in used})

    def polygons(self, layer: str) -> DataFrame:
        """Units of a layer (surficial, bedrock, ssurgo) with their polygons."""
        from stratalake.operators.pip import polygons_from_vertices

        return getattr(self, f"{layer}_units").join(polygons_from_vertices(getattr(self, f"{layer}_vertices")), "objectid")
