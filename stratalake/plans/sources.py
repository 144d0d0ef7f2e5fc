"""Registered queries: scans, coercion, audits, upserts, geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.functions import geo
from stratalake.operators import normalize
from stratalake.operators.logs import parse_log_text
from stratalake.plans.fixtures import Tables
from stratalake.plans.registry import query
from stratalake.sources import geojson, tables
from stratalake.storage import shared_dir, stored
from stratalake.streaming.ingest import ingest_logs, ingest_pages

_X, _Y = geo.project_sql("lon", "lat")


def page_payloads(t: Tables, per_page: int = 200, label: Column | None = None) -> DataFrame:
    """(src_offset, payload): borings as GeoJSON page texts."""
    b = t.borings
    properties = F.create_map(
        F.lit("OBJECTID"), F.col("objectid").cast("string"), F.lit("LID"), F.when(F.col("objectid") % 3 != 0, F.col("boring_id")), F.lit("LABEL"), F.col("label") if label is None else label, F.lit("PID"), F.col("pid"),
        F.lit("SRCE"), F.when(F.col("objectid") % 5 == 0, F.lit("x")).otherwise((F.col("objectid") % 9).cast("string")), F.lit("POINT_X"), F.col("x_ft").cast("string"), F.lit("POINT_Y"), F.lit(""),
    )
    geometry = F.when(F.col("lon").isNotNull(), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))
    pages = b.groupBy((F.floor(F.col("objectid") / per_page) * per_page).alias("src_offset")).agg(F.collect_list(feature).alias("features"))
    return pages.select("src_offset", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("payload"))


@query("geojson_page_scan", """
    SELECT CAST(floor(objectid / 200e0) * 200 AS BIGINT) AS src_offset, objectid, CASE WHEN objectid % 3 <> 0 THEN boring_id END AS lid, label, pid,
        CASE WHEN objectid % 5 <> 0 THEN CAST(objectid % 9 AS INT) END AS srce, x_ft AS point_x, CAST(NULL AS DOUBLE) AS point_y, lon, lat FROM borings""")
def geojson_page_scan(t: Tables) -> DataFrame:
    return geojson.page_rows(geojson.parse_pages(page_payloads(t)), "borings").select("src_offset", "objectid", "lid", "label", "pid", "srce", "point_x", "point_y", "lon", "lat")


@query("geojson_split_load", "SELECT objectid, boring_id AS lid, pid, lon, lat FROM borings")
def geojson_split_load(t: Tables) -> DataFrame:
    """Borings as GeoJSON files of 20,000 features each, read in eight parts a file."""
    home = shared_dir(t.spark, "geojson")
    properties = F.create_map(F.lit("OBJECTID"), F.col("objectid").cast("string"), F.lit("LID"), F.col("boring_id"), F.lit("PID"), F.col("pid"), F.lit("NOTE"), F.lit('a "}" in \\ text'))
    geometry = F.when(F.col("lon").isNotNull() | F.col("lat").isNotNull(), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))
    files = t.borings.groupBy(F.floor(F.col("objectid") / 20_000).alias("file")).agg(F.collect_list(feature).alias("features"))
    files.select("file", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("payload")).write.partitionBy("file").text(home)
    largest = t.spark.read.format("binaryFile").load(home).agg(F.max("length")).first()[0] or 1
    size, name = -(-largest // 8), "spark.sql.files.maxPartitionBytes"
    before = t.spark.conf.get(name)
    t.spark.conf.set(name, str(size))
    try:
        rows = stored(geojson.read_features(t.spark, home), "features")
    finally:
        t.spark.conf.set(name, before)
    p, point = F.col("properties"), F.from_json("geometry", "struct<coordinates: array<double>>")["coordinates"]
    return rows.select(geojson.coerce(p["OBJECTID"], "bigint").alias("objectid"), geojson.coerce(p["LID"], "string").alias("lid"), geojson.coerce(p["PID"], "string").alias("pid"), F.get(point, F.lit(0)).alias("lon"), F.get(point, F.lit(1)).alias("lat"))


@query("property_coercion", """
    SELECT event_id, try_cast(nullif(v, '') AS INT) AS as_int, try_cast(nullif(v, '') AS DOUBLE) AS as_double
    FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN CAST(event_id AS VARCHAR) ELSE NULL END AS v FROM events)""")
def property_coercion(t: Tables) -> DataFrame:
    k = F.col("event_id") % 4
    v = F.when(k == 0, F.lit("")).when(k == 1, F.lit("n/a")).when(k == 2, F.col("event_id").cast("string"))
    return t.events.select("event_id", geojson.coerce(v, "int").alias("as_int"), geojson.coerce(v, "double").alias("as_double"))


@query("property_ci_lookup", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE c_mktsegment END AS segment FROM customer")
def property_ci_lookup(t: Tables) -> DataFrame:
    name = F.when(F.col("c_custkey") % 3 == 0, "SEGMENT").when(F.col("c_custkey") % 3 == 1, "Segment").otherwise("other")
    return t.customer.select("c_custkey", geojson.property_ci(F.create_map(name, "c_mktsegment", F.lit("key"), F.col("c_custkey").cast("string")), "segment").alias("segment"))


@query("header_json_table", "SELECT cokey, mukey, compname, comppct_r FROM ssurgo_component")
def header_json_table(t: Tables) -> DataFrame:
    # the payload's columns stand in another order than the table's
    row = F.array("mukey", F.col("comppct_r").cast("string"), "cokey", "compname")
    body = t.ssurgo_component.groupBy("mukey").agg(F.collect_list(row).alias("rows"))
    head = F.array(F.array(*[F.lit(c) for c in ("mukey", "comppct_r", "cokey", "compname")]))
    payload = body.select(F.to_json(F.struct(F.concat(head, "rows").alias("Table"))).alias("payload"))
    return geojson.header_table(payload, {"cokey": "string", "mukey": "string", "compname": "string", "comppct_r": "int"})


_INFOS = "SELECT l_orderkey AS objectid, l_linenumber AS n, min(l_partkey) AS id, min(CASE WHEN l_partkey % 3 = 0 THEN 'application/pdf' ELSE 'image/tiff' END) AS kind FROM lineitem GROUP BY l_orderkey, l_linenumber"


@query("attachment_pick", f"""
    WITH a AS ({_INFOS}), r AS (SELECT *, row_number() OVER (PARTITION BY objectid ORDER BY kind <> 'application/pdf', n) AS k FROM a WHERE objectid % 7 <> 0)
    SELECT objectid, id AS attachment_id, 'log' || id AS name, kind AS content_type, 'https://host/x/' || objectid || '/attachments/' || id AS log_url FROM r WHERE k = 1""")
def attachment_pick(t: Tables) -> DataFrame:
    infos = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("id"), F.min(F.when(F.col("l_partkey") % 3 == 0, "application/pdf").otherwise("image/tiff")).alias("kind"))
    info = F.struct(F.col("id"), F.concat(F.lit("log"), F.col("id").cast("string")).alias("name"), F.col("kind").alias("contentType"), F.lit(1).alias("size"))
    groups = infos.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), info.alias("i")))), lambda x: x["i"]).alias("attachmentInfos"))
    # some parents have no files
    files = F.when(F.col("l_orderkey") % 7 == 0, F.slice("attachmentInfos", 1, 0)).otherwise(F.col("attachmentInfos"))
    group = F.struct(F.col("l_orderkey").alias("parentObjectId"), files.alias("attachmentInfos"))
    return geojson.pick_attachments(groups.select(F.to_json(F.struct(F.array(group).alias("attachmentGroups"))).alias("payload")), "https://host/x")


@query("id_from_filename", "SELECT c_custkey, 'B' || c_custkey AS boring_id FROM customer")
def id_from_filename(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/data/logs/B"), F.col("c_custkey").cast("string"), F.lit("__17__"), F.col("c_nationkey").cast("string"), F.lit(".pdf"))
    return t.customer.select("c_custkey", tables.id_from_filename(path).alias("boring_id"))


@query("geojson_feature_rows", "SELECT boring_id, lon, lat, 'Point' AS kind FROM borings WHERE lon IS NOT NULL AND lat IS NOT NULL")
def geojson_feature_rows(t: Tables) -> DataFrame:
    features = geojson.feature_rows(t.borings.select("boring_id", "lon", "lat"))
    f = F.from_json("feature", "struct<geometry: struct<type: string, coordinates: array<double>>, properties: struct<boring_id: string>>")
    return features.select(f["properties"]["boring_id"].alias("boring_id"), F.get(f["geometry"]["coordinates"], F.lit(0)).alias("lon"), F.get(f["geometry"]["coordinates"], F.lit(1)).alias("lat"), f["geometry"]["type"].alias("kind"))


@query("page_replace", """
    SELECT o_custkey AS page, o_orderkey, o_orderstatus FROM orders WHERE o_custkey % 4 <> 1
    UNION ALL SELECT o_custkey, o_orderkey, 'new' FROM orders WHERE o_custkey % 4 = 1 AND o_orderkey % 2 = 0
    UNION ALL SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_custkey % 4 = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 4 = 1 AND o_orderkey % 2 = 0)""")
def page_replace(t: Tables) -> DataFrame:
    old = t.orders.select(F.col("o_custkey").alias("page"), "o_orderkey", "o_orderstatus")
    new = old.where("page % 4 = 1 AND o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("new"))
    return tables.replace_keys(old, new, ["page"])


_QUALITY = f"""SELECT boring_id, CASE WHEN lon IS NULL OR lat IS NULL THEN 'no_geom' WHEN NOT (lon BETWEEN -75.7 AND -73.8 AND lat BETWEEN 38.8 AND 41.4) THEN 'out_of_nj_bbox'
    WHEN point_x IS NOT NULL AND (abs({_X} - point_x) > 50 OR abs({_Y} - point_y) > 50) THEN 'xy_geom_mismatch' ELSE 'ok' END AS coord_quality_flag
    FROM (SELECT *, CASE WHEN objectid % 5 <> 0 THEN {_X} + CASE WHEN objectid % 11 = 0 THEN 60e0 ELSE 1e0 END END AS point_x, {_Y} - 2e0 AS point_y FROM borings) AS b"""


def quality_rows(t: Tables) -> DataFrame:
    x, y = geo.project("lon", "lat")
    shifted = F.when(F.col("objectid") % 5 != 0, x + F.when(F.col("objectid") % 11 == 0, 60.0).otherwise(1.0))
    return normalize.coord_quality(t.borings.withColumns({"point_x": shifted, "point_y": y - 2.0}))


@query("coord_quality", _QUALITY)
def coord_quality(t: Tables) -> DataFrame:
    return quality_rows(t).select("boring_id", "coord_quality_flag")


@query("count_by_flag", f"SELECT coord_quality_flag, count(*) AS n FROM ({_QUALITY}) AS q GROUP BY coord_quality_flag")
def count_by_flag(t: Tables) -> DataFrame:
    from stratalake.operators.report import count_by

    return count_by(quality_rows(t), "coord_quality_flag")


_FIELDS = """SELECT CASE WHEN c_custkey % 3 = 0 THEN 'a' WHEN c_custkey % 3 = 1 THEN 'b' ELSE 'c' END AS layer,
    CASE c_custkey % 9 WHEN 0 THEN 'OBJECTID' WHEN 1 THEN 'POINT_X' WHEN 2 THEN 'WEBURL' WHEN 3 THEN 'FILENAME' WHEN 4 THEN 'ROUTE' WHEN 5 THEN 'SHAPE__Area' WHEN 6 THEN 'Pid' WHEN 7 THEN 'ELEV_FT' ELSE 'LABEL' END || '_' || CAST(c_custkey % 50 AS {s}) AS name,
    CASE WHEN c_custkey % 9 = 0 THEN 'esriFieldTypeOID' ELSE 'esriFieldTypeString' END AS type FROM {c}"""


def _fields(t: Tables) -> DataFrame:
    return t.spark.sql(_FIELDS.replace("{s}", "string").replace("{c}", "{customer}"), customer=t.customer)


def _any(tokens: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(name), '{x}')" for x in tokens) + ")"


_FIELDS_SQL = _FIELDS.replace("{s}", "varchar").replace("{c}", "customer")


@query("classify_fields", f"""SELECT layer, name, type, CASE WHEN type IN ('esriFieldTypeOID', 'esriFieldTypeGeometry') OR {_any(normalize.PLACE_TOKENS)} THEN 'spatial'
    WHEN {_any(normalize.DOC_TOKENS)} THEN 'doclink' ELSE 'attribute' END AS class FROM ({_FIELDS_SQL}) AS f""")
def classify_fields(t: Tables) -> DataFrame:
    return normalize.classify_fields(_fields(t))


@query("strata_field_verdict", f"SELECT layer, bool_or({_any(normalize.STRATA_TOKENS)} AND NOT {_any(('point_x', 'point_y', 'shape'))}) AS has_strata_field FROM ({_FIELDS_SQL}) AS f GROUP BY layer")
def strata_field_verdict(t: Tables) -> DataFrame:
    return normalize.strata_verdict(_fields(t))


@query("count_drift", "SELECT c_mktsegment AS layer, count(*) AS n, CASE WHEN c_mktsegment < 'C' THEN 300 END AS expected, c_mktsegment >= 'C' OR count(*) = 300 AS matches FROM customer GROUP BY c_mktsegment")
def count_drift(t: Tables) -> DataFrame:
    counts = t.customer.groupBy(F.col("c_mktsegment").alias("layer")).agg(F.count(F.lit(1)).alias("n"))
    expected = t.customer.select(F.col("c_mktsegment").alias("layer")).distinct().where("layer < 'C'").withColumn("expected", F.lit(300))
    return normalize.count_drift(counts, expected)


@query("project_state_plane", f"SELECT boring_id, round({_X}, 3) AS x, round({_Y}, 3) AS y FROM borings WHERE lon IS NOT NULL")
def project_state_plane(t: Tables) -> DataFrame:
    x, y = geo.project("lon", "lat")
    return t.borings.where("lon IS NOT NULL").select("boring_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


_LON, _LAT = geo.unproject_sql("x_ft", "y_ft")


@query("unproject_state_plane", f"SELECT boring_id, round({_LON}, 6) AS lon, round({_LAT}, 6) AS lat FROM borings")
def unproject_state_plane(t: Tables) -> DataFrame:
    lon, lat = geo.unproject("x_ft", "y_ft")
    return t.borings.select("boring_id", lon.alias("lon"), lat.alias("lat"))


_ENDS = "SELECT a.boring_id AS src, b.boring_id AS dst, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2 FROM borings AS a JOIN borings AS b ON b.objectid = a.objectid + 1 WHERE a.lon IS NOT NULL AND b.lon IS NOT NULL"


def edge_ends(t: Tables) -> DataFrame:
    a = t.borings.where("lon IS NOT NULL").select(F.col("boring_id").alias("src"), (F.col("objectid") + 1).alias("next"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    b = t.borings.where("lon IS NOT NULL").select(F.col("boring_id").alias("dst"), F.col("objectid").alias("next"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return a.join(b, "next").drop("next")


@query("haversine_edge_length", f"SELECT src, dst, round({geo.haversine_sql('lon1', 'lat1', 'lon2', 'lat2')}, 3) AS metres FROM ({_ENDS}) AS e")
def haversine_edge_length(t: Tables) -> DataFrame:
    return edge_ends(t).select("src", "dst", F.round(F.expr(geo.haversine_sql("lon1", "lat1", "lon2", "lat2")), 3).alias("metres"))


@query("vincenty_edge_length")
def vincenty_edge_length(t: Tables) -> DataFrame:
    from stratalake.functions.vincenty import vincenty

    return edge_ends(t).select("src", "dst", F.round(vincenty("lon1", "lat1", "lon2", "lat2"), 3).alias("metres"))


@query("spatial_block", "SELECT boring_id, CAST(floor(x_ft / 20000) * 1000003 + floor(y_ft / 20000) AS BIGINT) AS block FROM borings")
def spatial_block(t: Tables) -> DataFrame:
    return t.borings.select("boring_id", geo.block_id(F.col("x_ft"), F.col("y_ft"), 20000.0).alias("block"))


@query("dedupe_latest", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def dedupe_latest(t: Tables) -> DataFrame:
    return normalize.latest(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.desc("o_orderkey"))


@query("upsert_partial", """
    SELECT coalesce(c.c_custkey, o.k) AS c_custkey, CASE WHEN o.k IS NOT NULL THEN o.name ELSE c.c_name END AS c_name, c.c_mktsegment, coalesce(c.c_acctbal, o.bal) AS c_acctbal
    FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) AS c FULL JOIN (SELECT c_custkey AS k, upper(c_name) AS name, c_acctbal + 1 AS bal FROM customer WHERE c_custkey % 2 = 0) AS o ON c.c_custkey = o.k""")
def upsert_partial(t: Tables) -> DataFrame:
    table = t.customer.where("c_custkey % 3 <> 0").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    new = t.customer.where("c_custkey % 2 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return normalize.upsert(table, new, ["c_custkey"], ["c_name"])


@query("attachment_backfill", "SELECT c_custkey, coalesce(n, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT n_nationkey, n_name AS n FROM nation WHERE n_nationkey % 2 = 0) ON n_nationkey = c_custkey")
def attachment_backfill(t: Tables) -> DataFrame:
    values = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("c_custkey"), F.col("n_name").alias("c_mktsegment"))
    return normalize.backfill(t.customer.select("c_custkey", "c_mktsegment"), values, ["c_custkey"], ["c_mktsegment"])


@query("manifest_latest", """SELECT kind, key, arg_max(status, version) AS status, arg_max(rows_out, version) FILTER (WHERE rows_out IS NOT NULL) AS rows_out, max(version) AS version FROM manifest GROUP BY kind, key""")
def manifest_latest(t: Tables) -> DataFrame:
    return normalize.manifest_latest(t.manifest)


@query("manifest_status_counts", "SELECT kind, status, count(*) AS n FROM (SELECT kind, key, arg_max(status, version) AS status FROM manifest GROUP BY kind, key) AS m GROUP BY kind, status")
def manifest_status_counts(t: Tables) -> DataFrame:
    return normalize.manifest_latest(t.manifest).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


@query("ledger_keys", "SELECT DISTINCT key FROM manifest WHERE kind = 'click' AND status IN ('done', 'pending')")
def ledger_keys(t: Tables) -> DataFrame:
    return t.manifest.where("kind = 'click' AND status IN ('done', 'pending')").select("key").distinct()


@query("pending_work", "SELECT CAST(c_custkey AS VARCHAR) AS user_id FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT key FROM manifest WHERE kind = 'click' AND status = 'done')")
def pending_work(t: Tables) -> DataFrame:
    return normalize.pending(t.customer.select(F.col("c_custkey").cast("string").alias("user_id")), t.manifest, "click", "user_id")


@query("work_cap", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 500")
def work_cap(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'O'").select("o_orderkey").orderBy("o_orderkey").limit(500)


@query("incremental_page_ingest", """
    SELECT CAST(floor(objectid / 200e0) * 200 AS BIGINT) AS src_offset, objectid, CASE WHEN objectid % 3 <> 0 THEN boring_id END AS lid, CASE WHEN floor(objectid / 200e0) % 3 = 1 THEN 'second' ELSE label END AS label, lon, lat
    FROM borings WHERE floor(objectid / 200e0) % 3 <> 2""")
def incremental_page_ingest(t: Tables) -> DataFrame:
    """Pages land twice: every third one with other labels, every third one empty."""
    home = shared_dir(t.spark, "ingest")
    pages = page_payloads(t)
    pages.write.parquet(f"{home}/landed")
    ingest_pages(t.spark, f"{home}/landed", f"{home}/table", f"{home}/checkpoint")
    turn = F.floor(F.col("src_offset") / 200) % 3
    again = page_payloads(t, label=F.lit("second")).where(turn == 1).unionByName(pages.where(turn == 2).withColumn("payload", F.lit('{"type": "FeatureCollection", "features": []}')))
    again.write.mode("append").parquet(f"{home}/landed")
    ingest_pages(t.spark, f"{home}/landed", f"{home}/table", f"{home}/checkpoint")
    rows = tables.read_buckets(t.spark, f"{home}/table", geojson.page_rows(geojson.parse_pages(pages), "borings").schema)
    return rows.select("src_offset", "objectid", "lid", "label", "lon", "lat")


@query("incremental_logs", """SELECT boring_id, CAST(printf('%.1f', top_depth) AS DOUBLE) AS top_depth, CAST(printf('%.1f', bottom_depth) AS DOUBLE) AS bottom_depth, 'SM' AS uscs_class, 9::DOUBLE AS spt_n
    FROM strata WHERE top_depth IS NOT NULL AND bottom_depth >= top_depth AND CAST(substr(boring_id, 2) AS INT) % 3 <> 0""")
def incremental_logs(t: Tables) -> DataFrame:
    """Logs of plain interval lines; those of every third boring land again without any."""
    home = shared_dir(t.spark, "logs")
    line = F.concat(F.format_string("%.1f - %.1f", "top_depth", "bottom_depth"), F.lit("  SS  3-4-5  12  SM"))
    logs = t.strata.where("top_depth IS NOT NULL AND bottom_depth >= top_depth").groupBy("boring_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))
    logs.write.parquet(f"{home}/landed")
    ingest_logs(t.spark, f"{home}/landed", f"{home}/table", f"{home}/checkpoint")
    logs.where(F.substring("boring_id", 2, 9).cast("int") % 3 == 0).withColumn("text", F.lit("no intervals here")).write.mode("append").parquet(f"{home}/landed")
    ingest_logs(t.spark, f"{home}/landed", f"{home}/table", f"{home}/checkpoint")
    found = tables.read_buckets(t.spark, f"{home}/table", parse_log_text(logs).schema)
    return found.select("boring_id", "top_depth", "bottom_depth", "uscs_class", F.col("spt_n").cast("double").alias("spt_n"))


@query("fallback_id", "SELECT objectid, CASE WHEN objectid % 3 <> 0 THEN boring_id ELSE 'OID-' || objectid END AS boring_id FROM borings")
def fallback_id(t: Tables) -> DataFrame:
    rows = geojson.page_rows(geojson.parse_pages(page_payloads(t)), "borings")
    return rows.select("objectid", normalize.fallback_id(F.col("lid"), F.col("objectid")).alias("boring_id"))


@query("page_number", "SELECT objectid, CASE WHEN objectid % 4 = 0 THEN CAST(objectid % 50 AS INT) END AS pdf_pg_num FROM soil_labels")
def page_number(t: Tables) -> DataFrame:
    """Page numbers of labels as they are landed: text, some of it no number."""
    k = F.col("objectid") % 4
    text = F.when(k == 0, (F.col("objectid") % 50).cast("string")).when(k == 1, "4-5").when(k == 2, "")
    return t.soil_labels.select("objectid", normalize.page_number(text).alias("pdf_pg_num"))
