"""Landed GeoJSON pages and other JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.sources.split_json import feature_texts
from stratalake.sources.tables import refresh

_FEATURES = "features array<struct<properties: map<string,string>, geometry: string>>"
PAGE = f"struct<{_FEATURES.replace('features', 'features:', 1)}>"
_POINT = "struct<type: string, coordinates: array<double>>"
_RINGS = "array<array<array<double>>>"
#: Typed columns of the three layers: column -> (property, type).
LAYERS = {
    "borings": {"objectid": ("OBJECTID", "bigint"), "lid": ("LID", "string"), "label": ("LABEL", "string"), "filename": ("FILENAME", "string"), "pid": ("PID", "string"), "bcontr": ("BCONTR", "string"), "srce": ("SRCE", "int"),
                "localn": ("LOCALN", "string"), "oversize": ("OVERSIZE", "string"), "point_x": ("POINT_X", "double"), "point_y": ("POINT_Y", "double"), "createdate": ("CREATEDATE", "string"), "changedate": ("CHANGEDATE", "string"), "matchid": ("MATCHID", "string")},
    "boring_plan": {"objectid": ("OBJECTID", "bigint"), "pid": ("PID", "string"), "filename": ("FILENAME", "string"), "route": ("ROUTE", "string"), "sect": ("SECT", "string"), "pcontr": ("PCONTR", "string"), "pdate": ("PDATE", "string"), "upc": ("UPC", "string"), "matchid": ("MATCHID", "string")},
    "soil_label": {"objectid": ("OBJECTID", "bigint"), "label_type": ("LABEL_TYPE", "string"), "primary_label": ("PRIMARY_LABEL", "string"), "secondary_label": ("SECONDARY_LABEL", "string"), "drainage": ("DRAINAGE", "string"), "pdf_pg_num": ("PDF_PG_NUM", "string"), "url": ("URL", "string"), "weburl": ("WEBURL", "string")},
}


def coerce(value: Column, kind: str) -> Column:
    """A property as ``kind``; empty and malformed values are null."""
    value = F.nullif(value, F.lit(""))
    return value if kind == "string" else value.try_cast(kind)


def property_ci(properties: Column, name: str) -> Column:
    """A property by name whatever its case; of several the first."""
    return F.get(F.filter(F.map_entries(properties), lambda e: F.lower(e["key"]) == name.lower()), F.lit(0))["value"]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(src_offset, page) of a folder of page files named by their offset."""
    pages = spark.read.schema(_FEATURES).json(path, multiLine=True)
    offset = F.regexp_extract(F.input_file_name(), r"(\d+)\.[A-Za-z]+$", 1)
    return pages.select(offset.try_cast("bigint").alias("src_offset"), F.struct("features").alias("page"))


def parse_pages(pages: DataFrame) -> DataFrame:
    """(src_offset, page) from (src_offset, payload text)."""
    return pages.select("src_offset", F.from_json("payload", PAGE).alias("page"))


def page_rows(pages: DataFrame, layer: str) -> DataFrame:
    """Typed rows of a layer: one per feature, with src_offset, geometry text and, for points, lon and lat."""
    rows = pages.select("src_offset", F.explode("page.features").alias("f"))
    point = F.from_json(F.col("f.geometry"), _POINT)
    columns = [coerce(F.col("f.properties")[prop], kind).alias(c) for c, (prop, kind) in LAYERS[layer].items()]
    lon, lat = (F.when(point["type"] == "Point", F.get(point["coordinates"], F.lit(i))).alias(c) for i, c in enumerate(("lon", "lat")))
    return rows.select("src_offset", *columns, F.col("f.geometry").alias("geometry"), lon, lat)


def geometry_polygon(geometry: Column) -> Column:
    """array<array<struct<x, y>>> of a GeoJSON Polygon, or of all rings of a MultiPolygon; else null."""
    kind = F.get_json_object(geometry, "$.type")
    raw = F.get_json_object(geometry, "$.coordinates")
    rings = F.when(kind == "Polygon", F.from_json(raw, _RINGS)).when(kind == "MultiPolygon", F.flatten(F.from_json(raw, f"array<{_RINGS}>")))
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(properties, geometry text) of the features of whole files, which are read by byte ranges.

    A feature is an element of the file's array that has its type, properties or a geometry.
    """
    one = F.from_json("text", "struct<type: string, properties: map<string,string>, geometry: string>")
    rows = feature_texts(spark, path).select(one.alias("f")).select("f.*")
    return rows.where("type = 'Feature' OR properties IS NOT NULL OR geometry IS NOT NULL").select("properties", "geometry")


def load_whole(spark: SparkSession, path: str) -> DataFrame:
    """Features of whole files: properties and rings."""
    return read_features(spark, path).select("properties", geometry_polygon(F.col("geometry")).alias("rings"))


def refresh_layer(spark: SparkSession, path: str, table: str, expected: int | None = None) -> bool:
    """Replace ``table`` by the features of the files at ``path``; whether their number is as expected."""
    return refresh(load_whole(spark, path), table, expected)


def header_table(payloads: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Typed rows of (payload) texts ``{"Table": [[names], [values], ...]}``; columns are found by their header name."""
    rows = payloads.select(F.from_json("payload", "struct<Table: array<array<string>>>")["Table"].alias("t"))
    body = rows.select(F.get("t", F.lit(0)).alias("names"), F.posexplode("t").alias("pos", "row")).where("pos > 0")
    return body.select(*[coerce(F.get("row", (F.array_position("names", c) - 1).cast("int")), kind).alias(c) for c, kind in columns.items()])


def pick_attachments(payloads: DataFrame, base_url: str) -> DataFrame:
    """Per parent its first PDF, else its first file, with its address; parents without files have no row."""
    kind = "struct<attachmentGroups: array<struct<parentObjectId: bigint, attachmentInfos: array<struct<id: bigint, name: string, contentType: string, size: bigint>>>>>"
    groups = payloads.select(F.explode(F.from_json("payload", kind)["attachmentGroups"]).alias("g"))
    infos = F.col("g.attachmentInfos")
    chosen = groups.select(F.col("g.parentObjectId").alias("objectid"), F.coalesce(F.get(F.filter(infos, lambda i: i["contentType"] == "application/pdf"), F.lit(0)), F.get(infos, F.lit(0))).alias("a")).where("a IS NOT NULL")
    url = F.concat(F.lit(base_url + "/"), F.col("objectid").cast("string"), F.lit("/attachments/"), F.col("a.id").cast("string"))
    return chosen.select("objectid", F.col("a.id").alias("attachment_id"), F.col("a.name").alias("name"), F.col("a.contentType").alias("content_type"), url.alias("log_url"))


def feature_rows(rows: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(feature): GeoJSON text of each row that has a position; the other columns are its properties."""
    rest = [c for c in rows.columns if c not in (lon, lat)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return rows.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*rest).alias("properties"))).alias("feature"))


def write_features(rows: DataFrame, path: str) -> None:
    """GeoJSON lines."""
    feature_rows(rows).write.mode("overwrite").text(path)
