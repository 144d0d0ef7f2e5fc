"""From staging rows to normalised tables: ids, quality flags, newest rows, upserts, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake.functions.geo import project

#: Fixed bounds of valid coordinates, and how far a stored position may be off.
BBOX = (-75.7, 38.8, -73.8, 41.4)
TOLERANCE_FT = 50.0
#: Fixed tokens of field names.
STRATA_TOKENS = ("spt", "nval", "n_value", "blow", "uscs", "aashto", "strat", "depth", "groundwater", "gwt", "gw_", "sample", "elev", "horizon")
DOC_TOKENS = ("url", "weburl", "link", "doc", "pdf", "hyperlink", "image", "scan", "filename")
PLACE_TOKENS = ("point_x", "point_y", "shape__", "shape_", "longitude", "latitude")


def fallback_id(lid: Column, objectid: Column) -> Column:
    return F.coalesce(lid, F.concat(F.lit("OID-"), objectid.cast("string")))


def page_number(text: Column) -> Column:
    """A page number kept as text; null where it is no number."""
    return F.nullif(text, F.lit("")).try_cast("int")


def coord_quality(rows: DataFrame, bbox: tuple[float, float, float, float] = BBOX, tolerance: float = TOLERANCE_FT) -> DataFrame:
    """``rows`` (lon, lat, point_x, point_y) with coord_quality_flag; the first that holds."""
    x, y = project("lon", "lat")
    out = ~(F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3]))
    off = F.col("point_x").isNotNull() & ((F.abs(x - F.col("point_x")) > tolerance) | (F.abs(y - F.col("point_y")) > tolerance))
    flag = F.when(F.col("lon").isNull() | F.col("lat").isNull(), "no_geom").when(out, "out_of_nj_bbox").when(off, "xy_geom_mismatch").otherwise("ok")
    return rows.withColumn("coord_quality_flag", flag)


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(table: DataFrame, new: DataFrame, key: list[str], update: list[str]) -> DataFrame:
    """``table`` with ``new``'s rows: on a match only the columns of ``update`` change, all others survive."""
    there, here = F.col("_there"), F.col("_here")
    renamed = new.withColumnsRenamed({c: f"_new_{c}" for c in new.columns if c not in key}).withColumn("_here", F.lit(True))
    both = table.withColumn("_there", F.lit(True)).join(renamed, key, "full")

    def pick(c: str) -> Column:
        if c in key or c not in new.columns:
            return F.col(c)
        if c in update:
            return F.when(here, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        return F.when(there, F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c)

    return both.select(*[pick(c) for c in table.columns])


def backfill(table: DataFrame, values: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``table`` with columns taken from ``values`` where it has the key."""
    there = values.select(*key, *[F.col(c).alias(f"_v_{c}") for c in columns])
    return table.join(there, key, "left").select(*[F.coalesce(f"_v_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def pending(work: DataFrame, ledger: DataFrame, kind: str, key: str) -> DataFrame:
    """Work whose key the ledger does not have as done."""
    done = ledger.where((F.col("kind") == kind) & (F.col("status") == "done")).select(F.col("key").alias(key)).distinct()
    return work.join(done, key, "left_anti")


def manifest_latest(updates: DataFrame) -> DataFrame:
    """Ledger state after all updates: the newest status, and the newest rows_out that was given."""
    newest = F.max_by("status", "version").alias("status")
    return updates.groupBy("kind", "key").agg(newest, F.max_by("rows_out", F.when(F.col("rows_out").isNotNull(), F.col("version"))).alias("rows_out"), F.max("version").alias("version"))


def _holds(name: Column, tokens: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for token in tokens:
        found = found | name.contains(token)
    return found


def classify_fields(fields: DataFrame) -> DataFrame:
    """``fields`` (layer, name, type) with class: by type first, then by the tokens of its name."""
    name = F.lower("name")
    spatial = F.col("type").isin("esriFieldTypeOID", "esriFieldTypeGeometry") | _holds(name, PLACE_TOKENS)
    return fields.withColumn("class", F.when(spatial, "spatial").when(_holds(name, DOC_TOKENS), "doclink").otherwise("attribute"))


def strata_verdict(fields: DataFrame) -> DataFrame:
    """Per layer whether a field (no coordinate) speaks of strata."""
    name = F.lower("name")
    hit = _holds(name, STRATA_TOKENS) & ~_holds(name, ("point_x", "point_y", "shape"))
    return fields.groupBy("layer").agg(F.bool_or(hit).alias("has_strata_field"))


def count_drift(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """Counts (layer, n) beside what was expected; no expectation matches anything."""
    return counts.join(expected, "layer", "left").withColumn("matches", F.col("expected").isNull() | (F.col("n") == F.col("expected")))


def sanity_gate(samples: DataFrame, depth: tuple[float, float] = (0.0, 200.0), blows: tuple[int, int] = (0, 100)) -> DataFrame:
    """Samples with a top depth in range; blow counts out of range become null.  Gates look at the top depth."""
    return samples.where(F.col("top_depth").between(*depth)).withColumn("spt_n", F.when(F.col("spt_n").between(*blows), F.col("spt_n")))


def gate_counts(samples: DataFrame, depth: tuple[float, float] = (0.0, 200.0)) -> DataFrame:
    """One row: kept and dropped by the depth gate."""
    ok = F.coalesce(F.col("top_depth").between(*depth), F.lit(False))
    return samples.agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


#: Fixed names: inputs that do not follow from the blow count, and columns that do.
SAFE_COLUMNS = ("sigma_eff_v0_tsf", "sigma_v0_tsf", "gamma_pcf", "cn")
LEAKY_COLUMNS = ("n60", "n1_60", "phi_peck_deg", "phi_hatanaka_deg", "dr_pct", "su_tsf", "e_modulus_tsf", "m_constrained_tsf", "allow_bearing_tsf", "n1_60cs", "crr")


def guard_features(columns: list[str]) -> list[str]:
    """The columns, if none of them follows from the target."""
    leaky = sorted(set(columns) & set(LEAKY_COLUMNS))
    if leaky:
        raise ValueError(f"columns that follow from the blow count are no inputs: {leaky}")
    return columns
