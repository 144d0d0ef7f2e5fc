"""Log text and positioned boxes to depth intervals, as jobs over text and box tables.

Boxes: (boring_id, page, seq, page_w, page_h, x, y, text, conf); seq is the order in which they were emitted.
A page's boxes are one array (a page has a bounded number); a boring's or more are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake.functions import logs

PAGE = ["boring_id", "page"]
METRIC_FT = 3.280839895
#: A sample id's band reaches less than so far up and down.
BAND = 70
#: Boxes of a page that are passed by whole for a sample, as finding its band costs more.
SMALL = 64


def parse_log_text(texts: DataFrame) -> DataFrame:
    """Intervals of (boring_id, text): a row per line with a plausible depth pair and what else stands on it."""
    lines = texts.select("boring_id", F.posexplode(F.split("text", r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]")).alias("line_no", "line"))
    line = F.col("line")
    upto = Window.partitionBy("boring_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    seen = lines.withColumns({
        "gw_depth": F.last(logs.found(line, logs.WATER).cast("double"), ignorenulls=True).over(upto), "top_depth": logs.found(line, logs.DEPTH, 1).cast("double"), "bottom_depth": logs.found(line, logs.DEPTH, 2).cast("double"),
    }).where("bottom_depth >= top_depth AND bottom_depth - top_depth <= 100")
    blows = logs.found(line, logs.BLOWS, 2).cast("int") + logs.found(line, logs.BLOWS, 3).cast("int")
    seen = seen.withColumns({"uscs_class": logs.found(line, logs.USCS), "spt_n": F.coalesce(blows, logs.found(line, logs.N_VALUE).cast("int")), "sample_type": logs.found(line, logs.SAMPLE)})
    signals = sum((F.col(c).isNotNull().cast("int") for c in ("uscs_class", "spt_n", "sample_type")), F.lit(0))
    index = F.row_number().over(Window.partitionBy("boring_id").orderBy("line_no")) - 1
    return seen.select("boring_id", index.alias("interval_index"), "top_depth", "bottom_depth", "uscs_class", "spt_n", "sample_type", "gw_depth", F.round(F.least(F.lit(1.0), 0.3 + 0.2 * signals), 2).alias("confidence"))


def _lined() -> Column:
    """Aggregate of a page's boxes in reading order: 15-unit lines, then x."""
    return F.sort_array(F.collect_list(F.struct(F.bround(F.col("y") / 15).alias("r"), "x", "seq", "text")))


def _joined(pages: DataFrame) -> DataFrame:
    """``pages`` with their text in reading order and in emission order, for their boxes (``_lined``)."""
    pages = pages.withColumns({"seq": F.col("lined.seq"), "text": F.col("lined.text")}).withColumns({"flat": F.array_join("text", "\n"), "emitted": F.array_join(F.sort_array(F.arrays_zip("seq", "text"))["text"], " ")})
    return pages.drop("lined", "seq", "text")


def _with_family(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with the soil family of a text; a step each, so that nothing is read twice."""
    return rows.withColumn("up", F.upper(text)).withColumn("noun", logs.soil_noun(F.col("up"))).withColumn("family", logs.family_of(F.col("up"), F.col("noun"))).drop("up", "noun")


def page_text(boxes: DataFrame) -> DataFrame:
    """Per page its text in reading order and in emission order."""
    return _joined(boxes.groupBy(*PAGE).agg(_lined().alias("lined")))


def header_fields(pages: DataFrame) -> DataFrame:
    """``pages`` (page_text) with surface elevation, its units and groundwater depth."""
    flat = F.col("flat")
    return pages.withColumns({"surface_elevation": logs.found(flat, logs.ELEVATION).cast("double"), "elev_units": F.lower(logs.found(flat, logs.ELEVATION, 2)), "header_gw": logs.found(flat, logs.WATER).cast("double")})


def is_spoon(emitted: Column) -> Column:
    # one pattern, so that a filter on it joins a page's text once
    return F.upper(emitted).rlike("(?s)BLOWS ON SPOON|ON SPOON.*STRATIF|STRATIF.*ON SPOON")


def _ticked(boxes: DataFrame) -> DataFrame:
    """``boxes`` with the depth that a tick in the left margin shows, else null; its pattern is read once."""
    ticks = boxes.withColumn("tick", F.when(F.col("x") < 0.13 * F.col("page_w"), logs.found(F.trim("text"), logs.TICK).cast("int")))
    return ticks.withColumn("tick", F.when((F.col("tick") >= 0) & (F.col("tick") < 300), F.col("tick")))


def _axis() -> tuple[dict[str, Column], Column]:
    """Aggregates of a page's boxes (``_ticked``) that fit depth over y, and whether they make an axis."""
    v = F.col("tick")
    order = F.when(v.isNotNull(), F.struct(F.col("y"), v.alias("v")))
    fit = {"n": F.count(v), "a": F.regr_slope(v, F.col("y")), "b": F.regr_intercept(v, F.col("y")), "last": F.max(order)["v"], "first": F.min(order)["v"]}
    return fit, F.expr("n >= 3 AND last > first AND a > 0")


def depth_axis(boxes: DataFrame) -> DataFrame:
    """Per page slope and intercept of depth over y, from three or more increasing ticks in the left margin."""
    fit, good = _axis()
    return _ticked(boxes).groupBy(*PAGE).agg(*[c.alias(k) for k, c in fit.items()]).where(good).select(*PAGE, "a", "b")


def _between(low: float, high: float) -> Column:
    return (F.col("x") > low * F.col("page_w")) & (F.col("x") < high * F.col("page_w"))


def _named() -> Column:
    """A box of a descriptive page that names a soil, right of 0.42 of the width, else null."""
    worded = (F.col("x") > 0.42 * F.col("page_w")) & (F.length("text") > 8)
    return F.when(worded & F.upper("text").rlike(logs.SOIL), F.struct("y", "seq", "x", F.col("page_w").alias("w"), "text", "conf"))


def _anchor() -> Column:
    """A sample id of a split-spoon page, else null."""
    sid = F.trim("text")
    return F.when(_between(0.16, 0.24) & sid.rlike(logs.SAMPLE_ID), F.struct("y", "seq", "x", F.col("page_w").alias("w"), F.translate(sid, "-", "").alias("sid")))


def _banded() -> Column:
    """What a box tells the samples it lies beside (depths, blows or words, by its place), under the number of its band; null if nothing.

    Parts that a box has not are empty, so that a sample joins its boxes' parts as they are.
    """
    depth, blow, word, none = _between(0.24, 0.36), _between(0.37, 0.53), F.col("x") > 0.57 * F.col("page_w"), F.lit(None).cast("string")
    numbers = lambda here: F.when(here, F.col("numbers")).otherwise(F.array().cast("array<double>"))
    # several numbers of one box are equal in x: as in a sort by (x, value)
    parts = F.struct("x", "seq", F.sort_array(numbers(depth)).alias("v")).alias("depths"), F.struct("seq", "text", numbers(blow).alias("n")).alias("blows"), F.struct("x", "seq", F.when(word, F.col("text")).otherwise(none).alias("text")).alias("words")
    return F.when(depth | blow | word, F.struct(F.floor(F.col("y") / BAND).alias("band"), "y", *parts))


def layout(boxes: DataFrame) -> DataFrame:
    """Per page one row: text, head fields, the depth axis (a, b) if it has one, and its boxes by what they may be: ``named`` soils of
    descriptive pages, ``anchors`` and ``banded`` boxes of split-spoon pages.

    What a box says is read from it before boxes meet, by generated code; a page only sorts and joins.  Boxes, which are smaller than
    the lists that they are put in, are dealt by boring, so pages, and all pages of a boring, lie together: one shuffle.
    """
    fit, good = _axis()
    said = _ticked(boxes.repartition("boring_id")).withColumn("numbers", F.when(_between(0.24, 0.36) | _between(0.37, 0.53), logs.numbers_in(F.col("text")))).withColumns({"named": _named(), "anchors": _anchor(), "banded": _banded()})
    lists = {k: F.sort_array(F.collect_list(k)) for k in ("named", "anchors", "banded")} | {"lined": _lined()}
    pages = said.groupBy(*PAGE).agg(*[c.alias(k) for k, c in (fit | lists).items()])
    pages = _joined(pages.withColumns({"a": F.when(good, F.col("a")), "b": F.when(good, F.col("b"))}))
    return header_fields(pages.drop("n", "last", "first"))


def generic_rows(pages: DataFrame) -> DataFrame:
    """Intervals of descriptive pages (``layout``): boxes right of 0.42 of the width that name a soil, in order of y."""
    depth = lambda y: F.round(F.col("a") * y + F.col("b"), 2)
    below = pages.withColumn("after", F.slice("named", F.lit(2), F.size("named"))["y"])
    rows = below.select(*PAGE, "a", "b", "header_gw", "surface_elevation", F.posexplode(F.arrays_zip("named", "after")).alias("interval_index", "s"))
    box, text = F.col("s.named"), F.col("s.named.text")
    rows = _with_family(rows, text).withColumn("spt_n", logs.found(text, logs.BLOWS, 2).cast("int") + logs.found(text, logs.BLOWS, 3).cast("int"))
    return rows.select(
        *PAGE, "interval_index", depth(box["y"]).alias("top_depth"), depth(F.col("s.after")).alias("bottom_depth"), F.col("family").alias("uscs_class"), "spt_n",
        F.lit(None).cast("string").alias("sample_type"), F.col("header_gw").alias("gw_depth"), F.col("surface_elevation").alias("elevation"), F.round(F.least(F.lit(1.0), 0.4 * box["conf"] + 0.6 * logs.sureness(F.col("family"))), 2).alias("confidence"),
    )


def parse_generic(boxes: DataFrame) -> DataFrame:
    """Intervals of boxes of descriptive pages."""
    return generic_rows(layout(boxes))


def spoon_rows(pages: DataFrame) -> DataFrame:
    """Intervals of split-spoon pages (``layout``): a sample id anchors a band of boxes that hold depths, blows and description.

    Boxes are sorted by band, so those of an anchor's band and the two beside it are one slice, whose ends are looked up
    on pages of more than ``SMALL`` boxes.
    """
    flat = F.col("flat")
    to_ft = F.when(flat.rlike(r"\d\s*m\b") | flat.contains("NAVD 88"), METRIC_FT).otherwise(1.0)
    elevation = F.coalesce(F.translate(logs.found(flat, logs.GROUND), ",", ".").cast("double"), F.col("surface_elevation"))

    def end(bands: str, band: Column) -> Column:
        """First place of the three bands."""
        return F.least(*[F.nullif(F.array_position(bands, band + k), F.lit(0)) for k in (-1, 0, 1)])

    def beside(s: Column) -> Column:
        band = F.floor(s["y"] / BAND)
        first, past = end("bands", band), F.size("bands") + 2 - end("back", band)
        some = F.when(F.size("banded") > SMALL, F.slice("banded", first.cast("int"), (past - first).cast("int"))).otherwise(F.col("banded"))
        near = F.filter(some, lambda b: F.abs(b["y"] - s["y"]) < BAND)
        return F.struct(s["sid"].alias("sid"), near.alias("near"))

    pages = pages.select(*PAGE, to_ft.alias("to_ft"), elevation.alias("elevation"), "header_gw", "anchors", "banded", F.col("banded.band").alias("bands"), F.reverse("banded.band").alias("back"))
    rows = pages.select(*PAGE, "to_ft", "elevation", "header_gw", F.posexplode(F.transform("anchors", beside)).alias("interval_index", "s"))
    near = F.col("s.near")
    rows = rows.withColumns({
        "d": F.filter(F.flatten(F.sort_array(near["depths"])["v"]), lambda v: v < 100), "n": F.flatten(F.sort_array(near["blows"])["n"]), "words": F.array_join(F.sort_array(near["words"])["text"], " "),
    })
    rows = _with_family(rows, F.col("words")).withColumn("n", logs.whole(F.col("n"))).withColumns({"top_depth": F.round(F.get("d", F.lit(0)) * F.col("to_ft"), 2), "bottom_depth": F.round(F.get("d", F.lit(1)) * F.col("to_ft"), 2), "spt_n": logs.spt_of_whole(F.col("n"))})
    confidence = F.round(F.least(F.lit(1.0), 0.3 + 0.3 * F.col("top_depth").isNotNull().cast("int") + 0.4 * F.col("spt_n").isNotNull().cast("int")), 2)
    return rows.select(*PAGE, "interval_index", "top_depth", "bottom_depth", F.col("family").alias("uscs_class"), "spt_n", F.col("s.sid").alias("sample_type"), F.col("header_gw").alias("gw_depth"), "elevation", confidence.alias("confidence"))


def parse_spoon(boxes: DataFrame) -> DataFrame:
    """Intervals of boxes of split-spoon pages."""
    return spoon_rows(layout(boxes))


def parse_pages(boxes: DataFrame, max_pages: int = 4) -> DataFrame:
    """Per boring: if its first page is a spoon log all pages (up to ``max_pages``) as such, else page 1 as generic."""
    # generic logs need page 1 alone
    some = boxes.where(F.col("page") <= max_pages)
    boring = Window.partitionBy("boring_id")
    pages = layout(some).withColumn("spoon", F.max(F.when(F.col("page") == 1, is_spoon(F.col("emitted")))).over(boring))
    first = layout(some.where("page = 1"))
    rows = spoon_rows(pages.where("spoon")).unionByName(generic_rows(first.where(~is_spoon(F.col("emitted")))))
    index = F.row_number().over(boring.orderBy("page", "interval_index")) - 1
    return rows.withColumn("interval_index", index)


def parse_outcomes(borings: DataFrame, rows: DataFrame, with_text: DataFrame) -> DataFrame:
    """(boring_id, outcome): parsed if rows came out, pending if there was text but none did, else failed."""
    n = rows.groupBy("boring_id").agg(F.count(F.lit(1)).alias("n"))
    have = with_text.select("boring_id").distinct().withColumn("text", F.lit(True))
    joined = borings.select("boring_id").join(n, "boring_id", "left").join(have, "boring_id", "left")
    return joined.select("boring_id", F.when(F.col("n") > 0, "parsed").when(F.col("text"), "pending").otherwise("failed").alias("outcome"))
