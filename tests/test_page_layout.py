"""Page queries: code that the JVM compiles, one pass over what a box says, bands of large pages."""

import random
import re

import pytest

from stratalake.operators import logs
from stratalake.plans import soils
from stratalake.plans.fixtures import Tables
from test_hops_and_bands import BOXES, _page, _plain_spoon


@pytest.mark.parametrize("query", [soils.boxes_spoon, soils.boxes_generic, soils.ocr_page_policy])
def test_methods_are_small_enough_to_be_compiled(spark, query, capsys):
    """The JVM never compiles methods of more than 8,000 bytes; boxes of a page are read by such code."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        query(Tables(spark, "/root/testdata/sf0.001")).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


@pytest.mark.parametrize("query", [soils.boxes_spoon, soils.boxes_generic])
def test_a_box_is_read_without_functions_a_box(spark, query):
    plan = query(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort(" not in plan and plan.count("BLOWS ON SPOON") == 1


def test_bands_of_large_pages_equal_those_of_small_ones(spark, monkeypatch):
    rng = random.Random(3)
    pages = {f"B{i}": [r[:7] + (r[7].replace("12.5", "12"),) + r[8:] for r in _page(rng, f"B{i}")] for i in range(4)}
    boxes = spark.createDataFrame([r for rows in pages.values() for r in rows], BOXES)
    monkeypatch.setattr(logs, "SMALL", 0)
    got = logs.parse_spoon(boxes).sort("boring_id", "interval_index").collect()
    for boring, rows in pages.items():
        assert [(r["sample_type"], r["top_depth"], r["bottom_depth"], r["spt_n"]) for r in got if r["boring_id"] == boring] == _plain_spoon(rows)


@pytest.mark.parametrize("text,spoon", [("blows on spoon", True), ("STRATIF x\ny on Spoon", True), ("on spoon, stratified", True), ("on spoon", False), ("", False)])
def test_spoon_heads(spark, text, spoon):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "t string").select(logs.is_spoon(F.col("t")).alias("s")).first()["s"] is spoon
