import random

from pyspark.sql import functions as F

from stratalake.operators.running import running


def test_running_sums_over_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None, "c"]), i, rng.randrange(100)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    got = running(df, [F.col("k").asc_nulls_last(), F.col("i")], {"place": F.lit(1), "total": F.col("v")}).collect()
    total = 0
    expected = {}
    for n, (_, i, v) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1])), 1):
        total += v
        expected[i] = (n, total)
    assert {r.i: (r.place, r.total) for r in got} == expected


def test_of_nothing(spark):
    assert running(spark.createDataFrame([], "k string, v int"), [F.col("k")], {"total": F.col("v")}).collect() == []
