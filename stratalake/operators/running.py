"""Running sums over a whole table in some order, without a task that holds all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake.storage import stored


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the sums of whole numbers over all rows up to each, in the given order.

    Rows are dealt by ranges of the order, so no task has more than its range; the ranges' totals are summed once more.
    """
    ranged = stored(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("range").agg(*[F.sum(c).alias(f"{name}_all") for name, c in sums.items()])
    earlier, inside = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # one row of each partition of a shuffle
    before = totals.select("range", *[F.coalesce(F.sum(f"{name}_all").over(earlier), F.lit(0)).alias(f"{name}_all") for name in sums])
    met = ranged.join(F.broadcast(before), "range").withColumns({name: (F.col(f"{name}_all") + F.sum(c).over(inside)).cast("long") for name, c in sums.items()})
    return met.drop("range", *[f"{name}_all" for name in sums])
