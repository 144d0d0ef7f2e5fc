"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm._shared import forget, stored

_ROWS = 20_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b), both long; root is the smallest node of its component.

    Each step moves edges towards smaller nodes and is written to the shared folder, so lineage stays short.
    """
    def parted(rows: DataFrame, count: int) -> DataFrame:
        return rows.coalesce(2 + count // _ROWS)  # few rows need no more files than that

    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before, count = None, edges.count()
    while count:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        done, edges = edges, stored(parted(small.select("e.a", "e.b").where("a <> b").distinct(), count), "edges")
        forget(done)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before, count = now, now[0]
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
