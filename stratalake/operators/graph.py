"""Spatial graphs: edge sets, their union and comparison, neighbour features, reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalake.functions.geo import edge_weight
from stratalake.operators.delaunay import delaunay_edges
from stratalake.operators.knn import knn
from stratalake.storage import bucketed, partitions_for, shuffle_partitions, stored

RADIUS_FT = 2000 * 3.280839895
EDGE = ["src", "dst", "edge_type"]
#: Nodes in a bucket of the graph that hops go over; some 25 times as many ways leave them.
BUCKET_NODES = 1 << 15


def undirected(pairs: DataFrame, edge_type: str) -> DataFrame:
    """(src, dst, edge_type, weight) with src < dst, once each, from (qid, id, weight)."""
    ends = pairs.select(F.least("qid", "id").alias("src"), F.greatest("qid", "id").alias("dst"), "weight").where("src <> dst")
    return ends.groupBy("src", "dst").agg(F.max("weight").alias("weight")).select("src", "dst", F.lit(edge_type).alias("edge_type"), "weight")


def _nearest_edges(near: DataFrame, k: int) -> DataFrame:
    return undirected(near.where(F.col("rank") <= k).select("qid", "id", edge_weight(F.col("d")).alias("weight")), "knn")


def _unit_edges(near: DataFrame, k: int, radius: float) -> DataFrame:
    close = near.where((F.col("rank") < k) & (F.col("d") <= radius) & F.col("alike"))
    return undirected(close.select("qid", "id", F.lit(1.0).alias("weight")), "same_geology")


def knn_edges(points: DataFrame, k: int = 8) -> DataFrame:
    """Edges of points (id, x, y) to their k nearest."""
    return _nearest_edges(knn(points, points, k, same=True), k)


def same_unit_edges(points: DataFrame, k: int = 26, radius: float = RADIUS_FT) -> DataFrame:
    """Edges of weight 1 among the k nearest, the point itself counted, within the radius and of one non-empty unit.

    ``points``: (id, x, y, unit).  The cap counts before the unit is looked at.
    """
    return _unit_edges(knn(points, points, k - 1, same=True, alike="unit"), k, radius)


def label_edges(labels: DataFrame, borings: DataFrame, k: int = 6) -> DataFrame:
    """Edges from each label to its k nearest borings."""
    return knn(labels, borings, k).select(F.col("qid").alias("src"), F.col("id").alias("dst"), F.lit("label_boring").alias("edge_type"), edge_weight(F.col("d")).alias("weight"))


def boring_graph(points: DataFrame, k: int = 8, delaunay: bool = True, unit_k: int = 26, radius: float = RADIUS_FT, few_points: bool = True) -> DataFrame:
    """Union of kNN, Delaunay and same-unit edges of (id, x, y, unit); one search serves the first and the last.

    Not ``few_points``: up to k + 1 points make no graph at all.
    """
    if not few_points:
        enough = points.where("x IS NOT NULL AND y IS NOT NULL").limit(k + 2).count() > k + 1
        points = points.where(F.lit(enough))
    near = knn(points, points, max(k, unit_k - 1), same=True, alike="unit", few=k)
    edges = _nearest_edges(near, k).unionByName(_unit_edges(near, unit_k, radius))
    if delaunay:
        edges = edges.unionByName(delaunay_edges(points.select("id", "x", "y")).withColumn("edge_type", F.lit("delaunay")))
    return edges


def edge_subset(edges: DataFrame, types: list[str]) -> DataFrame:
    """Edges of some types, as ablations use them."""
    return edges.where(F.col("edge_type").isin(types))


def union_graph(borings: DataFrame, labels: DataFrame, k: int = 8, cross_k: int = 6, delaunay: bool = True) -> DataFrame:
    """Graph over ids ``b:`` and ``l:`` of borings and labels (id, x, y, unit), with the types of both ends."""
    def named(rows: DataFrame, prefix: str) -> DataFrame:
        return rows.withColumn("id", F.concat(F.lit(prefix), F.col("id").cast("string")))

    b, lab = named(borings, "b:"), named(labels, "l:")
    edges = _union(b.unionByName(lab), b, lab, k, cross_k, delaunay)
    kind = lambda c: F.when(F.col(c).startswith("b:"), "boring").otherwise("label")
    return edges.withColumns({"src_type": kind("src"), "dst_type": kind("dst")})


def _union(points: DataFrame, borings: DataFrame, labels: DataFrame, k: int, cross_k: int, delaunay: bool) -> DataFrame:
    return boring_graph(points, k, delaunay).unionByName(label_edges(labels, borings, cross_k))


def numbers_of(ids: DataFrame) -> DataFrame:
    """(id, node): a long for each different id, which sorts as the id does, so ties come out the same."""
    ids = ids.select("id").distinct().repartitionByRange(shuffle_partitions(ids), "id").sortWithinPartitions("id")
    return stored(ids.withColumn("node", F.monotonically_increasing_id()), "numbers")


def union_context(nodes: DataFrame, columns: list[str], k: int = 8, cross_k: int = 6, hops: int = 3) -> DataFrame:
    """``graph_context`` over the union graph of nodes (id ``b:`` or ``l:``, x, y, unit, columns); edges and hops are of numbers instead of ids."""
    numbers = numbers_of(nodes)
    own = stored(nodes.withColumn("boring", F.col("id").like("b:%")).join(numbers, "id").drop("id").withColumnRenamed("node", "id"), "numbered")
    point = ["id", "x", "y", "unit"]
    edges = _union(own.select(point), own.where("boring").select(point), own.where("NOT boring").select(point), k, cross_k, True)
    context = graph_context(edges, own, columns, hops)
    return numbers.join(context.withColumnRenamed("id", "node"), "node").drop("node")


def directed(edges: DataFrame) -> DataFrame:
    """Both directions of each edge."""
    swapped = {"src": "dst", "dst": "src"}
    return edges.unionByName(edges.select(*[F.col(swapped.get(c, c)).alias(c) for c in edges.columns]))


def neighbor_mean(edges: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """Per node and edge type the mean of its neighbours' columns; nodes without such edges have none (degree floor 1)."""
    sent = directed(edges.select(*EDGE)).join(features.select(F.col("id").alias("src"), *columns), "src")
    return sent.groupBy(F.col("dst").alias("id"), "edge_type").agg(*[F.avg(c).alias(c) for c in columns])


def ways_of(edges: DataFrame) -> DataFrame:
    """Both directions of edges, stored by the bucket of the node they leave: hops over them move nodes only.  The edges are computed once."""
    ends = [F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in (("src", "dst"), ("dst", "src"))]
    both = edges.select(F.explode(F.array(*ends)).alias("way"), "edge_type").select("way.src", "way.dst", "edge_type")
    # ways of one node beside each other: what they send is alike and packs well
    return bucketed(both.repartition(shuffle_partitions(both), "src").sortWithinPartitions("src"), "ways", "src")


def _sent(ways: DataFrame, now: DataFrame, *columns) -> DataFrame:
    """What nodes send along ways, by the node that receives it.

    A bucket's nodes are few beside its ways, so they are the side to hash.  Rows are shuffled as they are: sums per task would be of a way or two each, and wider.
    """
    return ways.join(now.withColumnRenamed("id", "src").hint("shuffle_hash"), "src").select(F.col("dst").alias("id"), *columns).repartition(shuffle_partitions(ways), "id")


def _received(ways: DataFrame, now: DataFrame, columns: list[str], relations: list[str | None]) -> DataFrame:
    """Per node the mean over relations of the mean of what its neighbours send."""
    number = F.coalesce(*[F.when(F.col("edge_type").eqNullSafe(F.lit(kind)), F.lit(r)) for r, kind in enumerate(relations)], F.lit(-1)).alias("relation")
    means = {(r, c): F.avg(F.when(F.col("relation") == r, F.col(c))) for r in range(len(relations)) for c in columns}
    met = _sent(ways, now, number, *columns).groupBy("id").agg(*[m.alias(f"{c}_of_{r}") for (r, c), m in means.items()])
    mean = lambda c: sum((F.coalesce(F.col(f"{c}_of_{r}"), F.lit(0.0)) for r in range(len(relations))), F.lit(0.0))
    known = lambda c: sum((F.col(f"{c}_of_{r}").isNotNull().cast("int") for r in range(len(relations))), F.lit(0))
    return met.select("id", *[F.try_divide(mean(c), known(c)).alias(c) for c in columns])


def graph_context(edges: DataFrame, features: DataFrame, columns: list[str], hops: int = 3, most_relations: int = 64) -> DataFrame:
    """Own columns and, per hop, the mean over relations of the neighbour means: id, c, c_1, c_2, ...

    Edges and nodes are stored once by bucket, in as many buckets as the nodes need.  A hop joins them where they lie, shuffles what is
    sent by the node that receives it, and stores the nodes for the next: one shuffle a hop.  Of more than ``most_relations``
    kinds of edges, means are grouped in two steps instead.
    """
    own = features.select("id", *columns)
    with partitions_for(own.sparkSession, own.count(), BUCKET_NODES):
        ways = ways_of(edges.select(*EDGE))
        relations = [r[0] for r in ways.select("edge_type").distinct().sort("edge_type").limit(most_relations + 1).collect()]
        out = now = nodes = bucketed(own.repartition(shuffle_partitions(own), "id"), "nodes", "id")
        for hop in range(1, hops + 1):
            if len(relations) <= most_relations:
                met = _received(ways, now, columns, relations)
            else:
                sent = _sent(ways, now, "edge_type", *columns).groupBy("id", "edge_type").agg(*[F.avg(c).alias(c) for c in columns])
                met = sent.groupBy("id").agg(*[F.avg(c).alias(c) for c in columns])
            met = nodes.select("id").join(met.hint("shuffle_hash"), "id", "left")
            now = bucketed(met.select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns]), f"hop-{hop}", "id")
            out = out.join(now.withColumnsRenamed({c: f"{c}_{hop}" for c in columns}), "id")
    return out


def reachability(edges: DataFrame, hops: int = 3) -> DataFrame:
    """One row: labels with edges, those of them that reach a boring within ``hops``, and their share.

    A node beside a boring is known from its edges alone.  Any other node has none but such neighbours that are no borings, so a hop looks only at
    the edges of nodes not yet reached for neighbours that the last hop reached; without such nodes there is no further hop.
    """
    ends = stored(edges.select("src", "dst"), "ends")
    ways = directed(ends).where("src NOT LIKE 'b:%'")
    nodes = stored(ways.groupBy(F.col("src").alias("id")).agg((F.max(F.col("dst").like("b:%")) & F.lit(hops > 0)).alias("near")), "nodes")
    total = nodes.agg(F.count_if(F.col("id").like("l:%")).alias("labels"), F.count_if(~F.col("near")).alias("far"))
    late = []
    if hops > 1 and total.first()["far"]:
        far = nodes.where("NOT near").select("id")
        last = nodes.where("near").select("id")
        ways = bucketed(ways.join(far.withColumnRenamed("id", "src"), "src", "left_semi").repartition(shuffle_partitions(ends), "dst"), "ways", "dst")
        for _ in range(hops - 1):
            met = ways.join(last.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
            for earlier in late:
                met = met.join(earlier, "id", "left_anti")
            last = bucketed(met, "frontier", "id")
            late.append(last)
    hit = nodes.where("near").select("id")
    for found in late:
        hit = hit.unionByName(found)
    labels, reached = total.select("labels"), hit.where("id LIKE 'l:%'").agg(F.count(F.lit(1)).alias("reached"))
    return labels.crossJoin(reached).select("labels", "reached", F.round(F.try_divide("reached", "labels"), 6).alias("share"))


def edge_set_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per edge type: only in one, only in the other, in both, share that differs, and the largest weight gap."""
    a = left.select(*EDGE, F.col("weight").alias("wa"))
    both = a.join(right.select(*EDGE, F.col("weight").alias("wb")), EDGE, "full")
    only_left, only_right = F.count_if(F.col("wb").isNull()), F.count_if(F.col("wa").isNull())
    return both.groupBy("edge_type").agg(
        only_left.alias("only_left"), only_right.alias("only_right"), F.count_if(F.col("wa").isNotNull() & F.col("wb").isNotNull()).alias("shared"),
        F.round((only_left + only_right) / F.count(F.lit(1)), 6).alias("diff_share"), F.round(F.max(F.abs(F.col("wa") - F.col("wb"))), 6).alias("max_weight_gap"),
    )


def top_k(rows: DataFrame, keys: list[str], *order, k: int) -> DataFrame:
    """First k rows of each group in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
