"""A quadtree over the rows of a table, built by counting, and pairs of near leaves found by descending it twice at once.

Each pass counts the rows of the open nodes; a node that is too full is cut below the smallest cell that holds all of its rows, so
empty levels above a dense spot cost no pass.  A node of ``BULK`` rows or fewer needs no more passes: one task cuts it into leaves, which
hold at most ``cap`` rows of either side.  What is left when coordinates can be told apart no more is a leaf of any size; callers deal
such leaves into parts.

Pairs of nodes start at the root.  A pass replaces both nodes of a pair by their children, bounds from above how far the
``need`` nearest rows of each query node can be, and drops pairs that lie farther apart.  Tables of nodes and pairs grow with
rows / cap, and no pass reads the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import LongType, StructField, StructType

from stratalake.storage import forget, stored

DEPTH = 29
FIRST = 3
BULK = 1 << 14
_BOX = ("x0", "x1", "y0", "y1")


@dataclass
class Tree:
    """``rows`` with the leaf of each and its home, the node that was cut into it; the nodes of each pass with boxes and counts of both sides."""

    rows: DataFrame
    steps: list[DataFrame]


def _node(level: Column, ix: Column, iy: Column) -> Column:
    """A cell's number: its level and place on the level."""
    down = F.lit(DEPTH) - level
    shift = lambda c: F.call_function("shiftright", c, down.cast("int"))
    return F.shiftleft(level.cast("long"), 2 * DEPTH) + F.shiftleft(shift(ix), DEPTH) + shift(iy)


def _leaves(cap: int):
    """Rows of a node with the number of the leaf that each falls into."""

    def run(table: pa.Table) -> pa.Table:
        ix, iy, ask = (table[c].to_numpy() for c in ("ix", "iy", "ask"))
        leaf = np.zeros(len(ix), np.int64)
        open_ = [np.arange(len(ix))]
        while open_:
            rows = open_.pop()
            x, y = ix[rows], iy[rows]
            spread = int((x.min() ^ x.max()) | (y.min() ^ y.max()))
            level = DEPTH - spread.bit_length()  # of the smallest cell that holds the rows
            asking = int(ask[rows].sum())
            if max(asking, len(rows) - asking) <= cap or not spread:
                leaf[rows] = (level << 2 * DEPTH) + (int(x[0]) >> (DEPTH - level) << DEPTH) + (int(y[0]) >> (DEPTH - level))
                continue
            down = DEPTH - level - 1
            quarter = (x >> down & 1) * 2 + (y >> down & 1)
            open_ += [rows[quarter == k] for k in np.unique(quarter)]
        keep = [n for n in table.column_names if n not in ("ix", "iy")]
        return table.select(keep).append_column("leaf", pa.array(leaf))

    return run


def _counted(rows: DataFrame, *more: Column) -> DataFrame:
    """Nodes of ``rows`` (parent, node, ask, x, y) with counts and boxes of both sides."""
    sides = {"q": F.col("ask"), "p": ~F.col("ask")}
    boxes = [f(F.when(mine, F.col(c))).alias(f"{s}{c}{k}") for s, mine in sides.items() for c in ("x", "y") for k, f in ((0, F.min), (1, F.max))]
    return rows.groupBy("parent", "node").agg(*[F.count_if(mine).alias(f"n{s}") for s, mine in sides.items()], *boxes, *more)


def build(rows: DataFrame, cap: int) -> Tree | None:
    """The tree of ``rows`` (ask, x, y, ...): asking rows and the others are counted apart.  None without rows."""
    rows = stored(rows.where("x IS NOT NULL AND y IS NOT NULL"), "tree-rows")
    box = rows.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    if not box[4]:
        return None
    side = max(box[1] - box[0], box[3] - box[2], 1e-300) / (1 << DEPTH)
    top = (1 << DEPTH) - 1
    place = lambda c, low: F.least(F.floor((F.col(c) - F.lit(low)) / F.lit(side)), F.lit(top)).cast("long")
    first = min(FIRST, (-(-box[4] // BULK) - 1).bit_length() + 1 >> 1)
    cells = rows.withColumns({"ix": place("x", box[0]), "iy": place("y", box[2])})
    open_ = cells.withColumns({"parent": F.lit(-1).cast("long"), "node": _node(F.lit(first), F.col("ix"), F.col("iy"))})
    columns, bulks, steps = rows.columns, [], []
    while True:
        spread = F.expr("(min(ix) ^ max(ix)) | (min(iy) ^ max(iy))").alias("spread")
        # rows of the node differ in so many low bits of their cells; a cut two levels below makes up to sixteen children, one level below four
        cut = F.least(F.lit(DEPTH), F.lit(DEPTH + 1) + (F.col("nq") + F.col("np") > 4 * BULK).cast("int") - F.length(F.bin("spread")))
        nodes = stored(_counted(open_, spread).withColumn("cut", F.when((F.col("nq") + F.col("np") > BULK) & (F.col("spread") > 0), cut)).drop("spread"), "tree-nodes")
        steps.append(nodes)
        if not nodes.where("cut IS NOT NULL").limit(1).count():
            bulks.append(open_.select(*columns, "ix", "iy", "node"))
            break
        met = open_.join(nodes.select("node", "cut"), "node")
        bulks.append(met.where("cut IS NULL").select(*columns, "ix", "iy", "node"))
        open_ = stored(met.where("cut IS NOT NULL").select(*columns, "ix", "iy", F.col("node").alias("parent"), _node(F.col("cut"), F.col("ix"), F.col("iy")).alias("node")), "tree-open")
    every = bulks[0]
    for more in bulks[1:]:
        every = every.unionByName(more)
    # a node that cannot be cut may have any number of rows; it is one leaf
    full = steps[-1].where(f"nq + np > {BULK}").select("node") if steps else None
    for step in steps[:-1]:
        full = full.unionByName(step.where(f"cut IS NULL AND nq + np > {BULK}").select("node"))
    small, whole = every.join(full, "node", "left_anti"), every.join(full, "node", "left_semi")
    kept = [f for f in every.schema.fields if f.name not in ("ix", "iy")]
    cut_up = small.groupBy("node").applyInArrow(_leaves(cap), StructType([*kept, StructField("leaf", LongType())]))
    leaf_rows = stored(cut_up.unionByName(whole.select(*[f.name for f in kept], F.col("node").alias("leaf"))), "tree-leaves")
    leaves = _counted(leaf_rows.withColumnsRenamed({"node": "parent", "leaf": "node"}), F.lit(None).cast("int").alias("cut"))
    return Tree(leaf_rows.withColumnRenamed("node", "home"), [*[s.withColumn("cut", F.coalesce("cut", F.lit(0))) for s in steps], stored(leaves, "tree-nodes")])


def _apart(one: str, other: str, far: bool) -> Column:
    """Distance of two boxes, from end to end if ``far``."""
    return F.sqrt(sum(F.pow(_between(f"{one}{a}0", f"{one}{a}1", f"{other}{a}0", f"{other}{a}1", far), F.lit(2.0)) for a in "xy"))


def _between(low: str, high: str, other_low: str, other_high: str, far: bool) -> Column:
    """Distance along one axis: from end to end if ``far``, else of the gap."""
    ahead, behind = F.col(other_high) - F.col(low), F.col(high) - F.col(other_low)
    if far:
        return F.greatest(ahead, behind)
    return F.greatest(-ahead, -behind, F.lit(0.0))


def _levels(tree: Tree) -> Iterator[DataFrame]:
    """The nodes of each pass under their parents; a node that is cut into leaves waits, under its own number, for the last pass."""
    waiting = None
    for k, step in enumerate(tree.steps):
        new = step.select("parent", "node", "nq", "np", *[f"{s}{c}" for s in "qp" for c in _BOX])
        yield new if waiting is None or k == len(tree.steps) - 1 else new.unionByName(waiting)
        mine = new.join(step.where("cut = 0").select("node"), "node", "left_semi").withColumn("parent", F.col("node"))
        waiting = mine if waiting is None else waiting.unionByName(mine)


def visit(tree: Tree, asks: DataFrame, touches: Column) -> DataFrame:
    """``asks`` once for each ``leaf`` with rows to find whose box, px0 to py1, fulfils ``touches``, with that box; so must the boxes that hold it."""
    box = [f"p{c}" for c in _BOX]
    at = asks.withColumn("above", F.lit(-1).cast("long"))
    for down in _levels(tree):
        below = down.where("np > 0").select(F.col("parent").alias("above"), "node", *box)
        at = at.select(*asks.columns, "above").join(below, "above").where(touches).select(*asks.columns, F.col("node").alias("above"), *box)
    return at.withColumnRenamed("above", "leaf")


def near_leaves(tree: Tree, need: int) -> DataFrame:
    """(q, p, gap, home_q, home_p): pairs of leaves and their homes; rows of p can be among the ``need`` nearest of an asking row of q.  Nearer than ``gap`` is none."""
    pairs, done, loose = None, None, F.lit(1 + 1e-9)
    for down in _levels(tree):
        # a node that holds enough itself looks no farther than across, and so not into all neighbours of the node above it
        own = F.when(F.col("np") >= need, _apart("q", "p", True)).otherwise(F.lit(float("inf"))).alias("own")
        ask = down.where("nq > 0").select(F.col("parent").alias("above_q"), F.col("node").alias("q"), own, *[f"q{c}" for c in _BOX])
        found = down.where("np > 0").select(F.col("parent").alias("above_p"), F.col("node").alias("p"), "np", *[f"p{c}" for c in _BOX])
        if pairs is None:
            met = ask.join(found, F.col("above_q") == F.col("above_p")).withColumn("reach", F.col("own"))
        else:
            met = pairs.join(ask, "above_q").withColumn("reach", F.least("reach", "own")).where(_apart("q", "h", False) <= F.col("reach") * loose).join(found, "above_p")
        met = met.select("q", "p", "np", F.col("above_q").alias("home_q"), F.col("above_p").alias("home_p"), "reach", _apart("q", "p", False).alias("gap"), _apart("q", "p", True).alias("far"), *[f"p{c}" for c in _BOX])
        met = met.where(F.col("gap") <= F.col("reach") * loose)
        by_far = Window.partitionBy("q").orderBy("far", "p").rowsBetween(Window.unboundedPreceding, 0)
        met = met.withColumn("held", F.sum("np").over(by_far))
        reach = F.least("reach", F.coalesce(F.min(F.when(F.col("held") >= need, F.col("far"))).over(Window.partitionBy("q")), F.lit(float("inf"))))
        met = met.withColumn("reach", reach).where(F.col("gap") <= F.col("reach") * loose)
        pairs = stored(met.select(F.col("q").alias("above_q"), F.col("p").alias("above_p"), "reach", "gap", "home_q", "home_p", *[F.col(f"p{c}").alias(f"h{c}") for c in _BOX]), "tree-pairs")
        if done is not None:
            forget(done)
        done = pairs
        pairs = pairs.select("above_q", "above_p", "reach", *[f"h{c}" for c in _BOX])
    return done.select(F.col("above_q").alias("q"), F.col("above_p").alias("p"), "gap", "home_q", "home_p")
