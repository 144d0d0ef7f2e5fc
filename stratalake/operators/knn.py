"""Exact k-nearest-neighbour join over a quadtree.

Queries and points share one tree of leaves with a bounded number of either (``quadtree``).  The tree says which leaves can hold
neighbours of which, so dense spots, however small, cost what even points do.  A task has the leaves of one node, its home, and what near leaves
outside hold: a point is shipped once to each home it may matter to, not to each leaf.  A leaf's own points bound how far its queries look, and it
meets only the points that near.  Points stream past a home in blocks, nearest first; no more than its queries and one block is held.
Points in one place count as k + 1 at most, however many they are; a home that cannot be cut is dealt into parts.
Ties are broken by id; a point is never its own neighbour in the self join.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratalake.operators import quadtree
from stratalake.storage import shuffle_partitions, stored

CAP = 128
BLOCK = 1 << 16
_PAIRS = 1 << 19


def _values(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Ids as an array that sorts as they do."""
    values = column.to_numpy(zero_copy_only=False)
    return values if values.dtype.kind in "iu" else np.array(values.tolist(), dtype=str)


class Nearest:
    """The k nearest so far of a leaf's queries, as places in ``names`` and ``where``."""

    def __init__(self, leaf: int, ids: pa.Array, xy: np.ndarray, alike: np.ndarray | None, k: int, same: bool):
        self.leaf, self.ids, self.xy, self.alike, self.k, self.same = leaf, ids, xy, alike, k, same
        self.own = _values(ids) if same else None
        self.box = (*xy.min(0), *xy.max(0))
        self.slack = 4 * np.spacing(np.abs(xy).max())
        self.worst = np.inf
        self.d, self.at = np.zeros((len(xy), 0)), np.zeros((len(xy), 0), np.int64)
        self.names: np.ndarray | None = None

    def _distances(self, xy: np.ndarray) -> np.ndarray:
        dx, dy = self.xy[:, :1] - xy[:, 0], self.xy[:, 1:] - xy[:, 1]
        return np.sqrt(dx * dx + dy * dy)

    def _outside(self, xy: np.ndarray) -> np.ndarray:
        """How far points are from the box of the queries, squared."""
        x0, y0, x1, y1 = self.box
        dx, dy = np.maximum(np.maximum(x0 - xy[:, 0], xy[:, 0] - x1), 0), np.maximum(np.maximum(y0 - xy[:, 1], xy[:, 1] - y1), 0)
        return dx * dx + dy * dy

    def look(self, block: _Block) -> None:
        """Meet those of a block that can be among the nearest."""
        need = self.k + self.same
        if self.worst == np.inf:
            some = block.of(self.leaf)
            if len(some) < need:
                some = np.argpartition(self._outside(block.xy), 4 * need)[: 4 * need] if len(block.xy) > 4 * need else np.arange(len(block.xy))
            if len(some) >= need:
                some = some[: max(need, _PAIRS // len(self.xy))]
                self.worst = float(np.partition(self._distances(block.xy[some]), need - 1, axis=1)[:, need - 1].max())
        reach = self.worst * (1 + 1e-9) + self.slack
        a, b = np.searchsorted(block.xy[:, 0], self.box[0] - reach), np.searchsorted(block.xy[:, 0], self.box[2] + reach, "right")
        rows = a + np.flatnonzero(self._outside(block.xy[a:b]) <= reach * reach)
        step = max(1, _PAIRS // len(self.xy))
        for c in range(0, len(rows), step):
            self._meet(block, rows[c : c + step])

    def _meet(self, block: _Block, rows: np.ndarray) -> None:
        ids, xy = block.ids[rows], block.xy[rows]
        d = self._distances(xy)
        if self.same:
            row, col = np.nonzero(d == 0)
            me = self.own[row] == ids[col]
            d[row[me], col[me]] = np.inf
        if self.names is None:
            self.names, self.where, self.kinds = ids, xy, None if block.alike is None else block.alike[rows]
            every, places = d, np.broadcast_to(np.arange(len(ids)), d.shape)
        else:
            every, places = np.concatenate([self.d, d], 1), np.concatenate([self.at, np.broadcast_to(len(self.names) + np.arange(len(ids)), d.shape)], 1)
            self.names, self.where = np.concatenate([self.names, ids]), np.concatenate([self.where, xy])
            self.kinds = None if block.alike is None else np.concatenate([self.kinds, block.alike[rows]])
        keep = min(self.k, every.shape[1])
        last = np.partition(every, keep - 1, axis=1)[:, keep - 1]
        # ties of the last are told apart by id
        row, col = np.nonzero(every <= last[:, None])
        by_name = np.empty(len(self.names), np.int64)
        by_name[np.argsort(self.names, kind="stable")] = np.arange(len(self.names))
        order = np.lexsort((by_name[places[row, col]], every[row, col], row))
        row, col = row[order], col[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[place < keep].reshape(-1, keep), col[place < keep].reshape(-1, keep)
        self.d = every[row, col]
        used, self.at = np.unique(places[row, col], return_inverse=True)
        self.at = self.at.reshape(self.d.shape)
        self.names, self.where, self.kinds = self.names[used], self.where[used], None if self.kinds is None else self.kinds[used]
        if keep == self.k:
            self.worst = min(self.worst, float(self.d[:, -1].max()))

    def rows(self, names: list[str], kind: pa.DataType, few: int) -> pa.RecordBatch:
        """What was found; of queries and points with kinds, beyond the first ``few`` only those alike."""
        found = np.isfinite(self.d)
        if self.alike is not None and self.names is not None:
            alike = (self.kinds[self.at] == self.alike[:, None]) & (self.alike != "")[:, None]
            found &= alike | (np.arange(self.d.shape[1]) < few)
        row, rank = np.nonzero(found)
        ids = pa.array(self.names[self.at[row, rank]] if self.names is not None else [], kind)
        more = [] if self.alike is None else [pa.array(alike[row, rank] if self.names is not None else [], pa.bool_())]
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(row)), ids, pa.array(self.d[row, rank]), pa.array(rank + 1, pa.int32()), *more], names)


class _Block:
    """Points by x, and which leaf holds which."""

    def __init__(self, table: pa.Table):
        x = table["x"].to_numpy()
        by_x = np.argsort(x, kind="stable")
        self.ids, self.xy = _values(table["id"])[by_x], np.stack([x, table["y"].to_numpy()], 1)[by_x]
        self.alike = _values(table["alike"])[by_x] if "alike" in table.column_names else None
        leaf = table["leaf"].to_numpy()[by_x]
        self._by_leaf = np.argsort(leaf, kind="stable")
        self._leaf = leaf[self._by_leaf]

    def of(self, leaf: int) -> np.ndarray:
        return self._by_leaf[np.searchsorted(self._leaf, leaf) : np.searchsorted(self._leaf, leaf, "right")]


def _leaves(asked: list[pa.RecordBatch], k: int, same: bool) -> list[Nearest]:
    table = pa.Table.from_batches(asked).sort_by("leaf").combine_chunks()
    leaf, xy, ids = table["leaf"].to_numpy(), np.stack([table["x"].to_numpy(), table["y"].to_numpy()], 1), pa.concat_arrays(table["qid"].chunks)
    alike = _values(table["alike"]) if "alike" in table.column_names else None
    # of a leaf of any size, no more than a block's matrix
    cuts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
    cuts = [c for a, b in zip(cuts, np.r_[cuts[1:], len(leaf)], strict=True) for c in range(a, b, 2 * CAP)]
    return [Nearest(int(leaf[a]), ids[a:b], xy[a:b], None if alike is None else alike[a:b], k, same) for a, b in zip(cuts, [*cuts[1:], len(leaf)], strict=True)]


def settled(batches: Iterator[pa.RecordBatch], k: int, same: bool) -> Iterator[Nearest]:
    """The nearest of each leaf's queries, from rows of ``at_home``."""
    now, asked, held, leaves = None, [], [], None

    def look() -> None:
        nonlocal held, leaves
        leaves = leaves if leaves is not None else _leaves(asked, k, same)
        if held:
            block = _Block(pa.Table.from_batches(held))
            for leaf in leaves:
                leaf.look(block)
        held = []

    for batch in batches:
        keys = np.stack([batch.column("home").to_numpy(), batch.column("part").to_numpy().astype(np.int64), ~batch.column("ask").to_numpy(zero_copy_only=False)], 1)
        cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)] if len(keys) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            some, key = batch.slice(a, b - a), tuple(keys[a][:2])
            if key != now:
                if asked:
                    look()
                    yield from leaves
                now, asked, held, leaves = key, [], [], None
            if not keys[a][2]:
                asked.append(some)
            elif asked:
                held.append(some)
                if sum(h.num_rows for h in held) >= BLOCK:
                    look()
    if asked:
        look()
        yield from leaves


def at_home(tree: quadtree.Tree, need: int) -> DataFrame:
    """Rows of the tree by (home, part): asking rows, then the home's points, then those of near leaves outside by the gap."""
    pairs = quadtree.near_leaves(tree, need)
    dealt = tree.steps[-1].where("nq > 0").groupBy(F.col("parent").alias("home")).agg(F.ceil(F.sum("nq") / quadtree.BULK).cast("int").alias("parts"))
    ask = tree.rows.where("ask").join(dealt, "home").withColumns({"part": F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int"), "gap": F.lit(-1.0)}).drop("parts")
    points = tree.rows.where("NOT ask")
    halo = pairs.where("home_q <> home_p").groupBy(F.col("home_q").alias("home"), F.col("p").alias("leaf")).agg(F.min("gap").alias("gap"))
    found = points.withColumn("gap", F.lit(-1.0)).unionByName(points.drop("home").join(halo, "leaf"))
    found = found.join(dealt, "home").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    # the number is given: joined to few partitions, the homes would lie unevenly on the tasks
    return ask.unionByName(found).repartition(shuffle_partitions(found), "home", "part").sortWithinPartitions("home", "part", F.desc("ask"), "gap")


def _stream(k: int, same: bool, few: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["qid", "id", "d", "rank"]
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        kind = first.schema.field("id").type
        names += ["alike"] if "alike" in first.schema.names else []
        for leaf in settled(itertools.chain([first], batches), k, same):
            yield leaf.rows(names, kind, few)

    return run


def knn(queries: DataFrame, points: DataFrame, k: int, same: bool = False, alike: str | None = None, few: int = 0) -> DataFrame:
    """(qid, id, d, rank): for each query (id, x, y) its k nearest points (id, x, y), fewer if there are not k.

    ``same``: both sides are one set; a point is not its own neighbour.  ``alike``: a column of both; a column ``alike`` says whether it is
    equal and not empty, and of the k nearest only the first ``few`` and those alike are returned.
    """
    # of points in one place the first k by id can be among anyone's nearest, and one more where a point passes itself over
    by_place = F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))
    kind = [F.coalesce(F.col(alike).cast("string"), F.lit("")).alias("alike")] if alike else []
    points = points.where("x IS NOT NULL AND y IS NOT NULL").select("id", "x", "y", *kind, by_place.alias("n")).where(F.col("n") <= k + 1)
    ask = queries.select(F.lit(True).alias("ask"), F.col("id").alias("qid"), F.lit(None).cast(points.schema["id"].dataType).alias("id"), F.col("x").cast("double"), F.col("y").cast("double"), *kind)
    none = F.lit(None).cast(queries.schema["id"].dataType).alias("qid")
    tree = quadtree.build(ask.unionByName(points.select(F.lit(False).alias("ask"), none, "id", F.col("x").cast("double"), F.col("y").cast("double"), *(["alike"] if alike else []))), CAP)
    schema = StructType(ask.select("qid", "id", F.col("x").alias("d"), F.lit(1).alias("rank"), *([F.lit(True).alias("alike")] if alike else [])).schema.fields)
    if tree is None:
        return queries.sparkSession.createDataFrame([], schema)
    return stored(at_home(tree, k + same).mapInArrow(_stream(k, same, few), schema), "knn")
