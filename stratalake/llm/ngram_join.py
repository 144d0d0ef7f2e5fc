"""N-gram Jaccard join by size-banded tiles with hashed bitmap signatures.

A text's set is its distinct ``n``-word shingles (64-bit hashes).  Equal sets become one class first, so copies
cost nothing afterwards.  Two classes can link only if they share a shingle among the first few of each in one
global order (shingles that many texts share come last in it), so classes meet in tiles by such a shingle; tiles of one smallest class are one.
What a class holds from the tile's shingle on bounds its overlap with those whose first common shingle this is, so every
row carries the largest sum of sizes at which it can link there.  A tile is sorted by set size and only sizes within the
threshold of each other, a band of it, and within both rows' sums are compared: rows without such a partner leave first,
the others are compared by parity bitmaps: the bits in which two bitmaps differ bound the symmetric difference from below, and so the overlap
from above.  Classes that pass with any other meet once more with their sorted hash arrays and are intersected in
their task.  What leaves a task is a star for each component of true links, never a pair that only might link.

A large tile is dealt into parts, each a unit of its own.  When the links inside the parts are known, classes outside
the tile's largest component meet all parts; a tile that one component fills is done by then.  Rows whose sizes and sums
leave them no partner anywhere in the tile do not take part.  So a group of near copies costs its size, and what stays
apart in it and still might link costs its number times the group's size over the parts' size.
No link is lost.

Defined cases: null text, and text without words, has an empty set and is linked with nothing; fewer words than
``n`` are one shingle; repeated rows of a doc_id each get their row; a null doc_id is linked like others but is
never a component's smallest unless the component has no other; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake.llm._components import components
from stratalake.llm._shared import forget, small_batches, stored, unused
from stratalake.llm._words import Words, mix

SMALL_UNIT = 24
_SLICE_BYTES = 1 << 19
_PAIR_WORDS = 1 << 18
_PAIR_ROWS = 1 << 17


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about half a megabyte of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.unique(np.r_[0, np.searchsorted(sizes, np.arange(_SLICE_BYTES, (sizes[-1] if len(sizes) else 0) + 1, _SLICE_BYTES)) + 1, len(sizes)])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(texts)
    hashes = words.hashes(fold_case=True)
    windows = words.windows(hashes, n)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= n:
            yield np.unique(windows[a : b - n + 1])
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                short = mix(short * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + 1])
            yield short
        else:
            yield np.zeros(0, np.uint64)


def set_id(members: np.ndarray) -> int:
    """64-bit digest of a set."""
    total = mix(members).sum(keepdims=True, dtype=np.uint64) + np.full(1, len(members), np.uint64)
    parity = np.bitwise_xor.reduce(mix(members * np.uint64(0xD6E8FEB86659FD93)), keepdims=True)
    return int(mix(total ^ mix(parity)).view(np.int64)[0])


def signature(members: np.ndarray) -> bytes:
    """Parity bitmap: as many bits as the power of two that holds the set's size, 64 at least."""
    bits = 1 << max(6, int(len(members) - 1).bit_length())
    odd = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _needed(size: np.ndarray | int, percent: int):
    """Least overlap that a set of this size has with any it links to."""
    return -(-size * percent // 100)


def _allowed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Most elements in which sets of these sizes differ if they link."""
    return a + b - 2 * -(-percent * (a + b) // (100 + percent))


def _describe(n: int, frequent: float):
    """Per text its set's size and digest; and the shingles that a slice of texts has often."""
    names = ["kind", "doc_id", "row_key", "n", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                sets = list(shingle_sets(part.column("text"), n))
                sizes = [len(s) for s in sets]
                ids = [set_id(s) if len(s) else 0 for s in sets]
                k = len(sets)
                yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), part.column("doc_id"), part.column("row_key"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64())], names)
                # copies count once here too
                distinct = list({i: s for i, s in zip(ids, sets, strict=True) if len(s)}.values())
                if distinct:
                    shingles, counts = np.unique(np.concatenate(distinct), return_counts=True)
                    often = counts >= max(3, frequent * len(distinct))
                    m = int(often.sum())
                    if m:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([1] * m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(counts[often], pa.int64()), pa.array(shingles[often].view(np.int64))], names
                        )

    return run


def _prefixes(n: int, percent: int, shared):
    """Per distinct set of a slice: id, size, its first shingles in the global order, and its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, rank = shared.value
        for batch in batches:
            for part in text_slices(batch):
                rows = {}
                for members in shingle_sets(part.column("text"), n):
                    if not len(members) or (key := set_id(members)) in rows:
                        continue
                    order = members
                    if len(heavy):
                        at = np.minimum(np.searchsorted(heavy, members), len(heavy) - 1)
                        weight = np.where(heavy[at] == members, rank[at], 0)
                        order = members[np.lexsort((members, weight))]
                    rows[key] = (len(members), order[: len(members) - _needed(len(members), percent) + 1].tobytes(), signature(members))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(rows), pa.int64()), *(pa.array([r[i] for r in rows.values()], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary())))], ["set_id", "n", "prefix", "bits"]
                )

    return run


def _by_shingle(shared, hot: bool):
    """Rows (shingle, set_id, place in the prefix): of shingles among the frequent ones if ``hot``, else of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, _ = shared.value
        for batch in batches:
            prefix = [np.frombuffer(x, np.uint64) for x in batch.column("prefix").to_pylist()]
            shingles = np.concatenate(prefix) if prefix else np.zeros(0, np.uint64)
            sizes = np.array([len(p) for p in prefix], np.int64)
            ids = np.repeat(batch.column("set_id").to_numpy(), sizes)
            places = np.arange(len(shingles)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            among = heavy[np.minimum(np.searchsorted(heavy, shingles), len(heavy) - 1)] == shingles if len(heavy) else np.zeros(len(shingles), bool)
            take = among == hot
            yield pa.RecordBatch.from_arrays([pa.array(shingles[take].view(np.int64)), pa.array(ids[take], pa.int64()), pa.array(places[take], pa.int32())], ["shingle", "set_id", "place"])

    return run


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by unit, cut where the unit changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        units = batch.column("unit").to_numpy()
        if not len(units):
            continue
        other = np.flatnonzero(units != units[-1])
        cut = int(other[-1]) + 1 if len(other) else 0  # rows before the last unit
        if held and (cut or held[-1].column("unit")[-1].as_py() != units[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
            batch = batch.slice(cut)
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
            batch = batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


class _Units:
    """Whole units, each sorted by set size, of one chunk of rows.

    Without ``cap`` a row may link at any sum of sizes; without bitmaps sizes alone decide what passes.
    """

    def __init__(self, table: pa.Table, bitmaps: list[bytes] | None, percent: int):
        self.percent = percent
        unit, self.ids, self.n, self.side, self.root = (table[c].to_numpy() for c in ("unit", "set_id", "n", "side", "root"))
        self.cap = table["cap"].to_numpy() if "cap" in table.column_names else np.full(len(self.n), np.iinfo(np.int64).max)
        self.signed = bitmaps is not None
        self.words = np.array([len(x) // 8 for x in bitmaps or []], np.int64)
        self.at = np.cumsum(self.words) - self.words
        self.data = np.frombuffer(b"".join(bitmaps or []), np.uint64)
        starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        self.bounds = np.r_[starts, len(unit)]

    def open(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether rows i and j (sizes n[i] >= n[j]) may link here by their sizes and nothing else has joined or parted them."""
        fits = (self.n[j] >= _needed(self.n[i], self.percent)) & (self.n[i] + self.n[j] <= np.minimum(self.cap[i], self.cap[j]))
        return fits & (self.root[i] != self.root[j]) & ((self.side[i] == 0) | (self.side[j] == 0))

    def passes(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the bitmaps of rows i and j allow a link; for pairs whose sizes do."""
        out = np.zeros(len(i), bool)
        limit = _allowed(self.n[i], self.n[j], self.percent)
        wide, narrow = self.words[i], self.words[j]
        for w, v in np.unique(np.stack([wide, narrow], 1), axis=0).tolist():
            some = np.flatnonzero((wide == w) & (narrow == v))
            for a in range(0, len(some), max(1, _PAIR_WORDS // w)):
                part = some[a : a + max(1, _PAIR_WORDS // w)]
                x = self.data[self.at[i[part]][:, None] + np.arange(w)]
                if w != v:  # fold the wider bitmap: its sets' sizes differ by less than two, so once at most
                    x = x[:, :v] ^ x[:, v:]
                y = self.data[self.at[j[part]][:, None] + np.arange(v)]
                out[part] = np.bitwise_count(x ^ y).sum(1) <= limit[part]
        return out

    def met(self) -> np.ndarray:
        """Rows that pass with another row of their unit."""
        found = np.zeros(len(self.n), bool)
        sizes = np.diff(self.bounds)
        place = np.arange(len(self.n)) - np.repeat(self.bounds[:-1], sizes)
        place[np.repeat(sizes > SMALL_UNIT, sizes)] = -1
        for k in range(1, min(SMALL_UNIT, int(sizes.max(initial=0)))):
            i = np.flatnonzero(place >= k)
            self._mark(found, i, i - k)
        for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True):
            if b - a > SMALL_UNIT:
                low = a + np.searchsorted(self.n[a:b], _needed(self.n[a:b], self.percent))
                rows = np.arange(a, b)
                for some in np.array_split(rows, max(1, (b - a) ** 2 // _PAIR_ROWS)):
                    counts = some - low[some - a]
                    i = np.repeat(some, counts)
                    j = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low[some - a], counts)
                    self._mark(found, i, j)
        return found

    def _mark(self, found: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        fits = self.open(i, j) & ~(found[i] & found[j])  # of two marked rows nothing new can be learned
        i, j = i[fits], j[fits]
        ok = self.passes(i, j) if self.signed else slice(None)
        found[i[ok]] = True
        found[j[ok]] = True

    def links(self, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """True links that hold each unit's components together: a forest, so fewer than the unit's rows."""
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        starts = np.cumsum([0, *map(len, sets)])
        for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True):
            low = a + np.searchsorted(self.n[a:b], _needed(self.n[a:b], self.percent))
            for i in range(int(a) + 1, int(b)):
                j = np.arange(i - 1, low[i - a] - 1, -1)
                j = j[self.open(np.full(len(j), i), j)]
                most, take = max(4, _PAIR_WORDS // int(self.n[i])), 4
                while len(j):  # the next in size first: one link spares the rest of its component
                    some, j = j[:take], j[take:]
                    some = some[self.passes(np.full(len(some), i), some)]
                    if len(some):
                        counts = self.n[some]
                        at = np.repeat(starts[some] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                        there = flat[at]
                        held = sets[i][np.minimum(np.searchsorted(sets[i], there), len(sets[i]) - 1)] == there
                        both = np.add.reduceat(held.astype(np.int64), np.cumsum(counts) - counts)
                        for k in some[100 * both >= self.percent * (self.n[i] + counts - both)].tolist():
                            if self.root[k] != self.root[i]:
                                yield i, k
                                mine = self.root[a:b]
                                mine[mine == self.root[k]] = self.root[i]
                        j = j[self.root[j] != self.root[i]]
                    take = min(4 * take, most)


_UNIT = "unit long, side int, root long, set_id long, n long, cap long"
_COLUMNS = ["unit", "side", "root", "set_id", "n", "cap"]


def _screen(percent: int, signed: bool):
    """Rows of units that their sizes, and their bitmaps if ``signed``, allow to link with another row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_units(batches):
            found = _Units(table, table["bits"].to_pylist() if signed else None, percent).met()
            yield from table.select(_COLUMNS).filter(pa.array(found)).to_batches()

    return run


def _settle(percent: int):
    """Of whole units the roots that exact intersection joins, each with the least root of its component in the unit.

    A pair that does not link stays in its task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_units(batches):
            sets = [np.frombuffer(x, np.uint64) for x in table["members"].to_pylist()]
            units = _Units(table, [signature(s) for s in sets], percent)
            before, units.root = units.root, units.root.copy()
            joined = {int(np.searchsorted(units.bounds, i, "right")) - 1 for i, _ in units.links(sets)}
            stars = [np.zeros((0, 2), np.int64)]
            for u in joined:
                a, b = units.bounds[u : u + 2]
                _, part = np.unique(units.root[a:b], return_inverse=True)
                low = np.full(part.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(low, part, before[a:b])
                stars.append(np.stack([before[a:b], low[part]], 1)[before[a:b] != low[part]])
            found = np.unique(np.concatenate(stars), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, k], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _arrays(n: int):
    """Rows of units with their sorted hash arrays; of rows that repeat a text of one doc_id a task keeps one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had = set()
        for batch in batches:
            keys = list(zip(batch.column("unit").to_pylist(), batch.column("side").to_pylist(), batch.column("set_id").to_pylist(), strict=True))
            new = []
            for key in keys:
                new.append(key not in had)
                had.add(key)
            for part in text_slices(batch.filter(pa.array(new, pa.bool_()))):
                sets = [s.tobytes() for s in shingle_sets(part.column("text"), n)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in _COLUMNS), pa.array(sets, pa.binary())], [*_COLUMNS, "members"])

    return run


def _links(units: DataFrame, bits: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int, broadcast_rows: int) -> DataFrame:
    """(a, b): stars over different roots of ``units`` (unit, side, root, set_id, n, cap) whose sets link.

    Sizes, and for what they leave bitmaps, say which rows of a unit may link at all; those meet again with their sorted hash arrays, made where the
    texts of their classes lie, and are intersected.
    """
    def sorted_units(rows: DataFrame) -> DataFrame:
        return rows.repartition("unit").sortWithinPartitions("unit", "n", "set_id")

    sized = sorted_units(units).mapInArrow(_screen(percent, False), _UNIT)
    with_bits = sized.join(bits.select("set_id", "bits"), "set_id").select(*_COLUMNS, "bits")
    passed = sorted_units(with_bits).mapInArrow(_screen(percent, True), _UNIT)
    needed = stored(passed.join(classes.select("set_id", "row_key"), "set_id"), "needed", free=True)
    rows = F.broadcast(needed) if needed.count() <= broadcast_rows else needed
    arrays = docs.select("row_key", "text").join(rows, "row_key").select(*_COLUMNS, "text").mapInArrow(_arrays(n), f"{_UNIT}, members binary")
    links = stored(sorted_units(arrays).mapInArrow(_settle(percent), "a long, b long"), "links", free=True)
    forget(needed)
    return links


def _tiles(prefixes: DataFrame, shared, percent: int) -> DataFrame:
    """(tile, set_id, n, cap): sets that share a shingle of their prefixes are in a tile together, tiles of two sets and more.

    Tiles of one smallest set are one tile under its id: near copies share many shingles and still meet once.  A pair links
    with an overlap of percent / (100 + percent) of the sum of its sizes or more, and in the tile of its first common shingle
    has at most what the smaller number of shingles from there on allows: ``cap`` is the largest such sum of sizes, taken
    from the row's first place where tiles are one.
    """
    prefix = prefixes.select("set_id", "prefix")
    rare = prefix.mapInArrow(_by_shingle(shared, False), "shingle long, set_id long, place int")
    same = Window.partitionBy("shingle")
    rare = rare.select("set_id", "place", F.min("set_id").over(same).alias("tile"), F.count(F.lit(1)).over(same).alias("rows")).where("rows > 1").select("tile", "set_id", "place")
    # frequent shingles may be in a third of all sets: they are counted where they lie, and are heavy_limit rows at most
    hot = prefix.mapInArrow(_by_shingle(shared, True), "shingle long, set_id long, place int")
    lowest = hot.groupBy("shingle").agg(F.min("set_id").alias("tile"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    hot = hot.join(F.broadcast(lowest), "shingle").select("tile", "set_id", "place")
    met = stored(rare.unionByName(hot).groupBy("tile", "set_id").agg(F.min("place").alias("place")), "met", free=True)
    cap = F.expr(f"(n - place) * {100 + percent} div {percent}")
    tiles = stored(met.join(prefixes.select("set_id", "n"), "set_id").select("tile", "set_id", "n", cap.alias("cap")), "tiles")
    forget(met)
    return tiles


def _partnered(tiles: DataFrame, percent: int) -> DataFrame:
    """Rows of ``tiles`` to whose sizes and caps some other row of the tile may answer.

    A tile is described by bands of sizes that grow by a hundredth, sizes below 100 each on their own: some 1,400 bands
    up to a million shingles, however many rows.
    """
    band, reach = F.floor(F.log("n") / math.log(1.01)), F.col("cap") - F.col("n")
    bands = tiles.groupBy("tile", band.alias("band")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("low"), F.max("n").alias("high"), F.max(reach).alias("reach"))
    held = bands.groupBy("tile").agg(F.collect_list(F.struct("band", "rows", "low", "high", "reach")).alias("bands"))
    least, most = F.expr(f"(n * {percent} + 99) div 100"), F.least(F.expr(f"n * 100 div {percent}"), reach)
    answers = F.exists("bands", lambda b: (b["low"] <= most) & (b["high"] >= least) & (b["reach"] >= F.col("n")) & ((b["rows"] > 1) | (b["band"] != band)))
    return tiles.join(held, "tile").where(answers).select(*tiles.columns)


def _crossed(tiles: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Units that bring rows of different parts of a tile together: rows outside the tile's largest component with all rows.

    ``tiles`` has a tile's number of rows and of parts besides.  A tile that one component fills has no such unit, so a
    large group of near copies costs what it has besides its component, and only rows that have a possible partner take part.
    """
    rooted = _partnered(tiles, percent).join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    of_root = rooted.groupBy("tile", "root").agg(F.count(F.lit(1)).alias("rows"))
    most = of_root.groupBy("tile").agg(F.max_by("root", F.struct("rows", "root")).alias("most"), F.max("rows").alias("top"), F.sum("rows").alias("all")).where("all > top")
    rows = rooted.join(most, "tile").withColumn("parts", F.ceil(F.col("parts") * F.col("all") / F.col("held")).cast("int"))
    rows = rows.withColumn("few", F.ceil((F.col("all") - F.col("top")) * F.col("parts") / F.col("all")).cast("int"))

    def part(seed: int, parts: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "tile", "set_id"), F.col(parts)).cast("int")

    def every(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    outside = rows.where("root <> most").select("*", part(3, "few").alias("i"), every("parts").alias("j")).withColumn("side", F.lit(0))
    everyone = rows.select("*", every("few").alias("i"), part(5, "parts").alias("j")).withColumn("side", F.lit(1))
    return outside.unionByName(everyone).select(F.xxhash64("tile", "i", "j").alias("unit"), "side", "root", "set_id", "n", "cap")


def similar_groups(
    docs: DataFrame, n: int = 4, percent: int = 85, frequent: float = 0.004, heavy_limit: int = 200_000, broadcast_rows: int = 300_000, part_rows: int = 384, part_bytes: int = 1 << 24
) -> DataFrame:
    """Per row of ``docs``: doc_id, row_key, n_shingles, root and component_id (smallest doc_id reachable by links).

    ``root`` names the component; null for empty sets, which are linked with nothing.

    ``frequent`` and ``heavy_limit`` bound the shingles that are moved to the end of the order (held by that
    share of a slice's texts, at most so many); ``part_rows`` and ``part_bytes`` (of hash arrays) say how much of
    a tile one task takes at once.  They change the work done and never the result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), F.col("text"))
    described = stored(base.mapInArrow(_describe(n, frequent), "kind int, doc_id long, row_key long, n long, key long"), "sets")
    sets = described.where("kind = 0").select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.col("key").alias("set_id"))
    classes = sets.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("low_doc"), F.min("row_key").alias("row_key"))
    heavy = described.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(heavy_limit).collect()
    heavy_keys = np.array([r["key"] for r in heavy], np.int64).view(np.uint64)
    by_key = np.argsort(heavy_keys)
    shared = spark.sparkContext.broadcast((heavy_keys[by_key], np.array([r["n"] for r in heavy], np.int64)[by_key]))
    prefixes = base.select("text").mapInArrow(_prefixes(n, percent, shared), "set_id long, n long, prefix binary, bits binary")
    prefixes = stored(prefixes.groupBy("set_id").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits")), "prefixes", free=True)
    tiles = _tiles(prefixes, shared, percent)
    bits = stored(prefixes.join(tiles.select("set_id").distinct(), "set_id", "left_semi").select("set_id", "bits"), "bits", free=True)
    forget(prefixes)
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / part_rows, F.sum(8 * F.col("n") + 64) / part_bytes)).cast("int")
    large = stored(tiles.groupBy("tile").agg(parts.alias("parts"), F.count(F.lit(1)).alias("held")).where("parts > 1"), "large")
    parted = tiles.join(large, "tile", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64(F.lit(5), "tile", "set_id"), F.col("parts")).cast("int")
    units = parted.select(F.xxhash64("tile", own).alias("unit"), F.lit(0).alias("side"), F.col("set_id").alias("root"), "set_id", "n", "cap")
    roots = components(_links(units, bits, classes, base, n, percent, broadcast_rows)).select(F.col("node").alias("set_id"), "root")
    if large.limit(1).count():
        crossed = stored(_crossed(tiles.join(large, "tile"), roots, percent), "crossed")
        more = _links(crossed, bits, classes, base, n, percent, broadcast_rows)
        if more.limit(1).count():
            # links of roots: sets follow theirs
            above = components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))
            every = roots.unionByName(above.select(F.col("root").alias("set_id"), "root")).distinct()
            roots = every.join(above, "root", "left").select("set_id", F.coalesce("top", "root").alias("root")).distinct()
        forget(crossed)
    forget(tiles, bits, large)
    members = classes.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    lowest = members.groupBy("root").agg(F.min("low_doc").alias("component_id"))
    named = members.join(lowest, "root").select("set_id", "root", "component_id")
    filled = sets.withColumn("set_id", F.when(F.col("n_shingles") > 0, F.col("set_id")))
    return filled.join(named, "set_id", "left").select("doc_id", "row_key", "n_shingles", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_per_group(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one row of each component, that of its smallest doc_id; rows without words all stay."""
    key = unused("row_key", docs)
    has_word = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    groups = similar_groups(docs, **settings).where("root IS NOT NULL")
    # nulls come first in structs' order, so a null doc_id is kept only if flagged last
    chosen = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row_key").alias("k"))).alias("low")).select(F.col("low.k").alias(key))
    rows = docs.where(has_word).withColumn(key, F.xxhash64("doc_id", "text"))
    # rows alike in doc_id and text share a key: one of them stays
    kept = rows.join(chosen, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
    return kept.unionByName(docs.where(~has_word))


def op8_query(docs: DataFrame) -> DataFrame:
    """Components of all documents under links of 85 % and more."""
    return similar_groups(docs).select("doc_id", "n_shingles", "component_id")
