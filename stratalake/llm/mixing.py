"""Mixing sources to target weights by a low-discrepancy schedule.

Point k of the golden-ratio sequence, frac(k / phi), falls into one source's part of the cumulative weights;
that source's slots are ranked, and its r-th slot takes block r (modulo its blocks) of its shuffled documents.
Blocks of a source have equal numbers of words; a document may lie in several and a block may be taken again
in a later pass over the source.

A source's target is its share of all words by weight, but at most ``max_repeats`` times its own words; the
excess is shared again by weight until no target is above that.

Scale: documents are shuffled by a hash and laid out with two-level running sums (hash bins of about ``bin_rows`` rows, then
rows of a bin), so no source, however hot, is ordered in one task.  Repeated rows share a hash and so a bin: a bin of more than ``_FULL``
times the rows meant is cut by hash and row number, after it is stored, so that a task that runs again sees the same numbers.  Copies lie
side by side in either layout, so which of them gets which place changes nothing.  Neither are the sources themselves ordered in one task, which may be as many
as hosts.  The schedule has ``slots`` points whatever the input.  Its table of blocks has as many rows as slots and
sources at most, and is broadcast only up to ``broadcast_rows``.

Defined cases: null text has size 0; null source is a source of its own, after all others; sizes of 0 take
nothing; repeated rows of a doc_id are separate documents; null doc_id is kept; texts of any length are one row; an empty
table gives an empty result; other columns, whatever their names, pass through in ``mix_sources`` but for those called as
the added ones, which win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake.llm._shared import set_aside, stored
from stratalake.operators.running import running

PHI = 0.6180339887498949
_GRID = 4096
_CHUNK = 1024
#: Times ``bin_rows`` that a bin may hold before it is cut: chance alone fills none so.
_FULL = 16
_BIN = ["none", "name", "bin", "sub", "salt"]
#: Weights of quotas are whole numbers, so that sums of them are exact.
_UNITS = 1 << 20


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """From (source, source_size): sid, a number by code point with null last, weight 1, 2, 3, repeating, target, and upto, the words of all sources up to it.

    With caps c and weights w, sources in order of c/w reach their cap as long as c/w is at most
    (all - caps before) / (weights from here on); the rest share what is left by weight.
    """
    numbered = running(sizes, [F.col("source").asc_nulls_last()], {"sid": F.lit(1), "upto": F.col("source_size")})
    weighted = numbered.withColumns({"weight": (F.col("sid") - 1) % 3 + 1, "cap": F.col("source_size") * max_repeats})
    levels = running(weighted, [F.col("cap") / F.col("weight"), F.col("sid")], {"caps": F.col("cap"), "weights": F.col("weight")})
    total, weight = levels.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(total or 0) - F.col("caps") + F.col("cap")) / (F.lit(weight or 0) - F.col("weights") + F.col("weight"))
    capped = stored(levels.withColumn("capped", F.col("cap") <= level * F.col("weight")), "capped")
    taken, left = capped.agg(F.sum(F.when(F.col("capped"), F.col("cap"))), F.sum(F.when(~F.col("capped"), F.col("weight")))).first()
    cap, share = F.col("cap").cast("double"), F.lit(float((total or 0) - (taken or 0))) * F.col("weight") / F.lit(float(left or 1))
    return stored(capped.select("source", "sid", "source_size", "upto", F.col("weight").cast("double").alias("weight"), F.when(F.col("capped"), cap).otherwise(F.least(cap, share)).alias("target")), "targets")


def schedule(targets: DataFrame, slots: int = 1 << 16) -> DataFrame:
    """Slots of the mix: (sid, rank, order, block, part, blocks).

    ``order`` places the slot in the mix, ``block`` (of the source's ``blocks``) is what it takes and ``part``
    the share of it: 1 but for a source's last slot, which makes the source's words meet its target.
    """
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    planned = (
        targets.where("source_size > 0")
        .withColumn("blocks", F.greatest(F.round(F.col("source_size") / max(total / slots, 1.0)), F.lit(1)).cast("long"))
        .withColumn("quota", F.col("target") * F.col("blocks") / F.col("source_size"))
        .withColumn("units", F.round(F.col("quota") * _UNITS).cast("long"))
        .select("sid", "blocks", "quota", "units")
    )
    summed = stored(running(planned, [F.col("sid")], {"end": F.col("units")}), "quotas")
    all_units = float(summed.agg(F.sum("units")).first()[0] or 1)
    # both ends are sums of the same whole numbers, so the parts tile [0, 1) without gaps
    parts = summed.select("sid", "blocks", "quota", ((F.col("end") - F.col("units")) / all_units).alias("lower"), (F.col("end") / all_units).alias("upper"))
    # points meet parts by grid cell: sources + cells rows, not sources x points
    cells = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lower") * _GRID), F.floor(F.col("upper") * _GRID))))
    points = targets.sparkSession.range(1, slots + 1).select(F.col("id").alias("order"), F.expr(f"id * {PHI}D - floor(id * {PHI}D)").alias("x"))
    placed = points.withColumn("cell", F.floor(F.col("x") * _GRID)).join(cells, "cell").where("x >= lower AND x < upper")
    # ranks by runs of points, so that a heavy source's points are not in one task
    placed = placed.select("sid", "order", "blocks", "quota", F.expr(f"order div {_CHUNK}").alias("chunk"))
    runs = placed.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    runs = runs.select("sid", "chunk", (F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n")).alias("earlier"))
    inside = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("order")) - 1
    ranked = placed.join(runs, ["sid", "chunk"]).select("sid", "order", "blocks", "quota", (F.col("earlier") + inside).cast("long").alias("rank"))
    got = F.coalesce(F.col("got"), F.lit(0).cast("long"))
    # a source that the points served less than its quota gets the rest at the end of the mix
    missing = (
        parts.join(ranked.groupBy("sid").agg(F.count(F.lit(1)).alias("got")), "sid", "left")
        .where(F.ceil("quota") > got)
        .withColumn("rank", F.explode(F.sequence(got, F.ceil("quota") - 1)))
        .select("sid", (F.lit(slots + 1) + F.col("rank")).alias("order"), "blocks", "quota", "rank")
    )
    return (
        ranked.unionByName(missing)
        .where(F.col("rank") < F.ceil("quota"))
        .select("sid", "rank", "order", (F.col("rank") % F.col("blocks")).alias("block"), F.least(F.lit(1.0), F.col("quota") - F.col("rank")).alias("part"), "blocks")
    )


def block_takes(slots: DataFrame, targets: DataFrame) -> DataFrame:
    """Per (sid, block): first word, times taken whole, words of a part taken once more, words taken before it (of this and all earlier sources).

    Block b of n blocks is the words [b * S div n, (b + 1) * S div n) of a source of S words.
    """
    begin = F.expr("(block * source_size) div blocks")
    length = F.expr("((block + 1) * source_size) div blocks") - begin
    counted = slots.groupBy("sid", "blocks", "block").agg(F.count_if(F.col("part") >= 1).alias("whole"), F.coalesce(F.max(F.when(F.col("part") < 1, F.col("part"))), F.lit(0.0)).alias("part"))
    # blocks that no slot takes are there too, so that every word finds its block
    every = targets.join(slots.select("sid", "blocks").distinct(), "sid").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    table = every.join(counted, ["sid", "blocks", "block"], "left").select(
        "sid", "block", begin.alias("begin"), length.alias("length"), F.coalesce("whole", F.lit(0).cast("long")).alias("whole"), F.round(F.coalesce("part", F.lit(0.0)) * length).cast("long").alias("once")
    )
    taken = F.col("whole") * F.col("length") + F.col("once")
    table = running(table, [F.col("sid"), F.col("block")], {"upto": taken})
    return table.select("sid", "block", "begin", "whole", "once", (F.col("upto") - taken).alias("before"))


def _per_bin(base: DataFrame) -> DataFrame:
    return stored(base.groupBy(*_BIN).agg(F.sum("size").alias("bin_size"), F.count(F.lit(1)).alias("bin_count")), "bins")


def _cut_full_bins(base: DataFrame, per_bin: DataFrame, bin_rows: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """``base`` and its bins, those that repeated rows overfill cut by hash and then by row number."""
    full = per_bin.where(F.col("bin_count") > _FULL * bin_rows).select("none", "name", "bin", F.lit(True).alias("full"), "bin_count")
    number, fullest = full.agg(F.count(F.lit(1)), F.max("bin_count")).first()
    if not number:
        return base, per_bin
    full = full.drop("bin_count")
    salts = -(-fullest // bin_rows)
    cut = base.join(F.broadcast(full) if number <= broadcast_rows else full, ["none", "name", "bin"], "left")
    # partitions number their rows by themselves, so the partition takes part in the salt
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(salts))
    cut = stored(cut.withColumns({"sub": F.when(F.col("full"), F.col("key")).otherwise(F.col("sub")), "salt": F.when(F.col("full"), salt).otherwise(F.col("salt"))}).drop("full"), "cut")
    return cut, _per_bin(cut)


def mix_sources(docs: DataFrame, slots: int = 1 << 16, max_repeats: int = 3, bin_rows: int = 1000, broadcast_rows: int = 300_000) -> DataFrame:
    """``docs`` with size, source_size, target and taken: how many of its words the mix takes, repeats counted."""
    added = ("size", "source_size", "target", "taken")
    base, own = set_aside(docs)
    bins = max(1, -(-docs.count() // bin_rows))
    key = F.xxhash64(F.lit(29), own["doc_id"], own["text"])
    # null sources meet under a flag and an empty name, which joins can compare
    base = base.withColumns(
        {"size": word_count(F.col(own["text"])), "key": key, "bin": F.pmod(F.shiftright(key, 20), F.lit(bins)), "none": F.col(own["source"]).isNull(), "name": F.coalesce(F.col(own["source"]).cast("string"), F.lit("")), "sub": F.lit(0).cast("long"), "salt": F.lit(0).cast("long")}
    )
    base, per_bin = _cut_full_bins(base, _per_bin(base), bin_rows, broadcast_rows)
    sizes = per_bin.groupBy("none", "name").agg(F.sum("bin_size").alias("source_size")).select(F.when(~F.col("none"), F.col("name")).alias("source"), "source_size")
    targets = source_targets(sizes, max_repeats)
    plan = stored(schedule(targets, slots), "schedule")
    takes = stored(block_takes(plan, targets), "takes")
    if takes.count() <= broadcast_rows:
        takes = F.broadcast(takes)
    named = targets.select(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), "sid", "source_size", "target", (F.col("upto") - F.col("source_size")).alias("earlier"))
    # sources in the order of their numbers, so that words before a bin are words of its source once those of earlier sources are taken off
    laid_bins = running(per_bin, [F.col(c) for c in _BIN], {"upto": F.col("bin_size")})
    context = (
        laid_bins.join(named, ["none", "name"])
        .withColumn("offset", F.col("upto") - F.col("bin_size") - F.col("earlier"))
        .drop("upto", "bin_size", "bin_count", "earlier")
        .join(plan.select("sid", "blocks").distinct(), "sid", "left")
    )
    row = Window.partitionBy(*_BIN).orderBy("key", own["doc_id"])
    laid = base.join(context, _BIN).withColumn("start", F.col("offset") + F.sum("size").over(row.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    laid = laid.withColumn("stop", F.col("start") + F.col("size"))
    # words taken before a position, at both ends; the block of word p of n blocks over S words is ((p + 1) * n - 1) div S
    for end, word in (("start", "start"), ("stop", "stop - 1")):
        block = F.when(F.col("size") > 0, F.expr(f"(({word} + 1) * blocks - 1) div source_size"))
        inside = F.col(end) - F.col("begin")
        upto = F.col("before") + F.col("whole") * inside + F.least(F.col("once"), inside)
        laid = laid.withColumn("block", block).join(takes, ["sid", "block"], "left").withColumn(f"{end}_taken", upto).drop("block", "begin", "whole", "once", "before")
    taken = F.coalesce(F.col("stop_taken") - F.col("start_taken"), F.lit(0).cast("long"))
    return laid.withColumn("taken", taken).select(*[F.col(own[c]).alias(c) for c in docs.columns if c not in added], *added)


def op9_query(docs: DataFrame) -> DataFrame:
    """The mix of all documents by their sources."""
    return mix_sources(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
