"""Benchmark decontamination by spaced seeds.

Tokens are lower-cased runs of letters and digits; a letter of a script that is written without spaces is a token of
its own.  A seed is the hash of the tokens at the set positions of a fixed mask, so tokens at the other positions may
differ.  Seeds of the documents (at every position) meet
seeds of the benchmark items in a join; a hit fixes an alignment, which is verified token by token: a document
is contaminated by an item if, on one alignment, some ``window`` successive item tokens (all of them for a
shorter item) hold at least ``min_share`` matches.  Masks are tried wherever they fit; the three of them hit every
pattern of mismatches that the default ``window`` and ``min_share`` allow, so no such alignment is missed.  Other
settings are verified as given but may allow patterns that no mask hits.  Items shorter than any mask are found by the
hash of all their tokens, and count only if all of them match.

DataFrame functions only, and no lambda per token on the main path: shifted copies of a text's tokens are zipped, so a
row of the explosion holds the tokens of one place and its seeds are compiled expressions.  Of the documents only
positions and seeds are exploded (never their token arrays);
texts are met again by key for the few rows with hits, each with its list of alignments (two numbers each).  The
benchmark's seeds are broadcast only while their counted number is at most ``broadcast_seeds``; beyond that the join shuffles.

Defined cases: null and empty texts, and texts shorter than any item, have no seeds and are clean; items of fewer
than ``shortest`` tokens are too short to count as a leak and are not searched; items
with equal tokens count once, under their smallest id; rows that repeat a doc_id are judged by their own
texts; null doc_id and item_id are kept; empty tables give no hits; ``leaks`` ignores other columns, and ``decontaminate``
passes them through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.llm._shared import unused

#: Token positions that each mask compares.
MASKS = ((0, 1, 2, 4, 7, 8), (0, 2, 3, 5, 6, 8), (0, 1, 4, 5, 6, 7))
#: Tokens of the shortest item that masks find.
LEAST = 9
#: Blocks of letters that are written without spaces: Thai and Lao, Burmese, Khmer, kana, Han.
_BLOCKS = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F))
UNSPACED = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _BLOCKS)
_TOKEN = rf"[\p{{L}}\p{{N}}&&[^{UNSPACED}]]+|[{UNSPACED}]"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    """Hashes of the text's tokens."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, text: str, keep: list[str], short: list[int]) -> DataFrame:
    """``keep`` with (pos, seed) over all positions and masks, and over runs of each length in ``short``."""
    zipped = F.arrays_zip(*[F.slice("_words", k + 1, F.greatest(F.size("_words"), F.lit(0))).alias(str(k)) for k in range(LEAST)])
    placed = rows.select(*keep, words(F.col(text)).alias("_words")).select(*keep, F.posexplode(zipped).alias("pos", "_at"))

    def seed(number: int, places: tuple[int, ...]) -> Column:
        # past a text's end there are nulls
        return F.when(F.col("_at")[str(places[-1])].isNotNull(), F.xxhash64(F.lit(number), *[F.col("_at")[str(k)] for k in places]))

    found = [seed(m, mask) for m, mask in enumerate(MASKS)] + [seed(len(MASKS) + n, tuple(range(n))) for n in short]
    return placed.select(*keep, "pos", F.explode(F.array(*found)).alias("seed")).where("seed IS NOT NULL")


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def window_matches(equal: Column, window: int) -> Column:
    """Most matches in ``window`` successive entries of an array of 0 and 1."""
    last = F.greatest(F.size(equal) - window, F.lit(0)) + 1
    return F.array_max(F.transform(F.sequence(F.lit(1), last), lambda s: F.aggregate(F.slice(equal, s, F.lit(window)), F.lit(0), lambda a, x: a + x)))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 13, min_share: float = 0.84, shortest: int = 4, broadcast_seeds: int = 500_000) -> DataFrame:
    """(doc_id, item_id, matched, compared, doc_key): each pair of a document and an item that it holds."""
    base = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("doc_key"))
    items = benchmark.select("item_id", F.col("text").alias("item_text"), tokens(F.col("text")).alias("item_tokens")).where(F.size("item_tokens") >= shortest)
    items = items.groupBy("item_tokens").agg(F.min("item_id").alias("item_id"), F.min("item_text").alias("item_text")).withColumns({"item_key": F.xxhash64("item_tokens"), "n": F.size("item_tokens")})
    short = sorted(r["n"] for r in items.where(F.col("n") < LEAST).select("n").distinct().collect())  # lengths, eight at most
    # equal seeds within an item are all kept: each is an alignment of its own
    of_item = seeds(items, "item_text", ["item_key", "n"], [])
    for n in short:
        whole = seeds(items.where(F.col("n") == n), "item_text", ["item_key", "n"], [n]).where("pos = 0")
        of_item = of_item.unionByName(whole)
    item_seeds = of_item.withColumnRenamed("pos", "item_pos")
    if item_seeds.count() <= broadcast_seeds:
        item_seeds = F.broadcast(item_seeds)
    found = seeds(base, "text", ["doc_key"], short)
    hits = found.join(item_seeds, "seed").select("doc_key", "item_key", "n", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    per_doc = hits.groupBy("doc_key").agg(F.collect_list(F.struct("item_key", "n", "shift")).alias("aligned"))
    # each alignment takes its own tokens along, not its document's
    def overlaps(ts: Column) -> Column:
        return F.transform("aligned", lambda a: F.struct(a["item_key"].alias("item_key"), F.transform(F.sequence(F.lit(0), a["n"] - 1), lambda q: F.get(ts, a["shift"] + q)).alias("there")))

    met = base.join(per_doc, "doc_key").select("doc_id", "doc_key", F.explode(_let(tokens(F.col("text")), overlaps)).alias("o"))
    met = met.select("doc_id", "doc_key", "o.item_key", "o.there").join(items, "item_key")
    equal = F.zip_with("there", "item_tokens", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    compared = F.least(F.lit(window), F.col("n"))
    checked = met.select("doc_id", "doc_key", "item_id", window_matches(equal, window).alias("matched"), compared.alias("compared"))
    needed = F.when(F.col("compared") < LEAST, F.col("compared")).otherwise(F.ceil(F.col("compared") * min_share))
    return checked.where(F.col("matched") >= needed).groupBy("doc_id", "doc_key", "item_id").agg(F.max("matched").cast("long").alias("matched"), F.max("compared").cast("long").alias("compared"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    key = unused("key", docs)
    gone = leaks(docs, benchmark, **settings).select(F.col("doc_key").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64("doc_id", "text")).join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All leaks of the benchmark into the documents."""
    return leaks(docs, benchmark).select("doc_id", "item_id", "matched", "compared")
