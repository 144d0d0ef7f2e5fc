"""URL filters: rules first, then the ratio of two character language models.

One model is learned from URLs that allow rules accept, one from those that block rules reject.  Each is a
variable-order Markov model over a folded alphabet (a-z, one digit class, ``. / -``, one class for the rest):
orders 0 to 3, Witten-Bell smoothed, each order backing off to the next lower one.  A URL's score is the
length-normalised difference of log-likelihoods; the cut is calibrated on labelled rows that the models did
not see, for the best sum of both classes' hit rates.

Everything is DataFrame work.  The folded alphabet bounds the distinct 4-grams (34 symbols to the 4th, about
1.3 million rows of two short columns), so the score table may be broadcast whatever the input's size.

Defined cases: null urls and urls without ``://`` have empty host and path; they are scored like any other
(as the empty string); repeated rows each get their row; null page_id is kept; without labelled rows of both
classes every score is 0 and is allowed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake.llm._shared import stored

ORDER = 3
ALPHABET = 34
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed rules of the registered query.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(action, rule) of the longest rule that fits; null if none does."""
    chosen = F.lit(None)
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        chosen = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))).otherwise(chosen)
    return chosen


def folded(host: Column, path: Column) -> Column:
    """Model alphabet: digits become 0, anything but a-z 0 . / - becomes *; padded by start and end marks."""
    text = F.translate(F.translate(F.concat(host, path), _UPPER, _LOWER), "123456789", "000000000")
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(text, r"[^a-z0./-]", "*"), F.lit("$"))


def exploded(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with each 4-gram of ``folded``; shifted copies of its characters are zipped, so long urls cost their length."""
    chars = F.split("folded", "")
    placed = rows.select(*keep, chars.alias("chars")).select(*keep, F.explode(F.arrays_zip(*[F.slice("chars", k + 1, F.size("chars")).alias(str(k)) for k in range(ORDER + 1)])).alias("at"))
    return placed.where(F.col("at")[str(ORDER)].isNotNull()).select(*keep, F.concat(*[F.col("at")[str(k)] for k in range(ORDER + 1)]).alias("gram"))


def gram_scores(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, llr) of each gram: log of its last character's probability if accepted over that if rejected.

    ``counts`` (gram, ok, bad).  A context of n events of t kinds gives the lower order t / (n + t).
    """
    scored = grams.select("gram").withColumns({"p_ok": F.lit(1.0 / ALPHABET), "p_bad": F.lit(1.0 / ALPHABET)})
    for k in range(ORDER + 1):
        suffix = F.substring("gram", ORDER + 1 - k, k + 1)
        level = counts.groupBy(suffix.alias("s")).agg(F.sum("ok").alias("ok"), F.sum("bad").alias("bad")).withColumn("context", F.substring("s", 1, k))
        totals = level.groupBy("context").agg(*[f(c).alias(f"{n}_{c}") for c in ("ok", "bad") for n, f in (("n", F.sum), ("t", lambda c: F.count_if(F.col(c) > 0)))])
        scored = scored.withColumns({"s": suffix, "context": F.substring("gram", ORDER + 1 - k, k)}).join(level.drop("context"), "s", "left").join(totals, "context", "left")
        for c in ("ok", "bad"):
            n, t, seen = F.coalesce(f"n_{c}", F.lit(0)), F.coalesce(f"t_{c}", F.lit(0)), F.coalesce(c, F.lit(0))
            scored = scored.withColumn(f"p_{c}", F.when(n > 0, (seen + t * F.col(f"p_{c}")) / (n + t)).otherwise(F.col(f"p_{c}")))
        scored = scored.select("gram", "p_ok", "p_bad")
    return scored.select("gram", (F.ln("p_ok") - F.ln("p_bad")).alias("llr"))


def calibrated_cut(scored: DataFrame) -> float:
    """The cut with the best sum of both classes' hit rates on held-out labelled rows; 0 without both classes.

    Scores are counted in steps of 1/100 between -10 and 10, so the running sums see 2,001 rows at most.
    """
    step = F.greatest(F.least(F.round(F.col("score") * 100), F.lit(1000)), F.lit(-1000)).cast("int").alias("step")
    steps = scored.where("held_out AND action IS NOT NULL").groupBy(step).agg(F.count_if(F.col("action") == "allow").alias("ok"), F.count_if(F.col("action") == "block").alias("bad"))
    above, below, all_rows = Window.orderBy("step").rowsBetween(0, Window.unboundedFollowing), Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rate = F.try_divide(F.sum("ok").over(above), F.sum("ok").over(all_rows)) + F.try_divide(F.coalesce(F.sum("bad").over(below), F.lit(0)), F.sum("bad").over(all_rows))
    best = steps.select("step", rate.alias("rate")).where("rate IS NOT NULL").orderBy(F.desc("rate"), F.abs("step"), "step").first()
    return 0.0 if best is None else (best["step"] - 0.5) / 100


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict and score."""
    rows = pages.select(F.col("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("m", rule).select("page_id", "host", "path", F.col("m")["rule"].alias("rule"), F.col("m")["action"].alias("action"))
    # labelled rows are put aside for calibration by their text, so copies stay on one side
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "folded": folded(F.col("host"), F.col("path")), "held_out": F.pmod(F.xxhash64("host", "path"), F.lit(5)) == 0})
    rows = stored(rows, "urls")
    counts = exploded(rows.where("action IS NOT NULL AND NOT held_out"), ["action"]).groupBy("gram").agg(F.count_if(F.col("action") == "allow").alias("ok"), F.count_if(F.col("action") == "block").alias("bad"))
    counts = stored(counts, "url-grams")
    both = counts.agg(F.sum("ok") > 0, F.sum("bad") > 0).first()
    if not (both[0] and both[1]):
        return rows.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    table = gram_scores(exploded(rows, []).distinct(), counts)
    # a row's grams lie together, so their scores add up before the shuffle; they carry a number only, not the url
    means = exploded(rows, ["row"]).join(F.broadcast(table), "gram").groupBy("row").agg(F.avg("llr").alias("score"))
    scored = stored(rows.drop("folded").join(means, "row"), "url-scores")
    verdict = F.coalesce(F.col("action"), F.when(F.col("score") >= calibrated_cut(scored), "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op2_query(pages: DataFrame) -> DataFrame:
    """Verdicts on the urls of all pages."""
    return filter_urls(pages)
