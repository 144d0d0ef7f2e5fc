"""Line-first quality rules, as DataFrame expressions on each row.

Each line is judged by itself: a line of a navigation bar (mostly separators and very short cells), a
boilerplate line (licence, cookie, copyright and the like, or one that the text has already had), and a line
that ends without terminal punctuation while holding few words or mostly symbols fail.  Failing lines are
removed; a document that loses more than ``max_loss`` of its word characters, or all of them, is rejected.
Whole-document base rules (too few words, too many repeated word windows) reject on their own.

Defined cases: null and empty texts have no words and fail the base rules; null doc_id and repeated rows are
kept as they are; of equal lines the first stays; a text of any length is one row and never leaves its task; an empty table
gives an empty result; other columns are ignored by the query and kept by ``clean_lines`` and ``base_measures``, whatever
their names, but for those called as the added ones, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.llm._shared import unused

_BLANK = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
#: Fixed phrases of boilerplate lines, in English, German, French and Spanish.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies", "accept cookies",
    "subscribe to our newsletter", "sign up", "log in", "lorem ipsum", "enable javascript", "click here", "licensed under", "copyright",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerkl", "cookie-richtlinie", "newsletter abonnieren", "hier klicken",
    "tous droits r", "conditions d.utilisation", "politique de confidentialit", "accepter les cookies", "abonnez-vous", "cliquez ici",
    "todos los derechos reservados", "condiciones de uso", "pol.tica de privacidad", "aceptar cookies", "suscr.bete", "haga clic aqu",
)


#: A line ends well with one of these.
TERMINAL = r"[.!?…:;\"'”’»)\]]\s*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _BLANK + "+"), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, _BLANK + "+", "")), F.lit(0)).cast("long")


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(ws: Column, n: int = 8) -> Column:
    """Words inside windows of ``n`` words that the text has twice or more."""
    starts = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - n + 1)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, F.lit(n))))
    # most texts repeat nothing: distinct hashes say so without sorting positions
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(ws, h, n)))


def _covered(ws: Column, hashes: Column, n: int) -> Column:
    """Sort windows by hash and place; neighbours with equal words repeat; count the words they cover."""
    keyed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("p"))))

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((a["h"] == b["h"]) & (F.slice(ws, a["p"], F.lit(n)) == F.slice(ws, b["p"], F.lit(n))), F.lit(False))

    def repeated(sorted_windows: Column) -> Column:
        flags = F.transform(sorted_windows, lambda x, k: F.when(same(x, F.get(sorted_windows, k - 1)) | same(x, F.get(sorted_windows, k + 1)), x["p"]))
        return F.array_sort(F.array_compact(flags))

    gaps = let(let(keyed, repeated), lambda at: F.transform(at, lambda p, k: F.least(F.coalesce(F.get(at, k + 1) - p, F.lit(n)), F.lit(n))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)


def line_ok(line: Column) -> Column:
    """Whether one line passes the punctuation, navigation, symbol and boilerplate rules."""
    n = F.regexp_count(line, F.lit(_WORD))
    chars = word_chars(line)
    navigation = F.regexp_count(line, F.lit(r"\||»|·|›")) >= 3
    symbols = F.regexp_count(line, F.lit(r"[#*$%&|<>{}~^=+_\\]")) * 10 > chars
    shouting = F.regexp_count(line, F.lit(r"[!?]{2,}")) * 4 > n
    stump = (n < 4) & ~line.rlike(TERMINAL)
    boilerplate = (n <= 20) & F.lower(line).rlike("|".join(BOILERPLATE))
    return (n > 0) & ~(navigation | symbols | shouting | stump | boilerplate)


def clean_lines(docs: DataFrame, max_loss: float = 0.5) -> DataFrame:
    """``docs`` with clean_text, n_lines, n_lines_removed, char_loss and lines_kept (false: lost too much)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # of equal lines the first stays, and only that is judged
    judged = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.filter(F.array_distinct(x), line_ok).alias("good")))
    total = word_chars(text)
    added = ("clean_text", "n_lines", "n_lines_removed", "char_loss", "lines_kept")
    rows = docs.drop(*added)
    of_lines, of_text = unused("judged", docs), unused("total", docs)
    rows = rows.withColumns({of_lines: judged, of_text: total})
    rows = rows.withColumn("clean_text", F.array_join(F.col(of_lines)["good"], "\n"))
    loss = F.when(F.col(of_text) > 0, 1 - word_chars(F.col("clean_text")) / F.col(of_text)).otherwise(F.lit(1.0))
    rows = rows.withColumns({"n_lines": F.col(of_lines)["n"].cast("long"), "n_lines_removed": (F.col(of_lines)["n"] - F.size(F.col(of_lines)["good"])).cast("long"), "char_loss": loss})
    return rows.withColumn("lines_kept", F.col("char_loss") <= max_loss).select(*[c for c in docs.columns if c not in added], *added)


def base_measures(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.col("text")
    counts = let(words(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), n_repeat_words(ws).alias("r")))
    both = unused("counts", docs)
    return docs.withColumns({both: counts, "word_chars": word_chars(text), "n_symbols": n_symbols(text), "n_dup_lines": n_dup_lines(text)}).withColumns({"n_words": F.col(both)["n"], "n_repeat_words": F.col(both)["r"]}).drop(both)


def op6_query(docs: DataFrame) -> DataFrame:
    """Base measures, base verdict and the line-first verdict of all documents."""
    rows = base_measures(clean_lines(docs.select("doc_id", "text")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("lines_kept")).alias("kept"), "n_lines", "n_lines_removed"
    )
