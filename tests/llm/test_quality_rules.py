import re
from collections import Counter

from stratalake.llm.quality_rules import base_measures, clean_lines, op6_query

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_base_measures(docs, rows):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in op6_query(docs).collect()}
    assert got == {r[0]: brute(r[1]) for r in rows}


def test_line_rules(spark):
    good = "This is a proper sentence of enough words, and it ends well."
    lines = [good, "Home | News | Sport | Weather | Mail", "© copyright 2020, all rights reserved", "buy### now$$$ this%%% thing&&& cheap***", "GO!! WIN!! NOW!! HERE!!", "stump of", good]
    row = clean_lines(spark.createDataFrame([(1, "\n".join(lines)), (2, good), (3, None), (4, "a | b | c | d\n" * 3)], "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in row}
    assert by[1].clean_text == good and by[1].n_lines == 7 and by[1].n_lines_removed == 6 and not by[1].lines_kept
    assert by[2].clean_text == good and by[2].lines_kept
    assert not by[3].lines_kept and by[3].clean_text == "" and not by[4].lines_kept


def test_other_columns_stay(docs):
    assert clean_lines(docs).columns == [*docs.columns, "clean_text", "n_lines", "n_lines_removed", "char_loss", "lines_kept"]


def test_empty(empty):
    assert op6_query(empty).collect() == []


def test_boilerplate_of_four_languages(spark):
    lines = ["Alle Rechte vorbehalten durch den Betreiber dieser Seite.", "Tous droits réservés par la maison de ce site web.", "Todos los derechos reservados por la casa de este sitio.", "Ein guter Satz mit genug Wörtern steht hier noch am Ende."]
    row = clean_lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).first()
    assert row.clean_text == lines[3]


def test_clashing_names_and_very_long_text(spark):
    long = "\n".join(f"Line {i} is one of a great many lines of this text." for i in range(40_000))
    df = spark.createDataFrame([(1, long, 1, "a", 2.0), (2, None, 2, None, None)], "doc_id long, text string, JUDGED int, total string, counts double")
    out = base_measures(clean_lines(df))
    by = {r.doc_id: r for r in out.collect()}
    assert (by[1].JUDGED, by[1].total, by[1].counts, by[1].n_lines, by[1].n_words) == (1, "a", 2.0, 40_000, 480_000) and by[2].n_words == 0
