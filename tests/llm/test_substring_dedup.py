import hashlib
import re

from stratalake.llm import substring_dedup as S
from stratalake.llm.substring_dedup import op1_query, substring_dedup
from stratalake.storage import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=20):
    seen, out = set(), {}
    for doc_id, text in sorted(((-1 if r[0] is None else r[0], r[1] or "") for r in rows)):
        words = WORD.findall(text)
        gone = [False] * len(words)
        for k in range(len(words) - n + 1):
            window = tuple(words[k : k + n])
            if window in seen:
                gone[k : k + n] = [True] * n
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_equals_brute_force(docs, rows):
    got = {-1 if r.doc_id is None else r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op1_query(docs).collect()}
    assert got == brute(rows)
    assert sum(v[1] for v in got.values()) > 0


def test_group_count_does_not_matter(docs, rows):
    for groups in (2, 7, 40):
        got = {-1 if r.doc_id is None else r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(docs, groups=groups).collect()}
        assert got == {k: v[:2] for k, v in brute(rows).items()}


def test_repeated_ids_and_spans(spark):
    text = " ".join(f"v{i}" for i in range(30))
    rows = substring_dedup(spark.createDataFrame([(1, text), (1, text), (2, "z " + text)], "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in rows) == [0, 30, 30]
    spans = {r.doc_id: [tuple(s) for s in r.removed] for r in rows if r.doc_id == 2}
    assert spans == {2: [(1, 31)]}


def test_empty_table(empty):
    assert op1_query(empty).collect() == []


def test_rows_that_share_an_id_or_have_none(spark):
    """Of a passage in several such rows all but one lose it, whatever group they are dealt to."""
    passage = " ".join(f"p{i}" for i in range(25))
    data = [(i, f"a{k} " + passage + f" z{k}") for k, i in enumerate([None, None, None, 4, 4, 4, 9])]
    got = [(r.doc_id, r.n_removed) for r in substring_dedup(spark.createDataFrame(data, "doc_id long, text string"), groups=5).collect()]
    assert sorted(n for d, n in got if d is None) == [0, 25, 25] and {n for d, n in got if d is not None} == {25}


def test_a_third_of_all_rows_alike(spark, monkeypatch):
    """Rows alike go in once: groups stay small, and copies lose what copies lose."""
    passage = [f"p{i}" for i in range(25)]
    text = " ".join(["start", *passage, "end"])
    data = [(i, " ".join([f"u{i}", *passage, *(f"u{i}x{k}" for k in range(30))])) for i in range(40)] + [(50, text)] * 3000 + [(51, "too short")] * 1500 + [(None, None)] * 1200
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    groups = []
    monkeypatch.setattr(S, "stored", lambda t, name: groups.append(t.count()) or stored(t, name))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text, [tuple(x) for x in r.removed]) for r in substring_dedup(df, groups=6, group_bytes=4000).collect())
    assert groups == [43] and len(got) == len(data)
    assert sorted(g for g in got if g[0] == "50") == sorted([("50", 27, 25, "start end", [(1, 26)])] + [("50", 27, 27, "", [(0, 27)])] * 2999)
    assert [g for g in got if g[0] == "51"] == [("51", 2, 0, "too short", [])] * 1500
    assert [g[1:3] for g in got if g[0] == "None"] == [(0, 0)] * 1200
    whole = substring_dedup(df, groups=6).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text, [tuple(x) for x in r.removed]) for r in whole) == got


def test_very_long_text_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(300_000))
    df = spark.createDataFrame([(1, text, 1, "a"), (2, text + " more", 2, "b"), (3, None, 3, None)], "doc_id long, text string, g int, bits string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in op1_query(df).collect())
    assert got == [(1, 300_000, 0), (2, 300_001, 300_000), (3, 0, 0)]
