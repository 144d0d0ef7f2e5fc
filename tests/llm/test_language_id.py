import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalake.llm import language_id as L

SYLLABLES = {"xx": ["ta", "ko", "mi", "ru"], "yy": ["schen", "ber", "ung", "keit"], "zz": ["éa", "oux", "ère", "çon"]}


def sample(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60)))
        rows.append((i, text, lang))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(sample(1, 600), "doc_id long, text string, lang string")


def test_held_out_accuracy(labelled):
    got = L.op7_query(labelled).join(labelled, "doc_id").where("held_out").collect()
    assert len(got) > 80 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_text_alone_decides(spark, labelled):
    model = L.train(labelled)
    twice = spark.createDataFrame([(1, "schenber ungkeit"), (2, "schenber ungkeit"), (3, None), (4, " 12 !"), (None, "takomi")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score, r.accepted) for r in L.predict(twice, model).collect()}
    assert got[1] == got[2] and got[1][0] == "yy"
    assert got[3] == ("und", 0.0, False) == got[4]
    assert got[None][0] == "xx"
    kept = L.keep_accepted(twice.withColumn("extra", F.lit(1)), model)
    assert kept.columns == ["doc_id", "text", "extra"] and {3, 4}.isdisjoint(r.doc_id for r in kept.collect())


def test_long_text_by_pieces(labelled):
    model = L.train(labelled)
    data = np.frombuffer(("takomi " * 400_000).encode(), np.uint8)
    whole = np.zeros(L.BUCKETS, np.int64)
    for b in L._subwords(data):
        whole += np.bincount(b, minlength=L.BUCKETS)
    assert (L._counts(data) == whole).all()
    assert np.allclose(model.logits(data), whole @ model.table / whole.sum() + model.bias)


class Row:
    def __init__(self, text):
        seen = L._counts(np.frombuffer(text.encode(), np.uint8))
        at = np.flatnonzero(seen)
        self.ids, self.shares = at.astype(np.uint16).tobytes(), (seen[at] / seen.sum()).astype(np.float32).tobytes()
        self.subwords = [int(b) for h in L._subwords(np.frombuffer(text.encode(), np.uint8)) for b in h]


def test_one_step_of_descent_equals_a_plain_loop():
    """Mean of the subwords' embeddings, softmax, and the gradients of all three layers, one number at a time."""
    rows, y, dim, rate = [Row(t) for t in ("takomi ru", "schen ber", "kota")], np.array([0, 1, 0]), 3, 0.5
    rng = np.random.default_rng(7)
    embed, out = rng.normal(0, 0.5, (L.BUCKETS, dim)), rng.normal(0, 0.5, (dim, 2))
    g_embed, g_out, g_bias = np.zeros_like(embed), np.zeros_like(out), np.zeros(2)
    for row, target in zip(rows, y, strict=True):
        mean = np.zeros(dim)
        for b in row.subwords:
            mean += embed[b] / len(row.subwords)
        z = [sum(mean[d] * out[d, k] for d in range(dim)) for k in range(2)]
        p = np.exp(z) / np.exp(z).sum()
        for k in range(2):
            error = p[k] - (k == target)
            g_bias[k] += error
            for d in range(dim):
                g_out[d, k] += mean[d] * error
                for b in row.subwords:
                    g_embed[b, d] += out[d, k] * error / len(row.subwords)
    got = L._sgd(rows, y, 2, dim, 1, rate)
    for value, start, gradient, step in zip(got, (embed, out, np.zeros(2)), (g_embed, g_out, g_bias), (40 * rate / 3, rate / 3, rate / 3), strict=True):
        assert np.allclose(value, start - step * gradient, atol=1e-4)


def test_calibration_equals_brute_force():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 400)
    logits = rng.normal(0, 1, (400, 3)) + 4 * np.eye(3)[y]
    model = L.Model(["a", "b", "c"], np.zeros((L.BUCKETS, 3)), np.zeros(3))
    L._calibrate(model, logits, y)

    def loss(t):
        return sum(np.log(sum(np.exp(v / t) for v in z)) - z[k] / t for z, k in zip(logits, y, strict=True)) / len(y)

    assert loss(model.temperature) <= min(loss(t) for t in np.geomspace(0.05, 20, 41)) + 1e-9
    p = np.exp(logits / model.temperature)
    p /= p.sum(1, keepdims=True)
    right = np.sort(p.max(1)[p.argmax(1) == y])
    assert (right < model.reject_below).mean() <= 0.005 and model.reject_below <= 0.5


def test_sample_is_bounded_where_rows_repeat(spark):
    df = spark.createDataFrame([(1, "schenber ungkeit", "yy")] * 3000 + sample(4, 300), "doc_id long, text string, lang string")
    assert L.train(df, max_rows_per_language=50, max_rows=90).languages == ["xx", "yy", "zz"]


def test_clashing_names(spark, labelled):
    model = L.train(labelled)
    df = spark.createDataFrame([(1, "schenber ungkeit", "mine"), (2, None, "x")], "doc_id long, text string, LETTER string")
    kept = L.keep_accepted(df, model)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, "schenber ungkeit", "mine")]


def test_nothing_to_learn(spark, empty, docs):
    assert L.op7_query(empty).collect() == []
    got = L.op7_query(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in got} == {"und"}
