"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text's vector is the mean of the embeddings of its hashed 2- to 4-byte subwords (A-Z folded, digits and
ASCII punctuation as blanks).  Embeddings and the softmax layer are trained together on a bounded sample of
labelled rows; at prediction their product is one table of per-bucket scores, so a whole text of any length
costs one lookup per subword.  A temperature and the rejection bound are set on a part of the sample that
training does not see.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and rejected; without labelled
rows all texts are ``und``; repeated rows each get their row and are drawn once for training; null doc_id is kept (and
never trained on); equal scores go to the language that is first by name; texts of any length are scored whole, by
pieces; an empty table gives an empty result; ``predict`` ignores other columns, ``keep_accepted`` passes them through,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.llm._shared import small_batches, unused
from stratalake.llm._words import mix

BUCKETS = 1 << 13
_PIECE = 1 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def _subwords(data: np.ndarray, starts: int | None = None) -> Iterator[np.ndarray]:
    """Buckets of the 2-, 3- and 4-byte subwords that start at each of the first ``starts`` bytes (at all if None)."""
    folded = _FOLD[data].astype(np.uint32)
    code = folded.copy()
    for n in (2, 3, 4):
        if len(folded) < n:
            return
        code = code[: len(folded) - n + 1] | (folded[n - 1 :] << np.uint32(8 * (n - 1)))
        h = code[:starts] * np.uint32(0x9E3779B1) + np.uint32(n)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        yield (h >> np.uint32(19)).astype(np.int64)


def _text_bytes(column: pa.Array) -> list[np.ndarray]:
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = column.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _counts(data: np.ndarray) -> np.ndarray:
    """How often each bucket occurs; by pieces with the three bytes after them, so that long texts stay within memory."""
    seen = np.zeros(BUCKETS, np.int64)
    for a in range(0, len(data), _PIECE):
        for buckets in _subwords(data[a : a + _PIECE + 3], _PIECE):
            seen += np.bincount(buckets, minlength=BUCKETS)
    return seen


@dataclass
class Model:
    """Languages, per-bucket scores (buckets x languages), bias, temperature and rejection bound."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, data: np.ndarray) -> np.ndarray:
        seen = _counts(data)
        return seen @ self.table / max(seen.sum(), 1) + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts = [], []
        for data in _text_bytes(batch.column("text")):
            seen = _counts(data)
            at = np.flatnonzero(seen)
            ids.append(at.astype(np.uint16).tobytes())
            counts.append((seen[at] / max(seen.sum(), 1)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "lang", "ids", "shares"])


def _dense(rows: list, which: np.ndarray) -> np.ndarray:
    out = np.zeros((len(which), BUCKETS), np.float32)
    for r, i in enumerate(which):
        out[r, np.frombuffer(rows[i].ids, np.uint16)] = np.frombuffer(rows[i].shares, np.float32)
    return out


def _sgd(rows: list, y: np.ndarray, n_languages: int, dim: int, epochs: int, rate: float, batch: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    embed = rng.normal(0, 0.5, (BUCKETS, dim)).astype(np.float32)
    out, bias = rng.normal(0, 0.5, (dim, n_languages)).astype(np.float32), np.zeros(n_languages, np.float32)
    for epoch in range(epochs):
        step, order = rate * (1 - epoch / epochs), rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            which = order[a : a + batch]
            x = _dense(rows, which)
            mean = x @ embed
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(which)), y[which]] -= 1
            grad = p @ out.T
            used = np.flatnonzero(x.any(0))
            out -= step / len(which) * (mean.T @ p)
            bias -= step / len(which) * p.sum(0)
            embed[used] -= 40 * step / len(which) * (x[:, used].T @ grad)  # shares are small: a larger rate than for the layer above
    return embed, out, bias


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(labelled: DataFrame, max_rows_per_language: int = 600, max_rows: int = 8000, max_languages: int = 1000, dim: int = 16, epochs: int = 8, rate: float = 2.0) -> Model:
    """Fit on rows (doc_id, text, lang).

    The sample is bounded: about ``max_rows_per_language`` rows (by a hash of doc_id and text) of each of the
    ``max_languages`` most frequent languages, and fewer of each where they would be over ``max_rows`` together.  The
    driver gets their hashed subword shares only, 49 KB a row at most.
    """
    small_batches(labelled.sparkSession)
    usable = labelled.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & has_letter(F.col("text")))
    sizes = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    wanted = min(max_rows_per_language, max(1, max_rows // len(languages)))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, wanted / r["count"]))])
    key = F.xxhash64("doc_id", "text", F.lit(17))
    keep = F.pmod(key, F.lit(1_000_000)) < F.ceil(share[F.col("lang")] * 1_000_000)
    # rows that repeat are one: a hash of them all would draw all or none
    sample = usable.where(keep).select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").groupBy("key", "lang").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    rows = sorted(sample.select("doc_id", "lang", "text").mapInArrow(_features, "doc_id long, lang string, ids binary, shares binary").collect(), key=lambda r: (r.doc_id, r.lang, r.ids))
    y = np.array([languages.index(r.lang) for r in rows])
    aside = mix(np.array([r.doc_id for r in rows], np.int64).astype(np.uint64)) % np.uint64(5) == 0
    if aside.all() or not aside.any():
        aside[:] = False
    fit = np.flatnonzero(~aside)
    embed, out, bias = _sgd([rows[i] for i in fit], y[fit], len(languages), dim, epochs, rate)
    model = Model(languages, (embed @ out).astype(np.float64), bias.astype(np.float64))
    held = np.flatnonzero(aside)
    if len(held):
        logits = np.concatenate([_dense(rows, held[a : a + 256]) @ model.table for a in range(0, len(held), 256)]) + model.bias
        _calibrate(model, logits, y[held])
    return model


def _calibrate(model: Model, logits: np.ndarray, y: np.ndarray) -> None:
    """Temperature of least loss; rejection below what nearly all rightly named held-out texts reach."""
    losses = {}
    for t in np.geomspace(0.05, 20, 41):
        model.temperature = float(t)
        losses[float(t)] = -np.log(np.maximum(model.probabilities(logits)[np.arange(len(y)), y], 1e-12)).mean()
    model.temperature = min(losses, key=losses.get)
    p = model.probabilities(logits)
    right = p.argmax(1) == y
    if right.any():
        model.reject_below = float(min(0.5, np.quantile(p.max(1)[right], 0.002)))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            langs, scores, accepted = [], [], []
            for data, letter in zip(_text_bytes(batch.column("text")), batch.column("letter").to_pylist(), strict=True):
                if not letter or not model.languages:
                    lang, score = "und", 0.0
                else:
                    p = model.probabilities(model.logits(data))
                    best = int(p.argmax())
                    lang, score = model.languages[best], float(p[best])
                langs.append(lang)
                scores.append(min(1.0, score))
                accepted.append(lang != "und" and score >= model.reject_below)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())],
                ["doc_id", "lang_pred", "score", "accepted"],
            )

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred, score and whether the calibrated rejection accepts it; from the text alone."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS x max_languages numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", has_letter(F.col("text")).alias("letter"))
    return rows.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double, accepted boolean")


def _accepted(shared, letter_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            keep = []
            for data, letter in zip(_text_bytes(batch.column("text")), batch.column(letter_name).to_pylist(), strict=True):
                keep.append(bool(letter and model.languages) and float(model.probabilities(model.logits(data)).max()) >= model.reject_below)
            yield batch.filter(pa.array(keep, pa.bool_())).drop_columns([letter_name])

    return run


def keep_accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all columns, whose language the calibrated rejection accepts."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = unused("letter", docs)
    return docs.withColumn(name, has_letter(F.col("text"))).mapInArrow(_accepted(shared, name), docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op7_query(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, then name the language of all documents."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
