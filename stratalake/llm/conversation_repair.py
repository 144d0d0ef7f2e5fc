"""Conversation structure repair: the cheapest edits that make the role sequence ``(s?(ua)+)?``.

Edits and their letters: Keep (K, 0), Rerole to user or assistant (R, 1), Delete (D, 2), Insert an empty user or assistant
message anywhere (I, 5); blank and duplicate messages must be deleted, a truncated one that stays adds 5.

One integer says how good a way to the end is.  Its high digits are the cost; below them the audit letters stand in places of
fixed width, the first letter highest, and places past the end are zero, so of two audits that cost the same the one that is
less in ASCII order is the lesser integer, a prefix included.  Nodes of the graph are (message, state of the pattern, messages
inserted before it): an edge adds its cost, sets its letter in the first place and moves the others one place down.  The least
integer of the first node is the answer, and its digits are the audit; there is no other tie rule.

Two passes over the messages, both sorted by Spark and streamed.  The first sees digests instead of texts and keeps, for the conversation
at hand, one character a message and the digests met; the second brings texts and audits together and feeds a hash, so
a conversation of any size needs no more memory than its audit and digests.  A conversation's result is one audit and
one hash over its messages in order, so one task streams it, however long it is; Spark's sort spills.

Defined cases: null role or text is one space, a null conv_id is a conversation of its own, and a null turn comes first;
messages of one turn are taken by role, then a digest of the text; other roles are kept as they are until reroled or deleted; a conversation without
messages has no rows here (``repair`` takes ``ids`` for those); an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.llm._shared import small_batches, stored

_BITS = 3
_LETTERS = " DIKR"  # a letter's digit is its place; zero pads
_MUST_GO = "-"
_CACHED = 64
_WORD = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"


#: Of role and text; rows of one turn and role are taken in its order.
_DIGEST = "unhex(sha2(cast(concat(cast(octet_length(role) AS string), ':', role, text) AS binary), 256))"


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


#: state -> {initial: next state}.  0: nothing yet, 1: after s, 2: after u, 3: after a.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_DONE = (0, 3)
_WANTED = ("u", "u", "a", "u")


def least_weight(messages: str, costs: Costs = Costs()) -> tuple[int, int]:
    """The least integer over all edits of ``messages``, and the number of letter places in it.

    A character stands for a message: ``-`` must go; else its role's initial if that is s, u or a, or x; upper case if
    it is truncated.
    """
    n = len(messages)
    # deleting all is always a way, so a best one inserts no more than that costs
    places = n + n * costs.delete // costs.insert + 1
    top, high = _BITS * (places - 1), _BITS * places

    def along(rest: int, cost: int, letter: int) -> int:
        spent, letters = rest >> high, rest & ((1 << high) - 1)
        return (spent + cost << high) | letter << top | letters >> _BITS

    never = (n + 1) * max(costs.delete, costs.insert) + 1 << high
    values = [0 if q in _DONE else never for q in range(4)]
    for k in range(n, -1, -1):
        if k < n:
            c = messages[k]
            initial, extra = c.lower(), costs.truncated if c.isupper() else 0
            after, values = values, []
            for q in range(4):
                ways = [along(after[q], costs.delete, 1)]
                if c != _MUST_GO:
                    if initial in _NEXT[q]:
                        ways.append(along(after[_NEXT[q][initial]], extra, 3))
                    ways.append(along(after[_NEXT[q][_WANTED[q]]], costs.rerole + extra, 4))
                values.append(min(ways))
        for _ in range(2):  # a third message at one place would end where one ends
            values = [min(values[q], along(values[_NEXT[q][_WANTED[q]]], costs.insert, 2)) for q in range(4)]
    return values[0], places


@functools.lru_cache(maxsize=1 << 16)
def _known(messages: str, costs: Costs) -> tuple[int, str]:
    weight, places = least_weight(messages, costs)
    letters = weight & ((1 << _BITS * places) - 1)
    # octal digits are places of three bits
    audit = f"{letters:0{places}o}".rstrip("0").translate({ord(str(d)): c for d, c in enumerate(_LETTERS)})
    return weight >> _BITS * places, audit


def best_edits(messages: str, costs: Costs = Costs()) -> tuple[int, str]:
    """(cost, audit) of the messages; short sequences are remembered, as many conversations share theirs."""
    return (_known if len(messages) <= _CACHED else _known.__wrapped__)(messages, costs)


def _sums(costs: Costs):
    """A streaming pass over slim rows sorted by conversation and place."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run  # no conversation is that
        marks: list[str] = []
        seen: set[bytes] = set()
        turns = [0, 0, 0]  # least, largest, distinct
        faults = [0, 0, 0, 0]
        last: str | None = None
        done: list[tuple] = []

        def close() -> None:
            if now is not run:
                cost, audit = best_edits("".join(marks), costs)
                done.append((now, turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0, *faults, cost, audit))

        for batch in batches:
            for conv, turn, initial, blank, ended, digest in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "blank", "ended", "digest")), strict=True):
                if now is run or conv != now:
                    close()
                    now, marks, seen, turns, faults, last = conv, [], set(), [0, 0, 0], [0, 0, 0, 0], None
                if turn is not None:
                    if not turns[2]:
                        turns = [turn, turn, 1]
                    elif turn != turns[1]:
                        turns = [turns[0], turn, turns[2] + 1]
                fault = 0 if blank else 1 if digest in seen else None if ended else 2
                seen.add(digest)
                if fault is not None:
                    faults[fault] += 1
                if last is not None and last + initial not in ("su", "ua", "au"):
                    faults[3] += 1
                last = initial
                mark = initial if initial in ("s", "u", "a") else "x"
                marks.append(_MUST_GO if fault in (0, 1) else mark.upper() if fault == 2 else mark)
            if len(done) >= 1000:
                yield _table(done, names)
                done = []
        close()
        if done:
            yield _table(done, names)

    return run


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int64()] * (len(names) - 2), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _texts(keep_text: bool):
    """A streaming pass over an audit and then its messages, for each conversation: repaired messages, or their hash alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run
        audit, at, state = "", 0, 0
        digest, place = hashlib.sha256(), 0
        out: list[tuple] = []

        def emit(role: str, text: str) -> None:
            nonlocal place
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            if keep_text:
                out.append((now, place, role, text))
            place += 1

        def inserts() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                emit("user" if _WANTED[state] == "u" else "assistant", "")
                state, at = _NEXT[state][_WANTED[state]], at + 1

        def close() -> None:
            if now is not run:
                inserts()
                if not keep_text:
                    out.append((now, digest.hexdigest()))

        for batch in batches:
            for conv, letters, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
                if letters is not None:
                    close()
                    now, audit, at, state = conv, letters, 0, 0
                    digest, place = hashlib.sha256(), 0
                    continue
                inserts()
                letter, at = audit[at], at + 1
                if letter != "D":
                    if letter == "R":
                        role = "user" if _WANTED[state] == "u" else "assistant"
                    state = _NEXT[state][role[:1]]
                    emit(role, text)
            if out:
                yield _rows(out, keep_text)
                out = []
        close()
        if out:
            yield _rows(out, keep_text)

    return run


def _rows(out: list[tuple], keep_text: bool) -> pa.RecordBatch:
    kinds = (("conv_id", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())) if keep_text else (("conv_id", pa.string()), ("repaired_sha256", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])


def _messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), conv_id as text."""
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")}
    return conversations.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled["role"], filled["text"])


def find_edits(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Per conversation (conv_id string, turn, role, text) with messages: gaps, faults, illegal neighbours, cost and audit."""
    small_batches(conversations.sparkSession)
    slim = _messages(conversations).select(
        "conv_id", "turn", "role", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(_WORD)).alias("blank"), F.col("text").rlike(_ENDED).alias("ended"), F.expr(_DIGEST).alias("digest"),
    )
    dealt = slim.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest")
    summed = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return dealt.select("conv_id", "turn", "initial", "blank", "ended", "digest").mapInArrow(_sums(costs), summed)


def apply_edits(conversations: DataFrame, edits: DataFrame, keep_text: bool = True) -> DataFrame:
    """Repaired messages (conv_id string, place from 0, role, text), or (conv_id, repaired_sha256) if not ``keep_text``."""
    small_batches(conversations.sparkSession)
    text, no_text = F.lit(None).cast("string"), F.lit(None).cast("long")
    heads = edits.select("conv_id", F.lit(0).alias("kind"), no_text.alias("turn"), text.alias("role"), text.alias("text"), "audit")
    rows = _messages(conversations).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", text.alias("audit"))
    dealt = heads.unionByName(rows).withColumn("digest", F.expr(_DIGEST)).repartition("conv_id")
    dealt = dealt.sortWithinPartitions(F.asc_nulls_first("conv_id"), "kind", F.asc_nulls_first("turn"), "role", "digest")
    schema = "conv_id string, place long, role string, text string" if keep_text else "conv_id string, repaired_sha256 string"
    return dealt.select("conv_id", "audit", "role", "text").mapInArrow(_texts(keep_text), schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Messages with the faults that the query plants, by crc32 of ``conv_id:turn`` modulo 20."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(key.cast("binary")) % 20).alias("fault"))
    fault = F.col("fault")
    text: Column = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    changed = rows.where(fault != 0).select("conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"))
    return changed.drop("copy")


def op11_query(conversations: DataFrame) -> DataFrame:
    """Repairs of all conversations after damage, one row per original conv_id."""
    rows = damaged(conversations)
    kind = conversations.schema["conv_id"].dataType
    edits = stored(find_edits(rows), "edits")  # the audits go back to the texts, and into the result
    hashes = apply_edits(rows, edits, keep_text=False)
    zeros = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    empty = F.lit(hashlib.sha256().hexdigest())
    every = conversations.select(F.col("conv_id").cast("string").alias("conv_id")).distinct()
    found = edits.join(hashes.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    joined = every.join(found.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return joined.select(F.col("conv_id").cast(kind).alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zeros], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
