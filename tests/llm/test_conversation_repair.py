import hashlib
import itertools
import re
import zlib

import pytest

from stratalake.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, digest string, KIND int"
PATTERN = re.compile(r"(s?(ua)+)?")


def brute(messages: str, inserts: int, costs=repair.Costs()) -> tuple[int, str]:
    """Least (cost, audit) over all sequences of edits with at most so many inserts."""
    best = (10**9, "")
    for extra in range(inserts + 1):
        for at in itertools.combinations(range(len(messages) + extra), extra):
            slots, rest = [], iter(messages)
            for k in range(len(messages) + extra):
                slots.append(["Iu", "Ia"] if k in at else [f"{e}{c}" for c in [next(rest)] for e in (["D"] if c == "-" else ["D", "K", "u", "a"])])
            for way in itertools.product(*slots):
                roles, cost, audit = "", 0, ""
                for e, c in way:
                    if e == "I":
                        roles, cost, audit = roles + c, cost + costs.insert, audit + "I"
                    elif e == "D":
                        cost, audit = cost + costs.delete, audit + "D"
                    else:
                        roles += c.lower() if e == "K" else e
                        cost += (e != "K") * costs.rerole + c.isupper() * costs.truncated
                        audit += "K" if e == "K" else "R"
                if PATTERN.fullmatch(roles):
                    best = min(best, (cost, audit))
    return best


@pytest.mark.parametrize("costs", [repair.Costs(), repair.Costs(1, 4, 1, 1), repair.Costs(3, 3, 2, 0)])
def test_least_integer_equals_brute_force(costs):
    alphabet = "-suaxUA"
    for n in range(4):
        for messages in map("".join, itertools.product(alphabet, repeat=n)):
            assert repair.best_edits(messages, costs) == brute(messages, 2, costs), messages
    for messages in ("suau", "uuaa", "uaua", "aauu", "SuaX", "-u-a"):
        assert repair.best_edits(messages, costs) == brute(messages, 3, costs)


def test_long_conversation():
    assert repair.best_edits("s" + "ua" * 2000 + "u") == (2, "K" * 4001 + "D")


def plain(rows):
    """The query's rows by plain Python."""
    out, groups = [], {}
    for conv, turn, role, text, *_ in rows:
        group = groups.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        fault = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            group += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        seen, marks, faults = set(), "", {"b": 0, "d": 0, "t": 0}
        for _, role, text in group:
            core = text.strip(" \t\n\v\f\r")
            fault = "b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            mark = role[:1] if role[:1] in ("s", "u", "a") else "x"
            marks += "-" if fault in ("b", "d") else mark.upper() if fault else mark
        turns = {t for t, _, _ in group if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(group))
        cost, audit = brute(marks, 1) if len(marks) < 7 else repair.best_edits(marks)
        kept, n = [], 0
        for letter, (_, role, text) in zip(audit, group, strict=True):
            if letter != "D":
                kept.append(f"{role if letter == 'K' else 'ua'[n % 2] == 'u' and 'user' or 'assistant'}:{text}")
                n += not (letter == "K" and role[0] == "s")
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["b"], faults["d"], faults["t"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def fixture():
    words = ["Hi there.", "Fine!", "no end", "", " \t", None, "end? ", "Yes. ", "été."]
    rows = []
    for conv in [*range(40), None]:
        for turn in [None, *range(conv % 5 + 1 if conv is not None else 3), 9]:
            k = (conv or 3) * 7 + (turn or 0)
            rows.append((conv, turn, ["user", "assistant", "system", "tool", None, "unknown", ""][k % 7 if conv and conv % 3 else (k % 2)], words[k % len(words)], "x", "y", 1))
    rows += rows[:6]  # rows that repeat
    return [*rows, (77, 5, "user", "a " * 60000 + ".", "", "", 0), (77, 5, "assistant", "b.", "", "", 0), (78, None, "user", "x.", "", "", 0)]


def test_query_equals_plain_python(spark):
    rows = fixture()
    got = repair.op11_query(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows), key=key)


def test_repaired_messages(spark):
    rows = [(1, 0, "assistant", "A."), (1, 1, "user", "B."), (1, 2, "tool", "C."), (2, 0, "user", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    edits = repair.find_edits(table)
    got = repair.apply_edits(table, edits).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.role, r.text) for r in got] == [("1", "user", "B."), ("1", "assistant", "C.")]
    assert {r.conv_id: (r.cost, r.audit) for r in edits.collect()} == {"1": (3, "DKR"), "2": (2, "D")}


def test_inserts_when_they_are_cheap(spark):
    table = spark.createDataFrame([(1, 0, "user", "A.")], "conv_id long, turn long, role string, text string")
    edits = repair.find_edits(table, repair.Costs(insert=1))
    assert [(r.role, r.text) for r in repair.apply_edits(table, edits).orderBy("place").collect()] == [("user", "A."), ("assistant", "")]


def test_empty_table(spark):
    assert repair.op11_query(spark.createDataFrame([], SCHEMA)).collect() == []
