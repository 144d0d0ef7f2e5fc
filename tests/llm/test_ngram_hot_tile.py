import time

import numpy as np
import pyarrow as pa
import pytest

from stratalake.llm import ngram_join as N


def sets_of(rows, groups=1, size=60, seed=3, changes=5):
    """Near copies of each of some sets, on both sides of the threshold, by size."""
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 2**63, size).astype(np.uint64) for _ in range(groups)]
    out = []
    for k in range(rows):
        own = base[k % groups][: size - rng.integers(0, 4)].copy()
        at = rng.integers(0, len(own), rng.integers(0, changes + 1))
        own[at] = rng.integers(0, 2**63, len(at))
        out.append(np.unique(own))
    return sorted(out, key=len)


def unit(sets, side=None, root=None):
    k = len(sets)
    columns = [pa.array([1] * k, pa.int64()), pa.array(side or [0] * k, pa.int32()), pa.array(root or list(range(k)), pa.int64()), pa.array(range(k), pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
    out = N._Units(pa.table(columns, ["unit", "side", "root", "set_id", "n"]), [N.signature(s) for s in sets], 85)
    out.root = out.root.copy()
    return out


def linked(a, b, percent=85):
    both = len(np.intersect1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def parts(pairs, roots):
    root = dict(enumerate(roots))
    for i, j in pairs:
        x, y = root[i], root[j]
        root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    first = {}
    return [first.setdefault(v, k) for k, v in root.items()]


@pytest.mark.parametrize("rows, groups, changes", [(20, 2, 4), (60, 1, 5), (150, 3, 5), (120, 40, 5), (90, 90, 2), (1, 1, 1)])
def test_links_of_a_unit_are_those_of_all_pairs(rows, groups, changes):
    sets = sets_of(rows, groups, changes=changes)
    true = [(i, j) for i in range(rows) for j in range(i) if linked(sets[i], sets[j])]
    found = list(unit(sets).links(sets))
    assert all(linked(sets[i], sets[j]) for i, j in found)
    assert len(found) < rows
    assert parts(found, range(rows)) == parts(true, range(rows))
    met = unit(sets).met()
    assert all(met[i] and met[j] for i, j in true)


def test_sides_and_roots_limit_the_pairs():
    sets = sets_of(80, 1, changes=5)
    side, root = [k % 2 for k in range(80)], [k % 5 for k in range(80)]
    true = [(i, j) for i in range(80) for j in range(i) if linked(sets[i], sets[j]) and not (side[i] and side[j])]
    found = list(unit(sets, side, root).links(sets))
    assert parts(found, root) == parts(true, root)


def test_near_copies_cost_their_number():
    took = []
    for rows in (1_000, 8_000):
        sets = sets_of(rows, changes=2)
        t = unit(sets)
        began = time.process_time()
        assert len(list(t.links(sets))) == rows - 1
        took.append(time.process_time() - began)
    assert took[1] < 20 * took[0]  # 8 times the rows; comparing roots of a unit is short but not constant


def test_near_copies_of_very_long_texts(spark):
    words = [f"w{k % 4999}x{k}" for k in range(200_000)]
    other = [w if k % 400 else "changed" for k, w in enumerate(words)]
    third = [w if k % 20 else f"c{k}" for k, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(third)), (4, "short text of a few words")]
    got = N.op8_query(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_many_texts_just_under_the_threshold(spark):
    """2,000 texts that all share their prefix and link with none but a few."""
    rng = np.random.default_rng(11)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for d in range(2_000):
        text = list(base)
        for at in rng.choice(15, 2, replace=False) * 4:  # two far edits cut 8 of 57 shingles
            text[at] = f"d{d}x{at}"
        rows.append((d, " ".join(text)))
    rows += [(5_000, " ".join(base)), (5_001, " ".join([*base, "more"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    shingles = {d: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for d, t in rows}
    ids = [r[0] for r in rows]
    root = {d: d for d in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    # texts with edits at the same places may link; others share at most 57 - 8 of 57 + 8 shingles
    places = {}
    for d, _ in rows:
        places.setdefault(frozenset(k for k in range(57) if tuple(base[k : k + 4]) in shingles[d]), []).append(d)
    groups = list(places.values())
    for x in range(len(groups)):
        for y in range(x + 1):
            for a in groups[x] if x == y else groups[x][:1]:
                for b in groups[y][:1]:
                    both = len(shingles[a] & shingles[b])
                    if a != b and 100 * both >= 85 * len(shingles[a] | shingles[b]):
                        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: r.component_id for r in N.op8_query(df).collect()}
    assert got == {d: find(d) for d in ids}


def test_near_misses_ship_their_number(spark, monkeypatch):
    """Texts of one prefix that link with few others: rows brought together again grow as the texts do."""
    crossed, shipped = N._crossed, []

    def counted(*args):
        out = crossed(*args)
        shipped.append(out.count())
        return out

    monkeypatch.setattr(N, "_crossed", counted)
    took = []
    for many in (2_000, 8_000):
        rng = np.random.default_rng(11)
        rows = []
        for d in range(many):
            text = [f"b{k}" for k in range(60 - d % 3)]
            for at in rng.choice(14, 2, replace=False) * 4:
                text[at] = f"d{d}x{at}"
            rows.append((d, " ".join(text)))
        rows += [(many + k, " ".join(f"b{j}" for j in range(60 - k))) for k in range(3)]
        shipped.clear()
        got = N.op8_query(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert len(got) == many + 3 and {r.component_id for r in got if r.doc_id >= many} == {many}
        took.append(sum(shipped))
    assert took[1] <= 5 * max(took[0], many // 10)


def test_rows_without_a_possible_partner_leave_a_tile(spark):
    rng = np.random.default_rng(5)
    rows = [(t, k, int(n), int(n * 185 // 85 * c)) for t in range(3) for k, (n, c) in enumerate(zip(rng.integers(20, 400, 60), rng.uniform(0.9, 1.0, 60), strict=True))]
    got = {(r.tile, r.set_id) for r in N._partnered(spark.createDataFrame(rows, "tile long, set_id long, n long, cap long"), 85).collect()}

    def may(a, b):
        return 100 * min(a[2], b[2]) >= 85 * max(a[2], b[2]) and a[2] + b[2] <= min(a[3], b[3])

    true = {a[:2] for a in rows if any(may(a, b) for b in rows if a[0] == b[0] and a[1] != b[1])}
    assert true <= got
    alone = {a[:2] for a in rows if not any(100 * min(a[2], b[2]) >= 83 * max(a[2], b[2]) for b in rows if a[0] == b[0] and a[1] != b[1])}
    assert not alone & got
