import random

import numpy as np

from stratalake.llm import packing


def test_round_trip(docs, rows):
    packed = packing.pack_tokens(docs, seq_len=64).collect()
    encode, end = packing._encoder("byte_bpe_50k.tiktoken")
    pieces = {}
    for r in packed:
        ids, positions = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == 64 and r.cu_seqlens[-1] == r.n_tokens <= 64
        for k, (doc, offset) in enumerate(zip(r.doc_ids, r.offsets, strict=True)):
            a, b = r.cu_seqlens[k : k + 2]
            assert (positions[a:b] == np.arange(b - a)).all()
            pieces.setdefault(doc, {})[offset] = ids[a:b]
    assert len({r.bin_id for r in packed}) == len(packed)
    for doc_id, text, *_ in rows:
        parts = pieces.get(doc_id, {})
        got = np.concatenate([parts[o] for o in sorted(parts)]) if parts else np.zeros(0)
        assert got.tolist() == ([*encode(text), end] if text else [])


def test_best_fit_equals_brute_force():
    rng = random.Random(3)
    for _ in range(50):
        room = rng.choice([7, 8, 100])
        sizes = [rng.randrange(1, room + 1) for _ in range(rng.randrange(0, 80))]
        free = []
        for s in sorted(sizes, reverse=True):
            best = min((f for f in range(len(free)) if free[f] >= s), key=lambda f: free[f], default=None)
            if best is None:
                free.append(room - s)
            else:
                free[best] -= s
        rows = packing.best_fit_decreasing(sizes, room)
        assert sorted(room - sum(sizes[i] for i in r) for r in rows) == sorted(free)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))


def test_empty_table(empty):
    assert packing.pack_tokens(empty).collect() == []
