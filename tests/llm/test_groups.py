"""Groups of nodes with one prefix and size, and sketches of different lengths; without Spark."""

import random
from itertools import combinations
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from corvane.llm import jaccard


def similar(a, b):
    both = len(np.intersect1d(a, b))
    return 100 * both >= 75 * (len(a) + len(b) - both)


@pytest.mark.parametrize("short", [1, 2, 8])
@pytest.mark.parametrize("listed", [0, 60])
def test_no_linked_pair_is_missed(monkeypatch, short, listed):
    monkeypatch.setattr(jaccard, "SHORT_RUN", short)
    rng = random.Random(5)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(8, 60))]
        for k in range(7):
            copy = list(base)
            copy[rng.choice([-1, -1, -1, rng.randrange(len(base))])] = f"x{k}"
            texts.append(" ".join(copy + ["end"] * rng.choice([0, 0, 1])))
    sets = jaccard.token_sets([t.encode() for t in texts])
    every = np.unique(np.concatenate(sets))[:listed]
    frequent = SimpleNamespace(value=(every, (np.arange(len(every)) % 5).astype(np.int8)))
    halves = [pa.RecordBatch.from_pydict({"text": pa.array(t)}) for t in (texts[::2], texts[1::2] + texts[:3])]
    index = [b for half in halves for b in jaccard._index_rows(frequent, 3)([half])]  # two tasks
    rows = [r for b in index for r in b.to_pylist()]
    assert any(len(r["node"]) > len(r["grp"]) for r in rows)  # groups of several members
    pairs, runs = set(), {}
    for bucket in range(3):
        own = pa.RecordBatch.from_pylist([r for r in rows if r["bucket"] == bucket], schema=index[0].schema)
        for found in jaccard._runs(iter([own])):
            for r in found.to_pylist():
                if r["kind"] == 0:
                    pairs.add((r["a"], r["b"]))
                else:
                    runs.setdefault(r["run"], set()).add(r["a"])
    nodes = {jaccard.node_of(s): s for s in sets}
    linked = [(min(a, b), max(a, b)) for a, b in combinations(nodes, 2) if similar(nodes[a], nodes[b])]
    assert linked
    assert all(p in pairs or any(p[0] in run and p[1] in run for run in runs.values()) for p in linked)
    assert all(a < b for a, b in pairs)


def test_sketches_of_different_lengths_never_overstate():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, int(n), dtype=np.uint64)) for n in rng.integers(1, 6000, 30)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 2**63, len(s) // 9 + 1, dtype=np.uint64)])) for s in sets]
    held = jaccard.Sketches([jaccard.sketch_of(s, jaccard.sketch_bits(len(s))) for s in sets])
    i, j = np.triu_indices(len(sets), 1)
    n = np.array([len(s) for s in sets])
    differ, far = held.far_apart(i, j, n[i] + n[j])
    for a, b, bits, away in zip(i, j, differ, far):
        assert bits <= len(np.setxor1d(sets[a], sets[b]))
        assert not (away and similar(sets[a], sets[b]))
    assert len(set(held.words)) > 2 and far.any() and not far.all()


def test_bits_follow_the_size():
    assert [jaccard.sketch_bits(n) for n in (1, 1024, 1025, 5000)] == [1024, 1024, 2048, 8192]
