"""Suffix-array removal, the Jaccard join and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from corvane.llm import decontam, jaccard, suffix_dedup
from hypothesis import given, settings
from hypothesis import strategies as st


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ---- suffix arrays -------------------------------------------------------------------------------------------------


def plain_removal(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                covered[i] += 1
                covered[i + length] -= 1
        covered = np.cumsum(covered)[:-1] > 0
        edges = np.diff(np.concatenate([[0], covered.astype(int)]))
        out.append((int(covered.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(b for b, c in zip(t, covered) if not c)).hexdigest()))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=10, max_size=60), min_size=1, max_size=12))
def test_repeats_in_a_shard(contexts):
    contexts = [c.encode() for c in contexts]
    flags, at = suffix_dedup.repeats(contexts, 10), 0
    count = Counter(c[i : i + 10] for c in contexts for i in range(len(c) - 9))
    for c in contexts:
        assert [bool(flags[at + i]) for i in range(len(c) - 9)] == [count[c[i : i + 10]] > 1 for i in range(len(c) - 9)]
        at += len(c)


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=200))
def test_suffix_order(data):
    order, _ = suffix_dedup.suffix_order(np.frombuffer(data, np.uint8), 256)
    padded = [(data[i:] + bytes(256))[:256] for i in range(len(data))]
    assert [padded[i] for i in order] == sorted(padded)


def pieces(seed=3, n=90):
    rng = random.Random(seed)
    rnd = lambda n: bytes(rng.choice(b"abcd") for _ in range(n))
    pool = [rnd(rng.randint(30, 300)) for _ in range(12)]
    make = lambda: rng.choice([rnd(rng.randint(1, 80)), rng.choice(pool)[rng.randint(0, 20) :], b"a" * rng.randint(1, 90), b"xyz" * rng.randint(1, 30)])
    texts = [b"".join(make() for _ in range(rng.randint(0, 6))) for _ in range(n)]
    return texts + [texts[3], texts[3], b""]


@pytest.mark.parametrize("shard_contexts, hot_hashes", [(8000, 100), (3, 100), (3, 0)])
def test_removal(spark, shard_contexts, hot_hashes):
    texts = pieces()
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.find(df, length=40, gram=16, shard_contexts=shard_contexts, hot_hashes=hot_hashes, shard_bytes=3000).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removal(texts, 40)


def test_removal_on_documents(documents):
    rows = documents.select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.find(documents).collect()}
    assert [got[r.doc_id] for r in rows] == plain_removal([r.text.encode() for r in rows], 200)


def test_removal_of_odd_inputs(odd_docs, no_docs):
    rows = suffix_dedup.find(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    texts = [(r.text or "").encode() for r in odd_docs.collect()]
    short = [t if len(t) < 5000 else t[:5000] for t in texts]
    assert sorted((r.n_bytes, r.n_removed) for r in rows if r.doc_id != 6) == sorted((len(t), x[0]) for t, x in zip(texts, plain_removal(short, 200)) if len(t) < 5000)
    long = next(r for r in rows if r.doc_id == 6)
    assert long.n_removed == long.n_bytes and long.n_spans == 1  # a text that repeats itself throughout
    assert suffix_dedup.find(no_docs).count() == 0


# ---- Jaccard ----------------------------------------------------------------------------------------------------------


def plain_classes(rows):
    sets = []
    for _, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", ascii_lower(text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j, k in Counter(j for g in s for j in where[g] if j > i).items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                parent[find(j)] = find(i)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[find(i)] = min(ids.get(find(i), doc_id), doc_id)
    return [(doc_id, len(s), ids.get(find(i))) for i, ((doc_id, _), s) in enumerate(zip(rows, sets))]


def near_copies(seed, groups, copies, words, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    line = "this line stands in every one of the texts here and there"
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            out.append(" ".join(own) + "\n" + line)
    return [(i, t) for i, t in enumerate(rng.sample(out, len(out)))]


def key(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("seed, groups, copies, words, edits, run, block", [(1, 40, 4, 60, 5, 8, 1024), (2, 4, 60, 80, 6, 3, 16), (3, 60, 3, 8, 2, 2, 4)])
def test_classes(spark, monkeypatch, seed, groups, copies, words, edits, run, block):
    monkeypatch.setattr(jaccard, "SHORT_RUN", run)
    monkeypatch.setattr(jaccard, "RUN_BLOCK", block)
    rows = near_copies(seed, groups, copies, words, edits)
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert key(tuple(r) for r in got) == key(plain_classes(rows))


def test_sketches_never_overstate():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, 200, replace=False), rng.integers(0, 2**63, int(rng.integers(0, 200)), dtype=np.uint64)]))
        x, y = (np.frombuffer(jaccard.sketch_of(s), np.uint64) for s in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


def test_classes_of_odd_inputs(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = [tuple(r) for r in jaccard.classes(odd_docs).collect()]
    assert key(got) == key(plain_classes(rows))
    assert jaccard.classes(no_docs).count() == 0
    kept = jaccard.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 2, 3, 4, 5, 6, 7, 9]


# ---- decontamination -----------------------------------------------------------------------------------------------------


def plain_hits(rows, items):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(t or ""))
    windows = [(str(i), {tuple(w[j : j + min(10, len(w))]) for j in range(len(w) - min(10, len(w)) + 1)}, min(10, len(w))) for i, t in items if (w := split(t))]
    out = []
    for doc_id, text in rows:
        words = split(text)
        hit, names = set(), set()
        for name, own, m in windows:
            for j in range(len(words) - m + 1):
                if tuple(words[j : j + m]) in own:
                    hit.update(range(j, j + m))
                    names.add(name)
        line = ",".join(sorted(names))
        out.append((doc_id, len(words), len(hit), len(names), hashlib.sha256(line.encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_words", [decontam.BLOCK_WORDS, 20])
def test_decontamination(spark, block_words):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 4, 9, 10, 11, 25])))) for i in range(20)] + [(20, None), (21, "Some words")]
    rows = []
    for i in range(150):
        t = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.6:
            item = rng.choice(items)[1] or ""
            t += item.split()[rng.randint(0, 3) :]
        rows.append((i, " ".join(t + ["x"] * rng.randint(0, 4))))
    rows += [(200, None), (201, ""), (201, ""), (None, "some WORDS!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.digest(decontam.find(docs, bench, block_words=block_words)).collect()
    want = plain_hits(rows, items)
    assert key(tuple(r) for r in got) == key(want)
    clean = decontam.clean(docs, bench, block_words=block_words)
    assert key((r.doc_id,) for r in clean.collect()) == key((w[0],) for w in want if not w[-1])


def test_decontamination_of_odd_inputs(spark, odd_docs, no_docs, documents, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontam.digest(decontam.find(odd_docs, bench)).count() == odd_docs.count()
    assert decontam.find(no_docs, bench).count() == 0
    nothing = decontam.digest(decontam.find(odd_docs, bench.where("item_id = -1"))).collect()
    assert not any(r.contaminated for r in nothing)
    assert decontam.clean(odd_docs, bench).columns == odd_docs.columns


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, pairs):
    parent = {i: i for p in pairs for i in p}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[find(a)] = find(b)
    names = {r.node: r.label for r in jaccard.components(spark.createDataFrame([(a, b) for a, b in pairs], "a long, b long")).collect()}
    linked = {i for a, b in pairs if a != b for i in (a, b)}
    assert set(names) == linked
    for a in linked:
        for b in linked:
            assert (names[a] == names[b]) == (find(a) == find(b))


def test_components_of_a_chain(spark):
    names = jaccard.components(spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")).collect()
    assert len(names) == 201 and len({r.label for r in names}) == 1
