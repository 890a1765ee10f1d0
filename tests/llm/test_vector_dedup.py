"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest
from corvane.llm import queries, vector_dedup
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, threshold=0.9):
    """vec_id: (n_links, component_id, kept), rows of unique ids or null."""
    size = max((len(v) for _, v, *_ in rows if v), default=1)
    x = np.zeros((len(rows), size))
    ok = np.zeros(len(rows), bool)
    for i, (_, v, *_) in enumerate(rows):
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x[i, : len(v)] = np.array(v, np.float32)
            x[i] /= np.linalg.norm(x[i])
            ok[i] = True
    near = (x @ x.T >= threshold) & ok & ok[:, None]
    np.fill_diagonal(near, False)
    seen = {}
    for i in range(len(rows)):
        if i not in seen:
            stack, part = [i], {i}
            while stack:
                for j in np.flatnonzero(near[stack.pop()]):
                    if j not in part:
                        part.add(j)
                        stack.append(j)
            least = min((rows[j][0] for j in part if rows[j][0] is not None), default=None)
            seen |= dict.fromkeys(part, least)
    return sorted(((r[0], int(near[i].sum()), seen[i], r[0] == seen[i]) for i, r in enumerate(rows)), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert result(queries.op12_vector_dedup(spark, sf_dir)) == expected([(r[0], r[1]) for r in rows])


def clouds(rng, centres, each, spread, size):
    """Vectors around random centres; a spread of 0.2 gives cosines of some 0.96."""
    out = []
    for _ in range(centres):
        c = rng.normal(size=size)
        c /= np.linalg.norm(c)
        out += [(c + rng.normal(size=size) * spread / np.sqrt(size)).astype(np.float32).tolist() for _ in range(each)]
    return out


def test_tight_and_loose_groups(spark):
    """A hot ball, groups wider than a ball, chains, pairs and strangers; small audits would not see them all."""
    rng = np.random.default_rng(3)
    vectors = clouds(rng, 1, 400, 0.1, 24) + clouds(rng, 12, 10, 0.27, 24) + clouds(rng, 60, 2, 0.15, 24) + clouds(rng, 500, 1, 0.0, 24)
    turn = [np.concatenate([[np.cos(t), np.sin(t)], np.zeros(22)]).tolist() for t in np.arange(0, 2.6, 0.3)]  # neighbours link, others don't
    vectors += turn + [vectors[0], [2 * c for c in vectors[0]], vectors[-1]]
    order = rng.permutation(len(vectors))
    rows = [(int(i), np.array(vectors[k], np.float32).tolist()) for i, k in enumerate(order)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(4)
    want = expected(rows)
    assert result(vector_dedup.classes(df)) == want
    assert len({r[2] for r in want if r[1]}) > 60 and max(r[1] for r in want) > 390


def test_descent_finds_what_blocks_miss(spark, monkeypatch):
    """With tiny blocks, one pass and a tiny audit, the links come from the rounds."""
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    monkeypatch.setattr(vector_dedup, "GATHERINGS", 0)
    monkeypatch.setattr(vector_dedup, "STARTS", 1)
    monkeypatch.setattr(vector_dedup, "AUDITED", 40)
    rng = np.random.default_rng(4)
    vectors = clouds(rng, 30, 30, 0.2, 16)  # more links than a list holds at first
    rows = list(enumerate(vectors))
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    got, want = result(vector_dedup.classes(df)), expected(rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.97 * there <= found <= there
    assert [r[2] for r in got] == [r[2] for r in want]


def test_broken_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (8, [5.0, 0.0]), (9, [1e-30, 0.0]), (10, [3e38, 3e38]), (11, [-1.0, -0.0]), (None, [1.0, 0.1]), (None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    for c in ("node", "unit", "row", "name", "code", "n", "a", "b"):
        df = df.withColumn(c, F.lit(c))
    want = [(*r[:3], r[0] == r[2]) for r in expected(rows)]
    assert result(vector_dedup.classes(df)) == sorted(want, key=repr)
    assert result(vector_dedup.classes(df.where("vec_id < 0"))) == []
    twice = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (2, [1.0, 0.01], 1)], SCHEMA)
    assert result(vector_dedup.classes(twice)) == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (2, 2, 1, False)], key=repr)


@pytest.mark.parametrize("n", [1, 300])
def test_copies_only(spark, n):
    df = spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.lit(0.6), F.lit(0.8)).alias("embedding"), F.lit(1).alias("label"))
    assert result(vector_dedup.classes(df)) == sorted([(i, n - 1, 0, i == 0) for i in range(n)], key=repr)
