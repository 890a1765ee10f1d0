"""Hard negatives against exact scores of all pairs."""

import numpy as np
import pytest
from corvane.llm import hard_negatives, queries
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows):
    kept = []
    for k, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        v = np.floor(np.float64(256) * np.array(v, np.float32).astype(np.float64))
        kept.append((k, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, np.clip(v, -(2**27), 2**27).astype(np.int64)))
    size = max((len(v) for *_, v in kept), default=0)
    x = np.array([np.pad(v, (0, size - len(v))) for *_, v in kept], np.int64).reshape(len(kept), size)
    out = []
    for a, (_, anchor, label, _) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        score = (x @ x[a]).tolist()
        order = sorted((b for b in range(len(kept)) if b != a), key=lambda b: (-score[b], kept[b][1] is None, kept[b][1] or 0))
        for p in [b for b in order if kept[b][2] == label][:5]:
            window = [b for b in order if kept[b][2] != label and 80 * score[p] <= 100 * score[b] <= 100 * score[p]][:5]
            out += [(anchor, kept[p][1], r + 1, kept[b][1], score[p], score[b]) for r, b in enumerate(window)]
    return sorted(out, key=repr)


def mined(df):
    return hard_negatives.mine(df, F.col("vec_id") % 100 == 0, F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def result(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = result(queries.op13_hard_negatives(spark, sf_dir))
    assert got == expected(rows) and got


@pytest.mark.parametrize("block", [4, 4096])
def test_hot_vectors_ties_and_broken_rows(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "ANCHORS", block)
    rng = np.random.default_rng(5)
    base = rng.normal(size=12)
    rows = []
    for i in range(1200):
        # A third near one vector, a third with few values and so many ties, the rest at random.
        v = base + rng.normal(size=12) / 50 if i % 3 == 0 else rng.integers(-1, 2, 12) / 4 if i % 3 == 1 else rng.normal(size=12)
        rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(0, 4))))
    rows += [(1300, None, 1), (1400, [1.0, None], 1), (1500, [float("nan")] * 12, 2), (1600, [float("inf")] * 12, 2), (1700, [1.0] * 12, None), (1800, [], 1), (1900, [0.5, -0.5], 1), (2000, [3e9, -3e9], 2), (None, [0.25] * 12, 3), (None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("r")).withColumn("x", F.lit(1)).withColumn("score", F.lit(1)).repartition(5)
    assert result(mined(df)) == expected(rows)


def test_repeated_ids_and_no_rows(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (101, [0.9, 0.0], 2), (102, [0.95, 0.1], 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = result(mined(df))
    # Each copy is the other's positive.
    assert got == sorted([(100, 100, 1, 102, 65536, 256 * 243), (100, 100, 2, 101, 65536, 256 * 230)] * 2, key=repr)
    for empty in (df.where("vec_id < 0"), df.where("vec_id = 101"), df.where("vec_id = 100").limit(1)):
        assert result(mined(empty)) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(2, 400), st.integers(0, 2**32 - 1), st.sampled_from([1, 30, 4000, 2**27]))
def test_bounds_hold(size, n, seed, scale):
    rng = np.random.default_rng(seed)
    x = rng.integers(-scale, scale + 1, (n, size))
    book = hard_negatives.Codebook(x[: max(1, n // 3)])
    codes, left = book.encode(x)
    low, high = hard_negatives._bounds(book, book.tables(x[:5]), book.norms(x[:5]), codes, left.astype(np.float64))
    score = (x @ x[:5].T).astype(np.float64)
    assert (low <= score).all() and (score <= high).all()


def test_bounds_exclude_most_pairs(spark, sf_dir):
    x = np.floor(256 * np.array([r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()])).astype(np.int64)
    book = hard_negatives.Codebook(x[:300])
    codes, left = book.encode(x)
    low, high = hard_negatives._bounds(book, book.tables(x[:20]), book.norms(x[:20]), codes, left.astype(np.float64))
    tenth = np.sort(low, axis=0)[-10]
    assert (high >= tenth).mean() < 0.2
