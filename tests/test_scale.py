"""Merged statistics, ranks within few values and keyed permutations, against plain computations."""

import math
import random
import statistics

import numpy as np
import pytest
from corvane.operators import permute, sampling
from corvane.plans import states, summary
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

# ---- permutations ---------------------------------------------------------------------------------------------------


def plain(x, n, seed):
    """The permutation written as a loop."""
    a, b = permute.sides(n)
    while True:
        left, right = divmod(x, b)
        for i, key in enumerate(permute.keys_of(seed)):
            digit = left if i % 2 else right
            t = ((digit + key) % permute.PRIME * permute.FIRST + key * 4 // 12) % permute.PRIME
            t = t * t % permute.PRIME * permute.SECOND % permute.PRIME
            if i % 2:
                right = (right + t) % b
            else:
                left = (left + t) % a
        x = left * b + right
        if x < n:
            return x


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 600), st.integers(-5, 2**40))
def test_permutes(n, seed):
    assert sorted(plain(x, n, seed) for x in range(n)) == list(range(n))
    assert permute.walks(n) >= 1


@pytest.mark.parametrize("n", [1, 2, 3, 10, 997, 5000])
def test_expression_is_the_permutation(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "row_idx")
    got = {r.row_idx: r.to for r in rows.select("row_idx", permute.permuted("row_idx", n, 42).alias("to")).collect()}
    assert got == {x: plain(x, n, 42) for x in range(n)}


def test_large_rows_and_seeds(spark):
    n = 10**15 + 7
    rows = spark.createDataFrame([(x,) for x in (0, 1, n // 2, n - 1)], "row_idx long")
    for seed in (1, 2):
        assert {r.row_idx: r.to for r in rows.select("row_idx", permute.permuted("row_idx", n, seed).alias("to")).collect()} == {x: plain(x, n, seed) for x in (0, 1, n // 2, n - 1)}
    moved = [plain(x, 4000, 3) for x in range(4000)]
    assert abs(np.corrcoef(range(4000), moved)[0, 1]) < 0.06
    assert len({x - y for x, y in zip(moved, moved[1:])}) > 1500


def test_samples_and_splits(spark):
    rows = sampling.with_row_index(spark.range(300), "id")
    drawn = sampling.sample(rows, 20, method="permuted").collect()
    assert sorted(r.sample_idx for r in drawn) == list(range(20))
    split = sampling.split(rows, 0.8, 0.1, method="permuted")
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 240, "validation": 30, "unused": 30}
    with pytest.raises(ValueError):
        sampling.sample(rows, 20, n_rows=sampling.EXACT_ROWS + 1)


# ---- ranks ------------------------------------------------------------------------------------------------------------


@pytest.fixture
def uncoalesced(spark):
    """Small partitions stay as they are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_metric_is_ranked_by_many_tasks(spark, uncoalesced):
    rows = spark.range(4000).select(F.lit("f1").alias("metric"), (F.col("id") % 97 / 97.0).alias("mean"), F.format_string("e%05d", "id").alias("experiment_name"))
    odd = spark.createDataFrame([(None, 1.0, "x"), (None, 2.0, "y"), ("g", None, "a"), ("g", float("nan"), "b"), ("g", 5.0, "c")], "metric string, mean double, experiment_name string")
    got = summary.ranked(rows.union(odd))
    want = sorted(((-m, n) for _, m, n in rows.collect()))
    assert [r.experiment_name for r in got.where("metric = 'f1'").orderBy("rank").collect()] == [n for _, n in want]
    assert [tuple(r) for r in got.where("metric IS NULL OR metric = 'g'").select("metric", "experiment_name", "rank").orderBy("metric", "rank").collect()] == [(None, "y", 1), (None, "x", 2), ("g", "b", 1), ("g", "c", 2), ("g", "a", 3)]
    # No task had more than a few of the metric's rows.
    dealt = got.where("metric = 'f1'").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(dealt) > 3 and max(r["count"] for r in dealt) < 2000


# ---- statistics -----------------------------------------------------------------------------------------------------


def expected(values):
    values = [v for v in values if v is not None]
    if not values:
        return (None,) * 5
    order = sorted(values, key=lambda v: (math.isnan(v), v))
    nan = not all(map(math.isfinite, values))
    mean = float("nan") if nan else statistics.fmean(values)
    std = float("nan") if nan else statistics.pstdev(values)
    return mean, std, order[0], order[-1], (order[(len(order) - 1) // 2] + order[len(order) // 2]) / 2


def same(a, b):
    return a is None and b is None or a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def test_medians_of_hard_groups(spark):
    rng = random.Random(4)
    groups = {
        "normal": [rng.gauss(0, 1) for _ in range(3001)],
        "even": [rng.random() for _ in range(3000)],
        "ties": [float(rng.randint(0, 2)) for _ in range(3000)],
        "halves": [0.0] * 1500 + [1.0] * 1500,
        "one": [7.5],
        "same": [3.0] * 2500,
        "scales": [10.0 ** rng.randint(-300, 300) for _ in range(2500)],
        "nan": [rng.random() for _ in range(900)] + [float("nan")] * 950,
        "some nan": [rng.random() for _ in range(2000)] + [float("nan")] * 40,
        "infinite": [float("inf")] * 300 + [float("-inf")] * 200 + [float(i) for i in range(700)],
        "skew": [0.0] * 2999 + [rng.random()],
        None: [rng.random() for _ in range(2000)] + [None] * 50,
        "none": [None, None],
    }
    rows = [(g, k, v) for g, own in groups.items() for k, v in enumerate(own)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k long, value double").repartition(6).cache()
    got = {r.g: tuple(r)[1:] for r in states.exact_medians(df, states.states(df, ["g"]), ["g"], few=40).collect()}
    assert set(got) == set(groups) - {"none"}
    for g, (median,) in got.items():
        assert same(median, expected(groups[g])[4]), g
    finite = df.where("g NOT IN ('infinite', 'scales')")
    for r in states.five_stats(finite, ["g"]).collect():
        assert all(map(same, (r.mean, r.std, r.min, r.max, r.median), expected(groups[r.g]))), r


def test_batches_merge_without_reading_them_again(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 1009 / 7.0).alias("value"), (F.col("id") % 10).alias("b"))
    path = str(tmp_path / "states")
    for b in range(10):
        states.append(df.where(F.col("b") == b), ["g"], path, str(b))
    states.append(df.where("b = 3"), ["g"], path, "3")  # a repeated batch counts once
    merged = states.current(spark, path, ["g"])
    by_states = {r.g: r for r in states.statistics(merged, ["g"]).collect()}
    for r in states.five_stats(df, ["g"], of=merged).collect():
        own = [x.value for x in df.where(F.col("g") == r.g).collect()]
        assert all(map(same, (r.mean, r.std, r.min, r.max, r.median), expected(own)))
        assert by_states[r.g].n == len(own) and same(by_states[r.g].std, r["std"])
        assert abs(sum(v <= by_states[r.g].median for v in own) / len(own) - 0.5) < 0.03
