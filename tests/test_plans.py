"""Grids, evaluation, summaries, hooks, streams, and every registered query against DuckDB."""

import os

import duckdb
import pytest
from corvane.plans import evaluate, grid, inference, queries, summary
from corvane.streaming import live
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

TABLES = "documents embeddings pages benchmark labels conversations region nation customer supplier part orders lineitem events".split()


# ---- grids -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def dims(spark):
    prompts = spark.createDataFrame([("p1", "a", "zero-shot", 0), ("p2", "a", "few-shot", 1), ("p3", "b", None, 2), ("p4", None, "zero-shot", 3)], "prompt string, setup string, mode string, ord int")
    setups = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "setup string, ord int")
    models = spark.createDataFrame([("m1", 0), ("m2", 1)], "model string, ord int")
    return prompts, setups, models


@pytest.mark.parametrize(
    "wanted, names",
    [
        ({}, ["p1", "p2", "p3"]),
        ({"mode": "few-shot"}, ["p2"]),
        ({"wanted_prompts": ["p3", "p1", "p3", "p4"]}, ["p3", "p1"]),
        ({"wanted_prompts": ["p1", "p2"], "mode": "few-shot"}, ["p2"]),
        ({"wanted_prompts": ["p1", "p2"], "mode": "few-shot", "force": True}, ["p1", "p2"]),
        ({"wanted_setups": ["b", "a"]}, ["p3", "p1", "p2"]),
        ({"wanted_setups": ["a", "c"], "mode": "zero-shot"}, ["p1"]),
        ({"wanted_setups": ["a"], "wanted_prompts": ["p3", "p2"]}, ["p2"]),
        ({"wanted_setups": ["a"], "wanted_prompts": ["p3", "p2"], "force": True}, ["p3", "p2"]),
        ({"wanted_setups": ["a"], "wanted_prompts": ["p3", "p2", "p1"], "mode": "zero-shot"}, ["p1"]),
        ({"wanted_setups": ["a"], "wanted_prompts": ["p3", "p2", "p1"], "mode": "few-shot", "force": True}, ["p3", "p2", "p1"]),
    ],
)
def test_triplets(dims, wanted, names):
    prompts, setups, _ = dims
    assert [r.prompt for r in grid.triplets(prompts, setups, **wanted).orderBy("at").collect()] == names


def test_plan(dims):
    prompts, setups, models = dims
    planned = grid.plan(models, grid.triplets(prompts, setups))
    assert planned.count() == 6
    assert {r.n for r in grid.histograms(planned).where("dimension = 'model'").collect()} == {3}
    done = planned.where("model = 'm1'")
    assert grid.missing(planned, done).count() == 3
    assert grid.plan(models, grid.triplets(prompts, setups), ["m2"]).count() == 3
    assert [r.prompt for r in grid.unknown_references(prompts, setups).collect()] == ["p4"]
    assert {r.setup: r.prompts for r in grid.setup_prompts(prompts, setups).collect()} == {"a": ["p1", "p2"], "b": ["p3"]}


# ---- evaluation and summaries ------------------------------------------------------------------------------------


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(0, 1, allow_nan=False), min_size=1, max_size=12))
def test_five_stats(spark, values):
    import numpy as np

    row = evaluate.five_stats(spark.createDataFrame([("k", v) for v in values], "k string, value double"), ["k"]).first()
    assert [row[s] for s in evaluate.STATS] == pytest.approx([np.mean(values), np.std(values), min(values), max(values), np.median(values)], abs=1e-9)


def test_scores_and_counts(spark):
    df = spark.createDataFrame([(0, "e", "a b", "a b", True), (1, "e", "a", "b", True), (2, "e", "a", "a", False)], "i long, e string, response string, expected_output string, success boolean").withColumn("u", F.array(F.lit(1.0))).withColumn("v", F.array(F.lit(2.0)))
    scored = evaluate.scores(df, ["e", "i"], vectors=("u", "v"))
    rows = {r.i: r for r in scored.collect()}
    assert rows[0].bleu == rows[0].rouge1_f == rows[0].semantic_similarity == 1.0
    assert rows[2].rougeL_f == rows[2].semantic_similarity == 0.0 and rows[2].generation_failed == 1.0
    counted = evaluate.batch_counts(scored, ["e"]).first()
    assert (counted.num_samples, counted.num_valid, counted.num_failed) == (3, 2, 1)
    mean = {r.metric: r["mean"] for r in evaluate.aggregate(scored, ["e"]).collect()}
    assert mean["f1_score"] == 0.5 and mean["semantic_similarity"] == 1.0
    whole = evaluate.evaluate(df.withColumn("setup", F.lit("pubmedqa_reasoning_free")), queries.MetricRegistry(), ["setup", "e"], "i")
    assert {"f1_score", "bleu", "strict_format_compliance"} <= {r.metric for r in whole.collect()}


@pytest.fixture(scope="module")
def stats(spark):
    rows = [("e1", "s", "p", "m1", "f1_score", 0.5, 0), ("e2", "s", "p", "m2", "f1_score", 0.7, 1), ("e3", "t", "q", "m1", "f1_score", 0.7, 2), ("e4", "t", "q", "m3", "f1_score", float("nan"), 3), ("e1", "s", "p", "m1", "own", 0.1, 0), ("e5", "s", "p", "m1", "f1_score", 0.8, 4)]
    return spark.createDataFrame(rows, "experiment_name string, setup string, prompt string, model string, metric string, mean double, ord int")


def test_summaries(stats, spark):
    means = {(r.setup, r.model, r.metric): (r.num_experiments, r["mean"]) for r in summary.group_means(stats).where("NOT isnan(mean)").collect()}
    assert means["s", "m1", "f1_score"] == (2, 0.65) and means["t", "m1", "f1_score"] == (1, 0.7)
    best = {r.metric: (r.experiment_name, r.score) for r in summary.best_performers(stats.where("experiment_name <> 'e5'")).collect()}
    assert best == {"f1_score": ("e2", 0.7), "own": ("e1", 0.1)}  # the first of a tie; NaN never
    ranks = [(r.experiment_name, r["rank"]) for r in summary.ranked(stats.where("metric = 'f1_score' AND NOT isnan(mean)")).orderBy("rank").collect()]
    assert ranks == [("e5", 1), ("e2", 2), ("e3", 3), ("e1", 4)]
    row = summary.compared(stats, ["e1", "e2"]).where("metric = 'own'").first()
    assert (row.e1, row.e2, row.best) == (0.1, 0.0, "e1")
    heat = {r.model: (r.f1_score, r.own) for r in summary.heat_map(stats.where("NOT isnan(mean)"), ["f1_score", "own"]).collect()}
    assert heat["m2"] == (0.7, 0.0) and "m3" not in heat
    assert [r.metric for r in summary.custom_metrics(stats).collect()] == ["own"]
    assert [r.metric for r in summary.top_metrics(stats, 5).collect()] == ["f1_score", "own"]
    counted = summary.counts(stats).first()
    assert (counted.total_experiments, counted.total_prompts, counted.models) == (5, 2, ["m1", "m2", "m3"])
    flat = summary.flattened(summary.nested(summary.group_means(stats.where("NOT isnan(mean)"))))
    assert {(r.setup, r.prompt, r.model, r.metric, r["mean"]) for r in flat.collect()} == {(r.setup, r.prompt, r.model, r.metric, r["mean"]) for r in summary.group_means(stats.where("NOT isnan(mean)")).collect()}
    runs = spark.createDataFrame([(10, 9, 1), (5, 5, 0)], "num_samples int, num_valid int, num_failed int")
    session = summary.session_summary(stats.where("NOT isnan(mean)"), runs).first()
    assert (session.evaluations, session.num_samples, session.best_experiment) == (2, 15, "e5")
    assert summary.pruning_totals(spark.createDataFrame([(1, 4)], "n_pruned int, n_rows int")).first().rate == 25.0
    assert summary.pruning_totals(spark.createDataFrame([], "n_pruned int, n_rows int")).first().rate == 0.0
    assert tuple(summary.tallies(spark.createDataFrame([(True,), (None,), (False,)], "v boolean"), "v").first()) == (1, 2)


def test_sinks_of_summaries(stats, spark):
    import json

    from corvane.sources import sinks

    clean = stats.where("NOT isnan(mean)")
    text = sinks.summary_document(summary.group_means(clean), summary.best_performers(clean), summary.counts(clean)).first()[0]
    assert json.loads(text)["total_setups"] == 2
    full = evaluate.five_stats(clean.withColumnRenamed("mean", "value"), ["experiment_name", "metric"])
    counts = clean.groupBy("experiment_name", "setup").agg(F.lit(1).alias("num_samples"), F.lit(1).alias("num_valid"), F.lit(0).alias("num_failed"))
    doc = sinks.evaluation_documents(full, counts).where("batch_name = 'e1'").first()
    assert doc.aggregated_scores["own"]["mean"] == 0.1


# ---- hooks and streams ---------------------------------------------------------------------------------------------


def test_generation_and_embedding(spark):
    def load(model):
        if model == "broken":
            raise RuntimeError("Authentication failed")
        return lambda prompt: f"{model}:{prompt}"

    df = spark.createDataFrame([(1, "m", "a"), (2, "broken", "b")], "id long, model string, prompt string")
    got = {r.id: r for r in inference.generate(df, load).collect()}
    assert got[1].response == "m:a" and got[1].success
    assert got[2].response is None and not got[2].success and "Authentication" in got[2].error
    embedded = inference.embed(df, "prompt", lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert [list(r.embedding) for r in embedded.collect()] == [[1.0, 1.0]] * 2


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts")
    events.repartitionByRange(4, "ts").write.parquet(f"file://{tmp_path}/in")
    stream = live.read_stream(spark, f"file://{tmp_path}/in", events.schema)
    rate = live.success_rate(stream, "ts", F.col("event_type") == "purchase", late="1 hour")
    live.run_available(rate, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    closed = spark.read.parquet(f"file://{tmp_path}/out")
    assert not closed.isEmpty()
    batch = live.success_rate(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", F.col("event_type") == "purchase")
    assert closed.join(batch, ["window_start", "n", "n_success"], "left_anti").count() == 0


# ---- registered queries ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*[F.col(f"`{c}`") for c in columns]).collect())
    if name in queries.ORACLES:
        quoted = ", ".join('"' + c + '"' for c in columns)
        assert got == sorted(repr(r) for r in duck.sql(f"SELECT {quoted} FROM ({queries.ORACLES[name]})").fetchall())
    else:
        assert got
