"""Paths, pruning, sampling, prompts, training sets, sources and sinks."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from corvane.operators import paths, prompts, prune, sampling, training
from corvane.sources import readers, sinks
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


# ---- paths ---------------------------------------------------------------------------------------------------


def test_path_grammar():
    assert paths.Path.parse("a.b[2].c") == paths.Path("a", ("b", 2, "c"), False)
    assert paths.Path.parse("json:a.b[*].c") == paths.Path("a", ("b", "*", "c"), True)
    assert paths.Path.parse("json:a") == paths.Path("a", (), True)
    assert paths.Path.parse("a..b") == paths.Path("a", ("b",), False)
    assert paths.Path.parse("") == paths.Path(None, (), False)


@given(st.text(alphabet="ab.[]0*:", max_size=12))
def test_path_parser_takes_anything(text):
    paths.Path.parse(text)


def test_paths_in_json_text(spark):
    rows = [('{"c":[{"t":"x"},{"t":null},{"t":"y"}],"n":{"m":[1,2]},"s":"z"}',), ('{"c":[{"t":"x"}]}',), ('{"c":[]}',), ("no json",), (None,), ('["a","b"]',)]
    df = spark.createDataFrame(rows, "j string")
    get = lambda p: [r[0] for r in df.select(paths.resolve(df.schema, p)).collect()]
    assert get("json:j.c[*].t") == ["x y", "x", None, None, None, None]
    assert get("json:j.n.m[1]") == ["2", None, None, None, None, None]
    assert get("json:j.n.m[7]") == [None] * 6
    assert get("json:j.s") == ["z"] + [None] * 5
    assert get("json:missing.s") == [None] * 6
    assert json.loads(get("json:j")[1]) == {"c": [{"t": "x"}]}
    assert get("json:j")[3:5] == [None, None]


def test_paths_in_nested_columns(spark):
    df = spark.createDataFrame([(1, {"contexts": ["a", None, "b"]}, [{"k": "v"}], {"x": 1}), (2, None, None, None)], "id int, context struct<contexts:array<string>>, items array<struct<k:string>>, m map<string,int>")
    get = lambda p: [r[0] for r in df.select(paths.resolve(df.schema, p)).collect()]
    assert get("json:context.contexts[*]") == ["a b", None]
    assert get("context.contexts[0]") == ["a", None]
    assert get("context.contexts[5]") == [None, None]
    assert get("items[0].k") == ["v", None]
    assert get("items[*].k") == ["v", None]
    assert get("m.x") == ["1", None] and get("m.y") == [None, None]
    assert get("id") == ["1", "2"] and get("nothing") == [None, None] and get("id.deeper") == [None, None]
    assert [r[0] for r in df.select(paths.extract(df.schema, ["id", "nothing"])).collect()] == [["1", ""], ["2", ""]]


def test_path_validation(spark):
    df = spark.createDataFrame([("x", '{"a":1}')], "s string, j string")
    got = {r.path: (r.valid, r.is_json, r.preview) for r in paths.validate(df, ["s", "json:j.a", "json:j.b", "none"]).collect()}
    assert got == {"s": (True, False, "x"), "json:j.a": (True, True, "1"), "json:j.b": (False, True, None), "none": (False, False, None)}
    assert paths.json_inventory(["s", "json:j.a"]) == {"json": ["json:j.a"], "regular": ["s"], "columns": ["j"]}


def test_names_and_echo(spark):
    df = spark.createDataFrame([("s", "m", "few-shot", "p", 50, 0.1, 7, "Say hi", "Say hi \n there"), ("s", "m", "zero-shot", "p", 5, 1.0, None, "Say hi", "there")], "s string, m string, mode string, p string, n int, t double, row int, prompt string, r string")
    names = df.select(paths.experiment_name(F.col("s"), F.col("m"), F.col("mode"), F.col("p"), F.col("n"), F.col("t"), F.col("row")), paths.without_echo(F.col("r"), F.col("prompt"))).collect()
    assert [tuple(r) for r in names] == [("s__m__few-shot-7__p__50__0p100", "there"), ("s__m__zero-shot__p__5__1p000", "there")]
    files = spark.createDataFrame([("/x/inference_a__b.json",), ("evaluation_c.json",)], "f string")
    assert [r[0] for r in files.select(paths.name_of_file(F.col("f"))).collect()] == ["a__b", "c"]


# ---- pruning --------------------------------------------------------------------------------------------------


def test_pruning(spark):
    df = spark.createDataFrame([(0, "keep", "yes"), (1, "", "yes"), (2, None, "yes"), (3, "NA", "yes"), (4, "keep", "drop me"), (5, "NA", "drop me")], "row_idx long, q string, a string")
    rules = {"q": ["", "NA"], "a": ["regex:^drop"]}
    reasons = {r.row_idx: r.prune_reason for r in prune.with_reason(df, rules, ["q"], "a").collect()}
    assert reasons[0] is None
    assert "'q'" in reasons[1] and "'q'" in reasons[2] and "'a'" in reasons[4] and "'q'" in reasons[5]  # the first rule says why
    assert {r.row_idx for r in prune.kept(df, rules, ["q"], "a").collect()} == {0}
    assert {r.row_idx for r in prune.kept(df, rules, ["q"], "a", null_as="nan").collect()} == {0, 2}
    every = {r.row_idx: r.prune_reason for r in prune.with_reason(df, {"q": ["NA"], "*": ["regex:drop"]}, ["q"], "a").collect()}
    assert every[5].startswith("any field") and every[3].startswith("field 'q'")
    counted = prune.accounting(prune.with_reason(df, rules, ["q"], "a"), "row_idx", 2).first()
    assert (counted.n_rows, counted.n_pruned, counted.n_kept, len(counted.reasons)) == (6, 5, 1, 2)
    assert prune.kept(df, {}, ["q"]).count() == 6
    assert prune.kept(df, {"none": [""]}, ["q"]).count() == 6  # a field that isn't there matches nothing
    with pytest.raises(ValueError):
        prune.kept(df, {"q": ["regex:("]}, ["q"])
    with pytest.raises(ValueError):
        prune.kept(df, {"q": [""]}, ["q"], null_as="x")


# ---- sampling ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def numbered(spark):
    return sampling.with_row_index(spark.range(0, 600, 1, 4).select((F.lit(1000) - F.col("id")).alias("key")), "key")


def test_row_index(numbered):
    rows = sorted((r.row_idx, r.key) for r in numbered.collect())
    assert rows == list(enumerate(range(401, 1001)))


def test_sample_is_that_of_pandas(numbered):
    frame = pd.DataFrame({"key": range(401, 1001)})
    want = frame.sample(n=50, random_state=42)["key"].tolist()
    got = [r.key for r in sampling.sample(numbered, 50).orderBy("sample_idx").collect()]
    assert got == want
    assert sampling.sample(numbered, 1000).count() == 600
    assert sampling.hash_sample(numbered, "key", 20).count() == 20


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 300), st.integers(0, 50), st.integers(0, 2**31))
def test_sample_indices(n_rows, n, seed):
    got = sampling.sample_indices(n_rows, n, seed)
    assert len(got) == min(n, n_rows) == len(set(got))
    assert got == np.random.RandomState(seed).permutation(n_rows)[:n].tolist()


def test_few_shot_row():
    assert sampling.few_shot_index(1000) == 654


def test_splits(numbered):
    # Sizes on record for real runs.
    assert [sampling.split_sizes(*x) for x in [(470, 0.8, 0.1), (115, 0.8, 0.1), (500, 0.85, 0.1), (500, 0.8, 0.15)]] == [(376, 47), (92, 11), (425, 50), (400, 75)]
    assert sampling.split_sizes(5, 0.8, 0.1) == (4, 1)
    order = list(range(600))
    random.Random(42).shuffle(order)
    got = {r.row_idx: r.split for r in sampling.split(numbered, 0.8, 0.15).collect()}
    assert [got[i] for i in order] == ["train"] * 480 + ["validation"] * 90 + ["unused"] * 30
    parts = {r["split"]: r["count"] for r in sampling.hash_split(numbered, "key", 0.8, 0.1).groupBy("split").count().collect()}
    assert sum(parts.values()) == 600 and parts["train"] > 430


def test_head_tail_row(numbered):
    assert sorted(r.key for r in sampling.head(numbered, 3).collect()) == [401, 402, 403]
    assert sorted(r.key for r in sampling.tail(numbered, 2).collect()) == [999, 1000]
    assert sampling.row_at(numbered, 5).first().key == 406
    with pytest.raises(IndexError):
        sampling.row_at(numbered, -1)


# ---- prompts and training sets -----------------------------------------------------------------------------------


ZERO = prompts.Prompt("z", prompts.ZERO_SHOT, "s", "Q: {} / {}!")
FEW = prompts.Prompt("f", prompts.FEW_SHOT, "s", "Q: {} / {}!", "E: {} / {} = {}\n")


def test_prompts(spark):
    df = spark.createDataFrame([(0, "a", "b", "x"), (1, None, "d", None)], "row_idx long, q string, w string, a string")
    got = [tuple(r) for r in prompts.render(df, ZERO, ["q", "w"], "a").select("prompt", "expected_output", "question_values", "success").collect()]
    assert got == [("Q: a / b!", "x", ["a", "b"], True), ("Q:  / d!", "", ["", "d"], True)]
    shot = prompts.render(df, FEW, ["q", "w"], "a", df.where("row_idx = 1")).collect()
    assert [r.prompt for r in shot] == ["E:  / d = N/A\nQ: a / b!", "E:  / d = N/A\nQ:  / d!"]
    assert prompts.example(df.where("row_idx = 1"), ["q"], "a").first().example_doubtful is True
    with pytest.raises(ValueError):
        prompts.render(df, FEW, ["q", "w"], "a")
    with pytest.raises(ValueError):
        prompts.fill("{}", [])


def test_prompt_checks():
    assert ZERO.problems(["q", "w"], ["s"]) == []
    assert FEW.problems(["q", "w"], ["s"]) == []
    assert len(prompts.Prompt("x", "none", "t", "{}").problems(["q", "w"], ["s"])) == 3
    assert prompts.Prompt("x", prompts.FEW_SHOT, "s", "{}").problems(["q"], ["s"]) == ["no few-shot example"]


def test_chat_formats(spark):
    df = spark.createDataFrame([("p", "a")], "p string, a string")
    get = lambda s: df.select(prompts.chat_format(s, F.col("p"), F.col("a"))).first()[0]
    assert [tuple(x) for x in get("conversations")] == [("human", "p"), ("gpt", "a")]
    assert [tuple(x) for x in get("messages")] == [("user", "p"), ("assistant", "a")]
    assert get("text") == "### Human: p\n\n### Assistant: a"
    with pytest.raises(ValueError):
        get("other")


def test_training_sets(spark):
    df = spark.createDataFrame([(i, f"q{i}", "w", "  " if i % 10 == 9 else "drop" if i % 10 == 8 else f"a{i}") for i in range(100)], "row_idx long, q string, w string, a string")
    request = training.TrainingRequest("s", "z", max_samples=50, train=0.8, validation=0.1)
    made = training.examples(df, request, ZERO, ["q", "w"], "a", {"a": ["drop"]})
    rows = [r.row_index for r in made.orderBy("row_index").collect()]
    kept = [i for i in range(100) if i % 10 != 8][-50:]
    assert rows == [i for i in kept if i % 10 != 9]
    split = training.split_examples(made, request)
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert sizes["train"] == int(len(rows) * 0.8) and sizes["validation"] == int(len(rows) * 0.1)
    assert training.formatted(split, "text").first().text.startswith("### Human: Q: q")
    assert request.problems({"s": 1}, {"z": ZERO}) == []
    assert len(training.TrainingRequest("t", "y", 0, 0.9, 0.2).problems({"s": 1}, {"z": ZERO})) == 4


# ---- sources and sinks ---------------------------------------------------------------------------------------------


def test_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('id,text,note\n1,"two\nlines, ""quoted""",NA\n2,,N/A\n3,"",fine\n')
    got = [tuple(r) for r in readers.read_csv(spark, f"file://{path}").orderBy("id").collect()]
    assert got == [(1, 'two\nlines, "quoted"', None), (2, None, None), (3, None, "fine")]


def test_json_and_jsonl(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2, "y": "b"}]')
    (tmp_path / "o.json").write_text('{"x": 1}')
    (tmp_path / "s.json").write_text("3")
    (tmp_path / "l.jsonl").write_text('{"x": 1}\n\nbroken {\n{"x": 2}\n')
    (tmp_path / "e.jsonl").write_text("\n")
    at = lambda n: f"file://{tmp_path}/{n}"
    assert readers.read_json(spark, at("a.json")).count() == 2 and readers.read_json(spark, at("o.json")).count() == 1
    with pytest.raises(Exception):  # noqa: B017 the reader's own error or ours
        readers.read_json(spark, at("s.json")).collect()
    assert sorted(r.x for r in readers.read_jsonl(spark, at("l.jsonl")).collect()) == [1, 2]
    with pytest.raises(ValueError):
        readers.read_jsonl(spark, at("e.jsonl"))


def test_dispatch(spark):
    assert readers.dataset_file({"jsonl_file": "b.jsonl", "csv_file": "a.csv", "download_path": "D"}, "/root") == ("csv", "/root/D/a.csv")
    assert readers.dataset_file({"parquet_file": "p"}) == ("parquet", "p")
    with pytest.raises(ValueError):
        readers.dataset_file({})
    table = readers.config_table(spark, '{"a": {"mode": "zero-shot", "n": [1]}, "b": {}}', "prompt", ["mode", "n"])
    assert [tuple(r) for r in table.orderBy("ord").collect()] == [("a", "zero-shot", "[1]", 0), ("b", None, None, 1)]
    assert readers.config_table(spark, "", "x", ["y"], optional=True).count() == 0
    for bad in ("", "{", "[1]"):
        with pytest.raises(ValueError):
            readers.config_table(spark, bad, "x", ["y"])
    assert readers.in_chunks(spark.range(95), 10).rdd.getNumPartitions() == 10
    assert readers.preview(spark.range(95)).count() == 5


def test_documents_round_trip(spark, tmp_path):
    rows = [("e", "s", "p", "m", i, f"p{i}", f"r{i}", f"x{i}", ["a"], 0.5, i != 1, None) for i in range(3)]
    df = spark.createDataFrame(rows, "experiment_name string, setup string, prompt_name string, model string, row_idx long, prompt string, response string, expected_output string, question_values array<string>, processing_time double, success boolean, error string")
    docs = sinks.inference_documents(df)
    (tmp_path / "inference_e.json").write_text(docs.select(F.to_json(F.struct("*"))).first()[0])
    (tmp_path / "inference_bad.json").write_text("{")
    from corvane.plans import evaluate

    back = evaluate.paired(readers.read_inference(spark, f"file://{tmp_path}")).orderBy("pos").collect()
    assert [(r.experiment_name, r.response, r.expected_output, r.success) for r in back] == [("e", "r0", "x0", True), ("e", "r1", "x1", False), ("e", "r2", "x2", True)]
    df.withColumn("prompt", F.col("prompt_name")).transform(lambda d: sinks.write_responses(d, f"file://{tmp_path}/parquet") or d)
    assert spark.read.parquet(f"file://{tmp_path}/parquet/setup=s").count() == 3
