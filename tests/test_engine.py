"""An experiment from configuration files to a summary, by the engine and by its commands."""

import json
import sys
import types

import pytest
from corvane import cli
from corvane.engine import Engine
from corvane.functions.registry import MetricRegistry
from corvane.plans import grid

CONFIG = {
    "setups": {
        "yesno": {"dataset": {"csv_file": "yesno.csv"}, "prompt_fields": {"question_fields": ["question"], "answer_field": "answer"}, "prune_row": {"answer": [""]}},
        "pubmedqa_reasoning_free": {"dataset": {"jsonl_file": "med.jsonl"}, "prompt_fields": {"question_fields": ["question", "json:context.contexts[*]"], "answer_field": "final"}},
    },
    "prompts": {
        "ask": {"mode": "zero-shot", "compatible_setup": "yesno", "template": "Q: {}\n"},
        "ask_shot": {"mode": "few-shot", "compatible_setup": "yesno", "template": "Q: {}\n", "few_shot_example": "Q: {} A: {}\n"},
        "med": {"mode": "zero-shot", "compatible_setup": "pubmedqa_reasoning_free", "template": "{} given {}"},
        "broken": {"mode": "zero-shot", "compatible_setup": "yesno", "template": "no place"},
    },
    "models": {"m1": {}, "m2": {}},
    "finetunes": {"tune": {"setup": "yesno", "prompt": "ask", "training_config": {"max_samples": 10, "train_test_split": 0.8, "validation_split": 0.1}}},
}


def make_load():
    """A stub: one model says yes, the other repeats the prompt and says no. Made here, so that it travels to the workers by value."""

    def load(model):
        return (lambda prompt: "yes") if model == "m1" else (lambda prompt: prompt + " no ")

    return load


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    root = tmp_path_factory.mktemp("engine")
    (root / "configs").mkdir()
    (root / "data").mkdir()
    for name, content in CONFIG.items():
        (root / "configs" / f"{name}.json").write_text(json.dumps(content))
    rows = [f"question {i},{'' if i == 3 else 'yes' if i % 2 else 'no'}" for i in range(20)]
    (root / "data" / "yesno.csv").write_text("question,answer\n" + "\n".join(rows) + "\n")
    meds = [json.dumps({"question": f"q{i}", "context": {"contexts": ["a", "b"]}, "final": "yes"}) for i in range(4)]
    (root / "data" / "med.jsonl").write_text("\n".join(meds) + "\n\nbroken\n")
    return root


@pytest.fixture(scope="module")
def engine(spark, folders):
    return Engine(spark, str(folders / "configs"), f"file://{folders}/data", f"file://{folders}/out")


def test_engine(engine):
    assert engine.pruned("yesno").count() == 19
    assert [r.question for r in engine.dataset("yesno").orderBy("row_idx").limit(2).collect()] == ["question 0", "question 1"]
    assert all(r.valid for r in engine.validate_fields("pubmedqa_reasoning_free").collect())
    assert engine.profile("yesno").first().n_rows == 20
    problems = engine.prompt_problems()
    assert problems["ask"] == problems["ask_shot"] == problems["med"] == [] and problems["broken"]
    shot = engine.rendered("ask_shot", 3, row=3).collect()
    assert len(shot) == 3 and all(r.prompt.startswith("Q: question 3 A: N/A\nQ: question ") for r in shot)
    assert engine.rendered("med", 10).orderBy("row_idx").first().prompt == "q0 given a b"
    with pytest.raises(ValueError):
        engine.plan(models=["none"])
    with pytest.raises(ValueError):
        engine.fields("none")
    rows = engine.training_set("tune", "text").collect()
    assert len(rows) == 10 and rows[0].text.startswith("### Human: Q: question")


def test_experiments(engine):
    planned = engine.plan(prompt_names=["ask", "med"], size=8)
    assert planned.count() == 4
    engine.save(engine.run(planned, make_load(), 8))
    saved = engine.responses()
    assert saved.count() == 2 * 8 + 2 * 4 and {r.response for r in saved.select("response").distinct().collect()} == {"yes", "no"}
    assert engine.plan(prompt_names=["ask", "med"], size=8, skip=True).isEmpty()
    stats = engine.evaluated()
    mean = {(r.prompt, r.model, r.metric): r["mean"] for r in stats.collect()}
    assert mean["med", "m1", "exact_match"] == mean["med", "m1", "answer_correctness"] == 1.0
    assert mean["med", "m2", "answer_correctness"] == 0.0 and mean["med", "m2", "strict_format_compliance"] == 1.0
    assert mean["ask", "m1", "exact_match"] + mean["ask", "m2", "exact_match"] == 1.0
    tables = engine.summarised(stats)
    assert tables["counts"].first().total_experiments == 4
    best = {r.metric: r.model for r in tables["best"].collect()}
    assert best["answer_correctness"] == "m1"
    assert tables["heat_map"].count() == 2


def test_commands(spark, folders, capsys):
    base = ["--config", str(folders / "configs"), "--data", f"file://{folders}/data", "--output", f"file://{folders}/cli"]
    call = lambda *a: cli.main([*base, *a], spark)
    sys.modules["corvane_stub"] = types.ModuleType("corvane_stub")
    sys.modules["corvane_stub"].load = make_load()
    assert call("run-experiment", "--generator", "corvane_stub:load", "--setup", "pubmedqa_reasoning_free", "--model", "m1,m2", "--size", "3") == 0
    assert call("evaluate") == 0 and call("summary") == 0
    assert call("show-prompt", "--prompt", "ask", "--row", "0") == 0
    assert call("validate-prompts") == 1 and call("validate-prompts", "--prompt", "ask") == 0
    assert call("list-prompts", "--mode", "few-shot") == 0 and call("inspect-prompt", "--prompt", "med") == 0
    for action in ("list", "status", "validate"):
        assert call("dataset", action, "--setup", "yesno") == 0
    assert call("finetune", "list") == 0 and call("finetune", "prepare", "--name", "tune") == 0 and call("list-options") == 0
    assert "ask_shot" in capsys.readouterr().out


def test_configuration_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Engine(spark, str(tmp_path))
    for text in ("{", "[]"):
        (tmp_path / "setups.json").write_text(text)
        with pytest.raises(ValueError):
            Engine(spark, str(tmp_path))


def test_names_of_commands():
    assert cli._names(["a,b", "c d"]) == ["a", "b", "c", "d"]
    assert cli._names(["all"]) is None and cli._names(None) is None and cli._names("x") == ["x"]
    args = cli.parser().parse_args(["run-experiment", "--generator", "m:f", "--model", "one", "two", "--setup", "all", "--few-shot-row", "3"])
    assert (args.model, args.setup, args.few_shot_row) == (["one", "two"], ["all"], 3)


def test_example_row_in_names(spark):
    models = spark.createDataFrame([("m", 0)], "model string, ord int")
    found = spark.createDataFrame([("s", "p", "zero-shot", 0), ("s", "q", "few-shot", 1)], "setup string, prompt string, mode string, at int")
    names = {r.experiment_name for r in grid.plan(models, found, size=5, few_shot_row=12).collect()}
    assert names == {"s__m__zero-shot__p__5__0p100", "s__m__few-shot-12__q__5__0p100"}
    with pytest.raises(ValueError):
        grid.plan(models, found, few_shot_row=-1)


def test_similarity_and_functions_in_an_evaluation(spark):
    engine = Engine.__new__(Engine)
    engine.registry = MetricRegistry()
    engine.registry.register("size", lambda r: len(r["response"]))
    rows = [("e", "none", "p", "m", 0, "ab", "ab", True), ("e", "none", "p", "m", 0, "b", "a", True), ("e", "none", "p", "m", None, "a", "a", False)]
    df = spark.createDataFrame(rows, "experiment_name string, setup string, prompt string, model string, row_idx long, response string, expected_output string, success boolean")
    embedder = lambda: lambda texts: [[float("a" in t), float("b" in t)] for t in texts]
    found = {r.metric: (r["mean"], r["max"]) for r in engine.evaluated(df, with_ngrams=False, load_embedder=embedder).collect()}
    assert found["semantic_similarity"] == pytest.approx((0.5, 1.0))
    assert found["size"] == (1.5, 2.0) and found["exact_match"] == (0.5, 1.0)
