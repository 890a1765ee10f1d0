"""What an engine keeps, lists and deletes; lines left out; prompts that can't be filled."""

import json

import pytest

from corvane import cli
from corvane.engine import Engine
from corvane.operators import prompts, prune
from corvane.sources import readers

CONFIG = {
    "setups": {"s": {"dataset": {"jsonl_file": "s.jsonl"}, "prompt_fields": {"question_fields": ["q", "c.n"], "answer_field": "a"}, "prune_row": {"c.n": [""]}}},
    "prompts": {"fits": {"mode": "zero-shot", "compatible_setup": "s", "template": "{} {}", "description": "two places"}, "lost": {"compatible_setup": "none", "template": "{}"}},
    "models": {"m": {}, "tuned": {"finetuned": True, "base_model": "m", "tune_name": "t"}},
}


@pytest.fixture
def engine(spark, tmp_path):
    for name, content in CONFIG.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
    rows = [{"q": f"q{i}", "c": {} if i == 1 else {"n": "" if i == 2 else "x"}, "a": "yes"} for i in range(4)]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, rows)) + '\n\n{"q": \nplain words\n')
    return Engine(spark, str(tmp_path), f"file://{tmp_path}", f"file://{tmp_path}/out")


def test_a_dataset_is_numbered_once(engine):
    assert engine.dataset("s") is engine.dataset("s") and engine.pruned("s") is engine.pruned("s")
    kept = engine.dataset("s")
    engine.forget()
    assert engine.dataset("s") is not kept


def test_a_missing_key_is_not_an_empty_cell(engine):
    assert sorted(r.q for r in engine.pruned("s").collect()) == ["q0", "q1", "q3"]
    flat = engine.spark.createDataFrame([("a",), ("",), (None,)], "q string")
    assert prune.kept(flat, {"q": [""]}, ["q"]).count() == 1


def test_malformed_lines(engine, tmp_path):
    path = f"file://{tmp_path}/s.jsonl"
    assert sorted(r.line for r in readers.malformed_lines(engine.spark, path).collect()) == ["plain words", '{"q": ']
    with pytest.warns(UserWarning, match="2 malformed"):
        assert readers.read_jsonl(engine.spark, path, warn=True).count() == 4


def test_csv_without_newlines_in_fields(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\n2,NA\n")
    path = f"file://{tmp_path}/x.csv"
    both = [readers.read_csv(spark, path, multi_line=m).orderBy("a").collect() for m in (True, False)]
    assert both[0] == both[1] and both[0][1].b is None


def test_prompts_that_cannot_be_filled(engine):
    df = engine.dataset("s")
    good = prompts.batch(df, engine.prompts["fits"], ["q", "c.n"], "a").orderBy("row_idx").collect()
    assert [r.prompt for r in good] == ["q0 x", "q1 ", "q2 ", "q3 x"] and all(r.success and r.error is None for r in good)
    bad = prompts.batch(df, engine.prompts["fits"], ["q"], "a").collect()
    assert len(bad) == 4 and not any(r.success or r.prompt for r in bad) and "2 places" in bad[0].error
    shot = prompts.Prompt("p", prompts.FEW_SHOT, "s", "{}", "{} {}")
    assert prompts.batch(df, shot, ["q"], "a").count() == 0


def test_listings_status_and_cleanup(engine, spark, tmp_path, capsys):
    call = lambda *a: cli.main(["--config", str(tmp_path), "--data", f"file://{tmp_path}", "--output", f"file://{tmp_path}/out", *a], spark)
    assert engine.prompt_requirements("fits")["places"] == 2 and engine.prompt_requirements("fits")["problems"] == []
    with pytest.raises(ValueError):
        engine.prompt_requirements("none")
    assert list(engine.finetuned_models()) == ["tuned"] and engine.finetuned_models()["tuned"]["base_model"] == "m"
    assert call("list-prompts", "--details") == 0 and call("finetune", "models") == 0
    out = capsys.readouterr().out
    assert "two places" in out and "unknown setup none" in out and '"base_model": "m"' in out
    spark.range(3).write.parquet(f"file://{tmp_path}/out/responses")
    stored = engine.status()
    assert stored["datasets"] == 1 and stored["responses"] > 0 and stored["training"] == 0
    assert call("cleanup", "--dry-run") == 0 and engine.status() == stored
    assert call("cleanup", "--target", "responses") == 0 and engine.status()["responses"] == 0
    assert (tmp_path / "s.jsonl").exists() and call("status") == 0
    with pytest.raises(ValueError):
        engine.cleanup(["datasets"])
    for name in ("help", "list-commands", "show-commands"):
        assert call(name) == 0
    assert "run-experiment" in capsys.readouterr().out


def test_evaluation_documents(spark, tmp_path):
    stats = {"mean": 0.5, "std": 0.1, "min": 0.0, "max": 1.0, "median": 0.5}
    found = {"batch_name": "e1", "setup_name": "s", "num_samples": 4, "num_valid_evaluations": 3, "num_failed_generation": 1, "aggregated_scores": {"f1": stats, "em": stats}}
    (tmp_path / "evaluation_e1.json").write_text(json.dumps(found))
    (tmp_path / "evaluation_e2.json").write_text(json.dumps({k: v for k, v in found.items() if k != "batch_name"}, indent=1))
    (tmp_path / "evaluation_torn.json").write_text('{"batch_name": ')
    (tmp_path / "other.json").write_text(json.dumps(found))
    rows = readers.read_evaluations(spark, f"file://{tmp_path}").collect()
    assert sorted((r.experiment_name, r.metric) for r in rows) == [("e1", "em"), ("e1", "f1"), ("e2", "em"), ("e2", "f1")]
    assert {(r.num_samples, r.num_valid, r.num_failed, r["mean"], r.median) for r in rows} == {(4, 3, 1, 0.5, 0.5)}
