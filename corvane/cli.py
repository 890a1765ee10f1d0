"""Commands over an engine: python -m corvane.cli --config DIR COMMAND ..."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame, SparkSession

from .engine import DEFAULT_SIZE, DEFAULT_TEMPERATURE, STORED, Engine
from .sources import sinks
from .sources.download import fetch_datasets


def _names(given: list[str] | str | None) -> list[str] | None:
    """Names parted by blanks or commas; None for ``all`` or none."""
    out = [x for text in ([given] if isinstance(given, str) else given or []) for x in text.replace(",", " ").split()]
    return None if out in ([], ["all"]) else out


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corvane")
    out.add_argument("--config", default="configs")
    out.add_argument("--data", default="datasets")
    out.add_argument("--output", default="outputs")
    commands = out.add_subparsers(dest="command", required=True)

    run = commands.add_parser("run-experiment", help="ask models and store their responses")
    run.add_argument("--generator", required=True, help="module:function; the function takes a model's name and returns a function from prompt to text")
    for name in ("model", "setup", "prompt"):
        run.add_argument(f"--{name}", nargs="+", help="names, or all")
    run.add_argument("--mode")
    run.add_argument("--few-shot-row", type=int, help="the example row of few-shot prompts")
    run.add_argument("--size", type=int, default=DEFAULT_SIZE)
    run.add_argument("--temperature", type=float, default=DEFAULT_TEMPERATURE)
    run.add_argument("--force", action="store_true")
    run.add_argument("--skip", action="store_true")

    commands.add_parser("evaluate", help="score stored responses").add_argument("--experiment")
    commands.add_parser("summary", help="means, best experiments and the tables behind plots")
    show = commands.add_parser("show-prompt", help="a rendered prompt")
    show.add_argument("--prompt", required=True)
    show.add_argument("--row", type=int)
    commands.add_parser("validate-prompts", help="prompts that don't fit their setups").add_argument("--prompt")
    listed = commands.add_parser("list-prompts", help="prompts with setup and mode")
    listed.add_argument("--mode")
    listed.add_argument("--details", action="store_true", help="with field paths and problems")
    commands.add_parser("inspect-prompt", help="a prompt's template and problems").add_argument("--prompt", required=True)
    commands.add_parser("download-datasets", help="fetch the files that datasets link to").add_argument("--setup")
    dataset = commands.add_parser("dataset", help="datasets of the setups")
    dataset.add_argument("action", choices=["list", "status", "validate"])
    dataset.add_argument("--setup")
    tune = commands.add_parser("finetune", help="training sets")
    tune.add_argument("action", choices=["prepare", "list", "models"])
    tune.add_argument("--name")
    tune.add_argument("--style", default="messages")
    commands.add_parser("list-options", help="setups, prompts and models")
    commands.add_parser("status", help="entries of the configuration and stored files")
    clean = commands.add_parser("cleanup", help="delete stored results")
    clean.add_argument("--target", nargs="+", default=["all"], help=f"{', '.join(STORED)}, or all")
    clean.add_argument("--dry-run", action="store_true")
    for name in ("list-commands", "show-commands", "help"):
        commands.add_parser(name, help="all commands and their arguments")
    return out


def _show(df: DataFrame, rows: int = 100) -> None:
    df.show(rows, truncate=60)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command in ("list-commands", "show-commands", "help"):
        print(described())
        return 0
    spark = spark or SparkSession.builder.appName("corvane").getOrCreate()
    engine = Engine(spark, args.config, args.data, args.output)
    return COMMANDS[args.command](engine, args)


def run_experiment(engine: Engine, args) -> int:
    module, function = args.generator.split(":")
    load = getattr(importlib.import_module(module), function)
    planned = engine.plan(_names(args.model), _names(args.setup), _names(args.prompt), args.mode, args.size, args.temperature, args.force, args.skip, args.few_shot_row)
    _show(planned.select("experiment_name").orderBy("experiment_name"))
    if planned.isEmpty():
        return 1
    engine.save(engine.run(planned, load, args.size, args.few_shot_row))
    return 0


def evaluate(engine: Engine, args) -> int:
    stats = engine.evaluated(experiments=_names(args.experiment))
    stats.write.mode("overwrite").parquet(f"{engine.output_dir}/evaluations")
    _show(stats.orderBy("experiment_name", "metric"))
    return 0


def summary(engine: Engine, args) -> int:
    stats = engine.spark.read.parquet(f"{engine.output_dir}/evaluations")
    tables = engine.summarised(stats)
    for name, df in tables.items():
        print(name)
        _show(df)
    sinks.summary_document(tables["means"], tables["best"], tables["counts"]).write.mode("overwrite").text(f"{engine.output_dir}/summary")
    return 0


def show_prompt(engine: Engine, args) -> int:
    print(engine.rendered(args.prompt, 1, args.row).first()["prompt"])
    return 0


def validate_prompts(engine: Engine, args) -> int:
    problems = engine.prompt_problems()
    wanted = _names(args.prompt) or list(problems)
    for name in wanted:
        print(name, "; ".join(problems[name]) or "ok")
    return int(any(problems[n] for n in wanted))


def described() -> str:
    """Every command with its usage."""
    (commands,) = (a for a in parser()._actions if isinstance(a, argparse._SubParsersAction))
    return "\n".join(p.format_help() for p in commands.choices.values())


def list_prompts(engine: Engine, args) -> int:
    if args.details:
        for name, p in engine.prompts.items():
            if args.mode in (None, p.mode):
                print(name, p.description)
                print(json.dumps(engine.prompt_requirements(name) if p.setup in engine.setups else {"problems": engine.prompt_problems()[name]}, indent=1))
        return 0
    _show(engine.prompt_table(args.mode))
    return 0


def inspect_prompt(engine: Engine, args) -> int:
    p = engine.prompts[args.prompt]
    print(p.name, p.mode, p.setup, p.few_shot_example + p.template, "; ".join(engine.prompt_problems()[p.name]) or "ok", sep="\n")
    return 0


def download_datasets(engine: Engine, args) -> int:
    found = fetch_datasets(engine.setups, engine.data_dir, _names(args.setup))
    for name, what in found.items():
        print(name, what)
    return int(any(what.startswith("failed") for what in found.values()))


def dataset(engine: Engine, args) -> int:
    for setup in _names(args.setup) or engine.setups:
        if args.action == "list":
            print(setup, engine.setups[setup].get("dataset", {}))
        elif args.action == "status":
            _show(engine.profile(setup))
        else:
            _show(engine.validate_fields(setup))
    return 0


def finetune(engine: Engine, args) -> int:
    if args.action == "list":
        for name in engine.finetunes:
            print(name, engine.training_request(name))
        return 0
    if args.action == "models":
        for name, found in engine.finetuned_models().items():
            print(name, json.dumps(found))
        return 0
    engine.training_set(args.name, args.style).write.mode("overwrite").json(f"{engine.output_dir}/training/{args.name}")
    return 0


def list_options(engine: Engine, args) -> int:
    for name, known in (("setups", engine.setups), ("prompts", engine.prompts), ("models", engine.models)):
        print(name, *known)
    return 0


def status(engine: Engine, args) -> int:
    for what, n in engine.status().items():
        print(what, n)
    return 0


def cleanup(engine: Engine, args) -> int:
    for kind, n in engine.cleanup(_names(args.target), args.dry_run).items():
        print(kind, n, "files" if args.dry_run else "files deleted")
    return 0


COMMANDS = {"run-experiment": run_experiment, "evaluate": evaluate, "summary": summary, "show-prompt": show_prompt, "validate-prompts": validate_prompts, "list-prompts": list_prompts, "inspect-prompt": inspect_prompt, "download-datasets": download_datasets, "dataset": dataset, "finetune": finetune, "list-options": list_options, "status": status, "cleanup": cleanup}


if __name__ == "__main__":
    raise SystemExit(main())
