"""Experiments from configuration files to summaries: the operators put together.

A configuration folder has ``setups.json``, ``prompts.json``, ``models.json``
and, if there is any fine-tuning, ``finetunes.json``; each is a dictionary of
named entries.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.registry import MetricRegistry
from .operators import paths, prompts, prune, sampling, training
from .plans import evaluate, grid, inference, summary
from .sources import readers, sinks

DEFAULT_SIZE, DEFAULT_TEMPERATURE = 50, 0.1
#: What an engine stores in its output folder.
STORED = ("responses", "evaluations", "summary", "training")


class Engine:
    def __init__(self, spark: SparkSession, config_dir: str, data_dir: str = "", output_dir: str = "", registry: MetricRegistry | None = None):
        self.spark, self.data_dir, self.output_dir = spark, data_dir, output_dir
        self.registry = registry or MetricRegistry()
        self._tables: dict[tuple[str, ...], DataFrame] = {}  # of the setups, numbered once
        load = lambda name, optional=False: self._load(Path(config_dir) / f"{name}.json", optional)
        self.setups, self.models = load("setups"), load("models")
        self.finetunes = load("finetunes", True)
        self.prompts = {n: prompts.Prompt(n, p.get("mode", prompts.ZERO_SHOT), p.get("compatible_setup", ""), p["template"], p.get("few_shot_example", ""), p.get("description", "")) for n, p in load("prompts").items()}

    @staticmethod
    def _load(path: Path, optional: bool) -> dict:
        if optional and not path.exists():
            return {}
        try:
            found = json.loads(path.read_text(encoding="utf-8"))
        except json.JSONDecodeError as e:
            raise ValueError(f"{path} is not valid JSON: {e}") from e
        if not isinstance(found, dict):
            raise ValueError(f"{path} must hold a dictionary")
        return found

    # ---- dimensions ------------------------------------------------------------------------------------------

    def _table(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def prompt_table(self, mode: str | None = None) -> DataFrame:
        rows = [(p.name, p.setup, p.mode, i) for i, p in enumerate(self.prompts.values()) if mode in (None, p.mode)]
        return self._table(rows, "prompt string, setup string, mode string, ord int")

    def setup_table(self) -> DataFrame:
        return self._table([(s, i) for i, s in enumerate(self.setups)], "setup string, ord int")

    def model_table(self) -> DataFrame:
        return self._table([(m, i) for i, m in enumerate(self.models)], "model string, ord int")

    def fields(self, setup: str) -> tuple[list[str], str]:
        """Question fields (a copy) and the answer field."""
        if setup not in self.setups:
            raise ValueError(f"unknown setup {setup}")
        found = self.setups[setup].get("prompt_fields", {})
        return list(found.get("question_fields", [])), found.get("answer_field", "")

    # ---- datasets --------------------------------------------------------------------------------------------

    def dataset(self, setup: str) -> DataFrame:
        """The rows of a setup's file, numbered from 0 in file order; read and numbered on the first call, until ``forget``."""
        if (setup,) not in self._tables:
            df = readers.read_ordered(self.spark, self.setups[setup]["dataset"], self.data_dir)
            self._tables[(setup,)] = sampling.with_row_index(df, "__order").drop("__order")
        return self._tables[(setup,)]

    def forget(self) -> None:
        """Read the datasets anew."""
        self._tables.clear()

    def marked(self, setup: str, null_as: str = "blank") -> DataFrame:
        questions, answer = self.fields(setup)
        return prune.with_reason(self.dataset(setup), self.setups[setup].get("prune_row", {}), questions, answer, null_as)

    def pruned(self, setup: str, null_as: str = "blank") -> DataFrame:
        """The rows that stay, numbered anew."""
        if (setup, null_as) not in self._tables:
            kept = self.marked(setup, null_as).where("prune_reason IS NULL").drop("prune_reason").withColumnRenamed(sampling.ROW, "source_row")
            self._tables[(setup, null_as)] = sampling.with_row_index(kept, "source_row")
        return self._tables[(setup, null_as)]

    def validate_fields(self, setup: str) -> DataFrame:
        questions, answer = self.fields(setup)
        return paths.validate(self.dataset(setup), [*questions, *([answer] if answer else [])])

    def profile(self, setup: str) -> DataFrame:
        return summary.profile(readers.read_dataset(self.spark, self.setups[setup]["dataset"], self.data_dir))

    def few_shot_row(self, setup: str) -> DataFrame:
        """The example row, drawn from the unpruned table."""
        rows = self.dataset(setup)
        return sampling.row_at(rows, sampling.few_shot_index(rows.count()))

    # ---- prompts ---------------------------------------------------------------------------------------------

    def rendered(self, prompt: str, size: int = DEFAULT_SIZE, row: int | None = None) -> DataFrame:
        """The prompts of a sample of the setup's rows; ``row`` names the few-shot example."""
        p = self.prompts[prompt]
        questions, answer = self.fields(p.setup)
        shown = None
        if p.mode == prompts.FEW_SHOT:
            shown = self.few_shot_row(p.setup) if row is None else sampling.row_at(self.dataset(p.setup), row)
        return prompts.render(sampling.sample(self.pruned(p.setup), size), p, questions, answer, shown)

    def prompt_problems(self) -> dict[str, list[str]]:
        """What is wrong with each prompt."""
        setups = list(self.setups)
        return {n: p.problems(self.fields(p.setup)[0] if p.setup in self.setups else [], setups) for n, p in self.prompts.items()}

    def prompt_requirements(self, prompt: str) -> dict:
        if prompt not in self.prompts:
            raise ValueError(f"unknown prompt {prompt}")
        p = self.prompts[prompt]
        return p.requirements(*self.fields(p.setup), list(self.setups))

    # ---- experiments -----------------------------------------------------------------------------------------

    def plan(self, models: list[str] | None = None, setups: list[str] | None = None, prompt_names: list[str] | None = None, mode: str | None = None, size: int = DEFAULT_SIZE, temperature: float = DEFAULT_TEMPERATURE, force: bool = False, skip: bool = False, few_shot_row: int | None = None) -> DataFrame:
        """The experiments to run; ``skip`` leaves out those that have responses already. ``few_shot_row`` is part of few-shot names."""
        for what, wanted, known in (("model", models, self.models), ("setup", setups, self.setups), ("prompt", prompt_names, self.prompts)):
            if unknown := [w for w in wanted or [] if w not in known]:
                raise ValueError(f"unknown {what}: {', '.join(unknown)}")
        found = grid.triplets(self.prompt_table(), self.setup_table(), setups, prompt_names, mode, force)
        planned = grid.plan(self.model_table(), found, models, size, temperature, few_shot_row)
        return grid.missing(planned, self.responses().select("experiment_name")) if skip and self.has_responses() else planned

    def run(self, planned: DataFrame, load: Callable[[str], Callable[[str], str]], size: int = DEFAULT_SIZE, few_shot_row: int | None = None) -> DataFrame:
        """Responses to all planned prompts in one plan; ``load(model)`` returns a function from prompt to text."""
        todo = planned.select("experiment_name", "setup", F.col("prompt").alias("prompt_name"), "model")
        asked = []
        for name in [r["prompt"] for r in planned.select("prompt").distinct().orderBy("prompt").collect()]:
            rows = self.rendered(name, size, few_shot_row).select(sampling.ROW, "prompt", "question_values", "expected_output", F.lit(name).alias("prompt_name"))
            asked.append(rows.join(F.broadcast(todo), "prompt_name"))  # the plan is a configuration's product
        if not asked:
            return self.spark.createDataFrame([], f"experiment_name string, setup string, prompt_name string, model string, row_idx long, prompt string, question_values array<string>, expected_output string, {inference.RESPONSE}")
        rows = reduce(DataFrame.unionByName, asked)
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        made = inference.generate(rows, load, tasks_per_model=-(-tasks // max(1, planned.select("model").distinct().count())))
        return made.withColumn("response", paths.without_echo(F.col("response"), F.col("prompt")))

    def _folder(self, kind: str) -> str:
        return f"{self.output_dir}/{kind}"

    def save(self, responses: DataFrame) -> None:
        sinks.write_responses(responses.withColumnRenamed("prompt", "prompt_text").withColumnRenamed("prompt_name", "prompt"), self._folder("responses"))

    def has_responses(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder("responses"))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def responses(self) -> DataFrame:
        return self.spark.read.parquet(self._folder("responses"))

    # ---- evaluation ------------------------------------------------------------------------------------------

    def evaluated(self, responses: DataFrame | None = None, experiments: list[str] | None = None, with_ngrams: bool = True, load_embedder: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None) -> DataFrame:
        """experiment_name, setup, prompt, model, metric and its five statistics.

        ``load_embedder()`` returns a function from texts to vectors; with it, semantic similarity is among the metrics.
        """
        rows = self.responses() if responses is None else responses
        rows = rows.where(F.col("experiment_name").isin(experiments)) if experiments else rows
        if load_embedder:
            rows = inference.embed(inference.embed(rows, "response", load_embedder, "__given"), "expected_output", load_embedder, "__expected")
            return evaluate.evaluate(rows, self.registry, ["experiment_name", "setup", "prompt", "model"], sampling.ROW, with_ngrams, ("__given", "__expected"))
        return evaluate.evaluate(rows, self.registry, ["experiment_name", "setup", "prompt", "model"], sampling.ROW, with_ngrams)

    def summarised(self, stats: DataFrame) -> dict[str, DataFrame]:
        """The tables of a summary: means, counts, best, ranks, heat map and global statistics."""
        order = sampling.with_row_index(stats.select("experiment_name").distinct(), "experiment_name", "ord")
        means = summary.group_means(stats)
        metrics = [r["metric"] for r in summary.top_metrics(stats).collect()]
        return {
            "means": means,
            "counts": summary.counts(stats),
            "best": summary.best_performers(stats.join(F.broadcast(order), "experiment_name")),
            "ranks": summary.ranked(stats),
            "heat_map": summary.heat_map(means, metrics),
            "global": summary.global_stats(stats),
        }

    # ---- the store of an engine ------------------------------------------------------------------------------

    def finetuned_models(self) -> dict[str, dict]:
        """What the configuration says of the models that were fine-tuned."""
        named = ("description", "base_model", "tune_name", "model_path", "training_info")
        return {n: {k: m.get(k) for k in named} for n, m in self.models.items() if m.get("finetuned")}

    def status(self) -> dict[str, int]:
        """How many entries the configuration has, datasets that are there, and files of each stored kind."""
        there = 0
        for s in self.setups.values():
            try:
                there += self._files(readers.dataset_file(s.get("dataset", {}), self.data_dir)[1]) > 0
            except ValueError:  # a setup that names no file
                continue
        return {"setups": len(self.setups), "prompts": len(self.prompts), "models": len(self.models), "finetunes": len(self.finetunes), "datasets": there} | {k: self._files(self._folder(k)) for k in STORED}

    def _files(self, folder: str) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.getContentSummary(path).getFileCount() if fs.exists(path) else 0

    def cleanup(self, kinds: list[str] | None = None, dry_run: bool = False) -> dict[str, int]:
        """Delete stored results of the kinds named, or of all; the files of each. ``dry_run`` only counts them."""
        if unknown := [k for k in kinds or [] if k not in STORED]:
            raise ValueError(f"unknown kind: {', '.join(unknown)}")
        found = {k: self._files(self._folder(k)) for k in kinds or STORED}
        for kind in [] if dry_run else found:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(kind))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return found

    # ---- training sets ---------------------------------------------------------------------------------------

    def training_request(self, name: str) -> training.TrainingRequest:
        entry = self.finetunes[name]
        config = entry.get("training_config", {})
        return training.TrainingRequest(entry["setup"], entry["prompt"], config.get("max_samples", 1000), config.get("train_test_split", 0.8), config.get("validation_split", 0.1), entry.get("hyperparameters", {}))

    def training_set(self, name: str, style: str = "messages") -> DataFrame:
        request = self.training_request(name)
        if problems := request.problems(self.setups, self.prompts):
            raise ValueError("; ".join(problems))
        questions, answer = self.fields(request.setup)
        made = training.examples(self.dataset(request.setup), request, self.prompts[request.prompt], questions, answer, self.setups[request.setup].get("prune_row"))
        return training.formatted(training.split_examples(made, request), style)
