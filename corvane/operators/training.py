"""Training sets: prune, keep the last rows, render, drop blank answers, shuffle and split, format."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prune, sampling
from .prompts import Prompt, chat_format, render

# How examples are formatted by back end.
STYLE_BY_BACKEND = {(True, True): "conversations", (False, True): "messages", (True, False): "text", (False, False): "text"}


@dataclass(frozen=True)
class TrainingRequest:
    setup: str
    prompt: str
    max_samples: int = 1000
    train: float = 0.8
    validation: float = 0.1
    hyperparameters: dict = field(default_factory=dict)

    def problems(self, setups: dict, prompts: dict[str, Prompt]) -> list[str]:
        out = []
        if self.setup not in setups:
            out.append(f"unknown setup {self.setup}")
        if self.prompt not in prompts:
            out.append(f"unknown prompt {self.prompt}")
        elif prompts[self.prompt].setup != self.setup:
            out.append(f"prompt {self.prompt} belongs to {prompts[self.prompt].setup}")
        if not 0 < self.train < 1 or not 0 <= self.validation < 1 or self.train + self.validation > 1:
            out.append(f"split {self.train} / {self.validation} is not possible")
        if self.max_samples < 1:
            out.append("max_samples must be positive")
        return out


def examples(numbered: DataFrame, request: TrainingRequest, prompt: Prompt, question_fields: list[str], answer_field: str, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """input, output, row_index of the last ``max_samples`` rows that are kept and have an answer."""
    df = prune.kept(numbered, rules, question_fields, answer_field) if rules else numbered
    last = sampling.tail(df, request.max_samples)
    made = render(last, prompt, question_fields, answer_field).select(F.col("prompt").alias("input"), F.col("expected_output").alias("output"), F.col(sampling.ROW).alias("row_index"))
    return made.where(F.regexp_replace("output", r"(?U)^\s+|\s+$", "") != "")


def split_examples(made: DataFrame, request: TrainingRequest, seed: int = sampling.SEED, method: str = "exact") -> DataFrame:
    """Examples renumbered in row order, with their split."""
    return sampling.split(sampling.with_row_index(made, "row_index"), request.train, request.validation, seed, method=method)


def formatted(split: DataFrame, style: str) -> DataFrame:
    return split.select("split", "shuffled_idx", chat_format(style, F.col("input"), F.col("output")).alias(style))
