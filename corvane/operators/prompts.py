"""Prompt templates as projections, few-shot examples, chat formats and checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paths import extract, resolve

ZERO_SHOT, FEW_SHOT = "zero-shot", "few-shot"
NOT_ANNOTATED = ["na", "n/a", "not applicable", "not annotatable", "", "none"]


def placeholders(template: str) -> int:
    return template.count("{}")


def fill(template: str, values: list[Column]) -> Column:
    """The template with its ``{}`` replaced in order; their number must be that of the values."""
    parts = template.split("{}")
    if len(parts) - 1 != len(values):
        raise ValueError(f"the template has {len(parts) - 1} places for {len(values)} values")
    pieces = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:]):
        pieces += [F.coalesce(value, F.lit("")), F.lit(part)]
    return F.concat(*pieces)


@dataclass(frozen=True)
class Prompt:
    name: str
    mode: str
    setup: str
    template: str
    few_shot_example: str = ""
    description: str = ""

    def requirements(self, question_fields: list[str], answer_field: str, setups: list[str]) -> dict:
        """What the prompt needs of a row, and whether it fits."""
        return {
            "prompt": self.name,
            "setup": self.setup,
            "mode": self.mode,
            "template": self.template,
            "places": placeholders(self.template),
            "question_fields": question_fields,
            "answer_field": answer_field,
            "few_shot_example": self.few_shot_example if self.mode == FEW_SHOT else None,
            "problems": self.problems(question_fields, setups),
        }

    def problems(self, question_fields: list[str], setups: list[str]) -> list[str]:
        """Why this prompt can't be used with the fields; nothing if it can."""
        out = []
        if self.setup not in setups:
            out.append(f"unknown setup {self.setup}")
        if self.mode not in (ZERO_SHOT, FEW_SHOT):
            out.append(f"unknown mode {self.mode}")
        if placeholders(self.template) != len(question_fields):
            out.append(f"{placeholders(self.template)} places for {len(question_fields)} fields")
        if self.mode == FEW_SHOT and not self.few_shot_example:
            out.append("no few-shot example")
        if self.mode == FEW_SHOT and self.few_shot_example and placeholders(self.few_shot_example) != len(question_fields) + 1:
            out.append(f"{placeholders(self.few_shot_example)} places in the example for {len(question_fields)} fields and the answer")
        return out


def example(row: DataFrame, question_fields: list[str], answer_field: str) -> DataFrame:
    """question_values and answer of the one example row; a missing answer is N/A, and doubtful ones are flagged."""
    answer = F.coalesce(resolve(row.schema, answer_field), F.lit("N/A"))
    return row.select(extract(row.schema, question_fields).alias("example_values"), answer.alias("example_answer"), F.lower(F.trim(answer)).isin(NOT_ANNOTATED).alias("example_doubtful"))


def render(df: DataFrame, prompt: Prompt, question_fields: list[str], answer_field: str, example_row: DataFrame | None = None) -> DataFrame:
    """``df`` with question_values, expected_output, prompt and success; few-shot prompts put the example before."""
    schema = df.schema
    values = [F.coalesce(resolve(schema, p), F.lit("")) for p in question_fields]
    text = fill(prompt.template, values)
    if prompt.mode == FEW_SHOT:
        if example_row is None:
            raise ValueError("a few-shot prompt needs an example row")
        shown = example(example_row, question_fields, answer_field)
        before = fill(prompt.few_shot_example, [F.get("example_values", F.lit(i)) for i in range(len(question_fields))] + [F.col("example_answer")])
        df = df.crossJoin(F.broadcast(shown.select(before.alias("__example"))))  # one row
        text = F.concat("__example", text)
    out = df.select(*schema.names, F.array(*values).alias("question_values"), F.coalesce(resolve(schema, answer_field), F.lit("")).alias("expected_output"), text.alias("prompt"))
    return out.withColumn("success", F.lit(True))


def batch(df: DataFrame, prompt: Prompt, question_fields: list[str], answer_field: str, example_row: DataFrame | None = None) -> DataFrame:
    """``render`` with success and error for each row: a template that can't be filled gives rows without a prompt.

    A few-shot prompt without an example row gives no rows.
    """
    if prompt.mode == FEW_SHOT and example_row is None:
        df, example_row = df.limit(0), df.limit(0)
    try:
        return render(df, prompt, question_fields, answer_field, example_row).withColumn("error", F.lit(None).cast("string"))
    except ValueError as e:
        bare = df.select(*df.schema.names, extract(df.schema, question_fields).alias("question_values"), F.coalesce(resolve(df.schema, answer_field), F.lit("")).alias("expected_output"))
        return bare.withColumns({"prompt": F.lit(""), "success": F.lit(False), "error": F.lit(str(e))})


def chat_format(style: str, prompt: Column, answer: Column) -> Column:
    """A training example as ``conversations``, ``messages`` or one ``text``."""
    if style == "conversations":
        return F.array(F.struct(F.lit("human").alias("from"), prompt.alias("value")), F.struct(F.lit("gpt").alias("from"), answer.alias("value")))
    if style == "messages":
        return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")), F.struct(F.lit("assistant").alias("role"), answer.alias("content")))
    if style == "text":
        return F.concat(F.lit("### Human: "), prompt, F.lit("\n\n### Assistant: "), answer)
    raise ValueError(f"unknown chat style {style!r}")
