"""Row pruning: literal and ``regex:`` patterns on field paths, with a reason for each row that goes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import Path, resolve

REGEX = "regex:"
#: All question fields and the answer field.
EVERY = "*"


def _matches(value: Column, pattern: str) -> Column:
    if pattern.startswith(REGEX):
        try:
            re.compile(pattern[len(REGEX) :])
        except re.error as e:
            raise ValueError(f"invalid pattern {pattern!r}: {e}") from e
        return F.coalesce(value.rlike(pattern[len(REGEX) :]), F.lit(False))
    return F.coalesce(value == F.lit(pattern), F.lit(False))


def prune_reason(schema: T.StructType, rules: dict[str, list[str]], question_fields: list[str], answer_field: str = "", null_as: str = "blank") -> Column:
    """Why a row goes; null if it stays. The first match in order wins, rules for all fields first.

    ``null_as``: "blank" lets an empty cell match the empty pattern; "nan" reads it as
    the text ``nan``, as data frames that hold missing cells as floats do. A path into
    a cell that leads nowhere has no value and matches nothing.
    """
    if null_as not in ("blank", "nan"):
        raise ValueError(f"null_as must be blank or nan, not {null_as!r}")
    missing = F.lit("" if null_as == "blank" else "nan")
    tests: list[tuple[Column, Column]] = []

    def add(path: str, pattern: str, said: str) -> None:
        value, parsed = resolve(schema, path), Path.parse(path)
        if parsed.column in schema.names and not parsed.steps:
            value = F.coalesce(value, missing)
        tests.append((_matches(value, pattern), F.concat(F.lit(said), F.lit(" with value '"), value, F.lit("'"))))

    for pattern in rules.get(EVERY, []):
        for path in [*question_fields, *([answer_field] if answer_field else [])]:
            add(path, pattern, f"any field: pattern '{pattern.removeprefix(REGEX)}' matched '{path}'")
    for path, patterns in rules.items():
        for pattern in patterns if path != EVERY else []:
            add(path, pattern, f"field '{path}': pattern '{pattern.removeprefix(REGEX)}' matched")
    if not tests:
        return F.lit(None).cast("string")
    out = F.when(*tests[0])
    for condition, reason in tests[1:]:
        out = out.when(condition, reason)
    return out


def with_reason(df: DataFrame, rules: dict[str, list[str]], question_fields: list[str], answer_field: str = "", null_as: str = "blank") -> DataFrame:
    return df.withColumn("prune_reason", prune_reason(df.schema, rules, question_fields, answer_field, null_as))


def kept(df: DataFrame, *rules, **more) -> DataFrame:
    return with_reason(df, *rules, **more).where("prune_reason IS NULL").drop("prune_reason")


def accounting(marked: DataFrame, order: str, previews: int = 10) -> DataFrame:
    """n_rows, n_pruned, n_kept and the first reasons by ``order``, in one pass over rows with reasons."""
    ranked = marked.where("prune_reason IS NOT NULL").orderBy(order).limit(previews).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "prune_reason"))), lambda x: x["prune_reason"]).alias("reasons"))
    counts = marked.agg(F.count("*").alias("n_rows"), F.count("prune_reason").alias("n_pruned"), (F.count("*") - F.count("prune_reason")).alias("n_kept"))
    return counts.crossJoin(F.broadcast(ranked))  # one row each
