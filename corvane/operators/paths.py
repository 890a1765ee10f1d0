"""The field-path language, compiled to Catalyst columns.

``path := "" | "json:" column ["." jpath] | jpath``; segments are names with
optional ``[n]`` indices or ``[*]``. Missing columns and keys, indices out of
range and invalid JSON give null. ``[*]`` joins the elements' texts by one
space, leaving nulls out; nothing left gives null. Names hold dots only as
separators.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAR = "*"
_SEGMENT = re.compile(r"([^\[]+)|\[(\d+|\*)\]")


@dataclass(frozen=True)
class Path:
    column: str | None
    steps: tuple[str | int, ...]
    is_json: bool

    @staticmethod
    def parse(text: str) -> Path:
        is_json = text.startswith("json:")
        body = text[5:] if is_json else text
        if is_json and "." in body:
            column, rest = body.split(".", 1)
            return Path(column, tuple(_steps(rest)), True)
        if is_json:
            return Path(body, (), True)
        steps = _steps(body)
        return Path(str(steps[0]) if steps else None, tuple(steps[1:]), False)


def _steps(text: str) -> list[str | int]:
    out: list[str | int] = []
    for segment in text.split("."):
        for name, index in _SEGMENT.findall(segment):
            out.append(name if name else STAR if index == STAR else int(index))
    return out


def _walk(value: Column, kind: T.DataType, steps: tuple) -> tuple[Column | None, T.DataType | None]:
    """Follow steps through structs, maps and arrays by their static types; None where the path can't exist."""
    for i, step in enumerate(steps):
        if step == STAR:
            if not isinstance(kind, T.ArrayType):
                return None, None
            inner = kind.elementType
            made, _ = _walk(F.lit(None), inner, steps[i + 1 :])
            if made is None and steps[i + 1 :]:
                return None, None
            return _joined(F.transform(value, lambda x: _as_text(*_walk(x, inner, steps[i + 1 :])))), T.StringType()
        if isinstance(step, int):
            if not isinstance(kind, T.ArrayType):
                return None, None
            value, kind = F.get(value, F.lit(step)), kind.elementType
        elif isinstance(kind, T.StructType) and step in kind.names:
            value, kind = value.getField(step), kind[step].dataType
        elif isinstance(kind, T.MapType):
            value, kind = F.try_element_at(value, F.lit(step)), kind.valueType
        else:
            return None, None
    return value, kind


def _as_text(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType | T.ArrayType | T.MapType):
        return F.to_json(value)
    return value.cast("string")


def _joined(texts: Column) -> Column:
    kept = F.filter(texts, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.array_join(kept, " "))


def _variant_path(steps: tuple) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)


def _from_json(text: Column, steps: tuple) -> Column:
    parsed = F.try_parse_json(text)
    if STAR not in steps:
        return F.try_variant_get(parsed, _variant_path(steps), "string") if steps else F.to_json(parsed)
    at = steps.index(STAR)
    before, after = steps[:at], steps[at + 1 :]
    items = F.try_variant_get(parsed, _variant_path(before), "array<variant>")
    return _joined(F.transform(items, lambda x: F.try_variant_get(x, _variant_path(after), "string") if after else F.try_variant_get(x, "$", "string")))


def resolve(schema: T.StructType, text: str) -> Column:
    """The value at a path as text, null where there is none."""
    path = Path.parse(text)
    if path.column is None:
        return F.to_json(F.struct(*[F.col(f"`{n}`") for n in schema.names]))
    if path.column not in schema.names:
        return F.lit(None).cast("string")
    kind = schema[path.column].dataType
    value = F.col(f"`{path.column}`")
    if path.is_json and isinstance(kind, T.StringType):
        return _from_json(value, path.steps)
    value, kind = _walk(value, kind, path.steps)
    return F.lit(None).cast("string") if value is None else _as_text(value, kind)


def extract(schema: T.StructType, paths: list[str]) -> Column:
    """All values as an array of texts; null becomes the empty text."""
    return F.array(*[F.coalesce(resolve(schema, p), F.lit("")) for p in paths]) if paths else F.array().cast("array<string>")


def expected_answer(schema: T.StructType, path: str) -> Column:
    return F.coalesce(resolve(schema, path), F.lit(""))


def validate(df: DataFrame, paths: list[str], rows: int = 3) -> DataFrame:
    """path, valid, is_json, preview: a path is valid if one of the first rows has a value there."""
    probe = df.limit(rows)
    found = [F.struct(F.lit(p).alias("path"), F.lit(p.startswith("json:")).alias("is_json"), F.max(F.substring(resolve(df.schema, p), 1, 100)).alias("preview")) for p in paths]
    return probe.agg(F.array(*found).alias("f")).select(F.explode("f").alias("f")).select("f.path", F.col("f.preview").isNotNull().alias("valid"), "f.is_json", "f.preview")


def json_inventory(paths: list[str]) -> dict[str, list[str]]:
    """Which paths read JSON columns, which don't, and the JSON columns."""
    is_json = [p for p in paths if p.startswith("json:")]
    return {"json": is_json, "regular": [p for p in paths if p not in is_json], "columns": sorted({Path.parse(p).column or "" for p in is_json})}


def experiment_name(setup: Column, model: Column, mode: Column, prompt: Column, size: Column, temperature: Column, few_shot_row: Column | None = None) -> Column:
    """setup__model__mode[-row]__prompt__size__temperature, the point of the temperature written as p."""
    shot = F.concat(mode, F.when(few_shot_row.isNotNull(), F.concat(F.lit("-"), few_shot_row.cast("string"))).otherwise("")) if few_shot_row is not None else mode
    return F.concat_ws("__", setup, model, shot, prompt, size.cast("string"), F.replace(F.format_string("%.3f", temperature.cast("double")), F.lit("."), F.lit("p")))


def without_echo(response: Column, prompt: Column) -> Column:
    """A response that starts with its prompt, without it and stripped."""
    rest = F.regexp_replace(response.substr(F.length(prompt) + 1, F.length(response)), r"(?U)^\s+|\s+$", "")
    return F.when(F.startswith(response, prompt), rest).otherwise(response)


def name_of_file(file: Column) -> Column:
    """The experiment of a response or evaluation file."""
    return F.regexp_replace(F.regexp_extract(file, r"([^/]*)\.json$", 1), "^(inference|evaluation)_", "")
