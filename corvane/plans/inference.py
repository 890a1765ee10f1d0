"""Calling a generator or an embedder that the user brings, by partition."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESPONSE = "response string, processing_time double, success boolean, error string"


def generate(prompts: DataFrame, load: Callable[[str], Callable[[str], str]], model: str = "model", tasks_per_model: int = 8) -> DataFrame:
    """``prompts`` (with a prompt and a model column) and response, processing_time, success, error.

    ``load(name)`` returns a function from prompt to text. Rows are dealt by
    model, ``tasks_per_model`` tasks to each, so that a task loads few models,
    each once. A call that raises gives an error row.
    """
    kept = prompts.columns
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields if f.name not in ("response", "processing_time", "success", "error")], RESPONSE])
    names = [c for c in kept if c not in ("response", "processing_time", "success", "error")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded: dict[str, Callable[[str], str]] = {}
        for frame in frames:
            rows = []
            for name, prompt in zip(frame[model], frame["prompt"]):
                begin = time.monotonic()
                try:
                    if name not in loaded:
                        loaded[name] = load(name)
                    rows.append((loaded[name](prompt), time.monotonic() - begin, True, None))
                except Exception as e:  # noqa: BLE001 the row reports it
                    rows.append((None, time.monotonic() - begin, False, f"{type(e).__name__}: {e}"))
            made = pd.DataFrame(rows, columns=["response", "processing_time", "success", "error"], index=frame.index)
            yield pd.concat([frame[names], made], axis=1)

    # Dealt by model and a few buckets, so that one model with most rows doesn't end in one task.
    dealt = prompts.repartition(model, F.pmod(F.xxhash64("prompt"), F.lit(tasks_per_model)))
    return dealt.select(*names).mapInPandas(run, schema)


def embed(df: DataFrame, column: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], name: str = "embedding") -> DataFrame:
    """``df`` with the embedding of a text column by a function that each task loads once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        function = load()
        for frame in frames:
            frame = frame.copy()
            frame[name] = list(function(frame[column].fillna("").tolist()))
            yield frame

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], f"`{name}` array<float>"])
    return df.mapInPandas(run, schema)
