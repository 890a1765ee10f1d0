"""Metric registries: the rules of each setup, and functions that users add."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core_metrics import made_once, with_prepared
from .dialect import Dialect, SparkSql
from .task_metrics import MODULES, RULES, SETUP_MODULES, SHARED


def metric_sql(d: Dialect, module: str, metric: str) -> str:
    """The rule with the shared guards: failed generations and missing inputs score 0."""
    rule, needs_expected = RULES[module, metric]
    return f"CAST(CASE WHEN ok AND given{' AND expects' * needs_expected} THEN {rule(d)} ELSE 0.0 END AS DOUBLE)"


def shared_columns(d: Dialect, module: str) -> list[dict[str, str]]:
    """SQL of what the module's rules share, stage by stage."""
    return SHARED[module](d) if module in SHARED else []


def module_scores(responses: DataFrame, module: str, keys: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    """keys, the module's metrics as SQL expressions, and the columns of ``more``."""
    d = SparkSql()
    df = with_prepared(responses, keys, more)
    for stage in shared_columns(d, module):
        df = made_once(df, stage)
    return df.select("k.*", *[F.expr(metric_sql(d, module, m)).alias(m) for m in MODULES[module]], *(["x.*"] if more else []))


class MetricRegistry:
    """Which metrics a setup has: its module's rules and the functions registered for all setups."""

    def __init__(self, setup_modules: dict[str, str] | None = None):
        self.setup_modules = dict(SETUP_MODULES if setup_modules is None else setup_modules)
        self.functions: dict[str, Callable] = {}

    def register(self, name: str, function: Callable[[dict], float]) -> None:
        """A Python function of the response as a dict; what is not a number, or raises, scores 0."""
        if not callable(function):
            raise ValueError(f"metric {name} must be callable")
        self.functions[name] = function

    def names(self, setup: str) -> list[str]:
        return MODULES.get(self.setup_modules.get(setup, ""), []) + list(self.functions)

    def function_columns(self, responses: DataFrame) -> dict[str, Column]:
        """The registered functions over the columns that a response has; a failed generation scores 0."""
        have = [c for c in ("prompt", "response", "expected_output", "question_values", "success", "error") if c in responses.columns]
        ok = F.coalesce(F.col("success"), F.lit(False)) if "success" in have else F.lit(True)
        return {n: F.when(ok, F.coalesce(self._function(n)(F.struct(*have)), F.lit(0.0))).otherwise(0.0) for n in self.functions}

    def _function(self, name: str) -> Callable[[Column], Column]:
        function = self.functions[name]

        def one(row: dict) -> float:
            try:
                value = function(row)
                return float(value) if isinstance(value, int | float) else 0.0
            except Exception:  # noqa: BLE001 a metric that fails scores 0
                return 0.0

        def scored(rows: pd.DataFrame) -> pd.Series:
            return pd.Series([one(r) for r in rows.to_dict("records")], dtype="float64")

        scored.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
        return F.pandas_udf(scored, "double")

    def scores(self, responses: DataFrame, setup: str, keys: list[str]) -> DataFrame:
        """keys and every metric of the setup, side by side in one projection; repeated and null keys keep their rows."""
        module, more = self.setup_modules.get(setup), self.function_columns(responses)
        return module_scores(responses, module, keys, more) if module else responses.select(*keys, *[c.alias(n) for n, c in more.items()])

    def long_scores(self, responses: DataFrame, setup_column: str, keys: list[str]) -> DataFrame:
        """keys, metric, value for rows of all setups; metric names may repeat between setups, so setup must be among the keys.

        Rows of a setup without a module have the registered functions alone.
        """
        more = self.function_columns(responses)
        parts = []
        for module in dict.fromkeys(self.setup_modules.values()):
            setups = [s for s, m in self.setup_modules.items() if m == module]
            scored = module_scores(responses.where(F.col(setup_column).isin(setups)), module, keys, more)
            parts.append(scored.unpivot(keys, [*MODULES[module], *more], "metric", "value"))
        if more:
            other = responses.where(~F.coalesce(F.col(setup_column).isin(list(self.setup_modules)), F.lit(False)))
            parts.append(other.select(*keys, *[c.alias(n) for n, c in more.items()]).unpivot(keys, list(more), "metric", "value"))
        return reduce(DataFrame.unionByName, parts)
