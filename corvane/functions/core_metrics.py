"""Token-overlap metrics, embedding similarity and the preparation that all rules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dialect import Dialect, SparkSql

TOKEN_METRICS = ["exact_match", "precision", "recall", "f1_score", "jaccard"]


def prepared_columns(d: Dialect) -> list[dict[str, str]]:
    """SQL of the columns that rules read, from response, expected_output, question_values and success; a stage reads those before it."""
    qv = d.map("question_values", lambda x: f"coalesce({x}, '')")
    return [
        {
            "ok": "coalesce(success, FALSE)",
            "given": "response IS NOT NULL",
            "expects": "expected_output IS NOT NULL",
            "r0": "coalesce(response, '')",
            "e0": "coalesce(expected_output, '')",
            "qv": f"CASE WHEN question_values IS NULL THEN {d.text_array([])} ELSE {qv} END",
        },
        {"r": d.strip("r0"), "e": d.strip("e0"), "ru": "lower(r0)"},
        {"rl": "lower(r)", "el": "lower(e)"},
    ]


def token_columns(d: Dialect) -> dict[str, str]:
    """Distinct lower-case tokens of both sides, from the prepared columns."""
    return {"tg": d.distinct(d.words("rl")), "te": d.distinct(d.words("el"))}


def count_columns(d: Dialect) -> dict[str, str]:
    return {"ng": d.size("tg"), "ne": d.size("te"), "nc": d.size(d.common("tg", "te"))}


def token_metric(d: Dialect, metric: str) -> str:
    """SQL over the prepared columns and the counts ng, ne, nc; both sides empty: 1, one side: 0."""
    one = d.num(1.0)
    value = {
        "exact_match": d.weight("rl = el", 1.0),
        "precision": f"nc / {one} / greatest(1, ng)",
        "recall": f"nc / {one} / greatest(1, ne)",
        "f1_score": f"2 * nc / {one} / greatest(1, ng + ne)",  # the harmonic mean of both, written out
        "jaccard": f"nc / {one} / greatest(1, ng + ne - nc)",
    }[metric]
    return f"CASE WHEN NOT ok THEN {d.num(0.0)} WHEN r = '' AND e = '' THEN {one} WHEN r = '' OR e = '' THEN {d.num(0.0)} ELSE {value} END"


def made_once(df: DataFrame, columns: dict[str, str | Column]) -> DataFrame:
    """``df`` with further columns. They go through a generator of one row, so that no projection after it takes them in and makes them again for each use."""
    made = [(F.expr(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    return df.select("*", F.inline(F.array(F.struct(*made)))) if columns else df


def with_prepared(responses: DataFrame, keys: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    """The keys (as struct ``k``), the prepared columns and ``more`` (as struct ``x``); other columns go, so names can't clash."""
    have = set(responses.columns)
    fill = {"question_values": "CAST(NULL AS ARRAY<STRING>)", "success": "TRUE"}
    base = responses.select(
        F.struct(*[F.col(k) for k in keys]).alias("k"),
        *[F.col(c) if c in have else F.expr(fill.get(c, "CAST(NULL AS STRING)")).alias(c) for c in ("response", "expected_output", "question_values", "success")],
        *([F.struct(*[c.alias(n) for n, c in more.items()]).alias("x")] if more else []),
    )
    for stage in prepared_columns(SparkSql()):
        base = made_once(base, stage)
    return base.drop("response", "expected_output", "question_values", "success")


def token_scores(responses: DataFrame, keys: list[str], more: dict[str, Column] | None = None, further=None) -> DataFrame:
    """keys, the five token metrics, generation_failed and the columns of ``more``.

    ``further`` takes the frame with the prepared columns, adds columns to it and returns metrics (by name) over all of them.
    """
    d = SparkSql()
    df = made_once(made_once(with_prepared(responses, keys, more), token_columns(d)), count_columns(d))
    df, metrics = further(df) if further else (df, {})
    return df.select("k.*", *[F.expr(token_metric(d, m)).alias(m) for m in TOKEN_METRICS], *[c.alias(m) for m, c in metrics.items()], F.when(F.col("ok"), 0.0).otherwise(1.0).alias("generation_failed"), *(["x.*"] if more else []))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine of two equally long numeric arrays; 0 for null, a zero vector or different lengths."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    double = lambda x: F.transform(x, lambda v: v.cast("double"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    dot = total(F.zip_with(double(a), double(b), lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(double(a), lambda v: v * v))) * F.sqrt(total(F.transform(double(b), lambda v: v * v)))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot / norm).otherwise(F.lit(0.0))
