"""Statistics as states that merge: responses that come later are added without reading the earlier ones again.

A state holds the count, mean, sum of squared deviations, least and greatest value of a group, how many values are NaN,
and a KLL sketch of its quantiles. States of parts are merged by the pairwise update of Chan, Golub and LeVeque and by
merging sketches. All but the median are exact from states alone.

``exact_medians`` makes the median exact by passes that only count. The sketch brackets the median; a pass counts the
group's values below the bracket and inside, which shows whether it holds, and sketches what is inside, for a narrower
one. Counts and sketches are made partly in each task, so no task holds a group, until a bracket has few enough values
to sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written

#: Values of a bracket that are sorted in one task.
FEW = 4096
#: Share of the ranks that a bracket reaches to either side of the median; several times the sketch's error.
REACH = 0.05


def states(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """by and the state of each group's values; null is no value."""
    v = F.col(value).cast("double")
    number = F.when(~F.isnan(v), v)
    return long.groupBy(*by).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        (F.var_pop(v) * F.count(v)).alias("m2"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.count_if(F.coalesce(F.isnan(v) & v.isNotNull(), F.lit(False))).alias("n_nan"),
        F.kll_sketch_agg_double(number).alias("sketch"),
    )


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """One state for each group from its states, which are as many as it had batches."""
    some = F.when(F.col("n") > 0, F.struct("n", "mean", "m2"))

    def both(a: Column, x: Column) -> Column:
        n = a["n"] + x["n"]
        gap = x["mean"] - a["mean"]
        return F.when(a["n"] == 0, F.struct(x["n"].alias("n"), x["mean"].alias("mean"), x["m2"].alias("m2"))).otherwise(
            F.struct(n.alias("n"), (a["mean"] + gap * x["n"] / n).alias("mean"), (a["m2"] + x["m2"] + gap * gap * a["n"] * x["n"] / n).alias("m2"))
        )

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    grouped = parts.groupBy(*by).agg(F.array_sort(F.collect_list(some)).alias("moments"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("n_nan").alias("n_nan"), F.kll_merge_agg_double("sketch").alias("sketch"))
    total = F.aggregate("moments", zero, both).alias("total")
    rows = grouped.select(*by, total, "min", "max", "n_nan", "sketch")
    n = F.col("total.n")
    return rows.select(*by, n.alias("n"), F.when(n > 0, F.col("total.mean")).alias("mean"), F.when(n > 0, F.col("total.m2")).alias("m2"), "min", "max", "n_nan", "sketch")


def append(long: DataFrame, by: list[str], path: str, batch: str, value: str = "value") -> None:
    """Store the states of a batch of responses. A batch that is stored again replaces itself."""
    states(long, by, value).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def current(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """The merged states of all batches."""
    return merged(spark.read.option("basePath", path).parquet(path).drop("batch"), by)


def _quantile(share: Column) -> Column:
    """The value at the share in hundredths, cut to 0 and 1; a sketch tells only shares that are constants."""
    every = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / 100) for i in range(101)]))
    return F.element_at(every, F.greatest(F.least(F.round(share * 100), F.lit(100)), F.lit(0)).cast("int") + 1)


def statistics(merged_states: DataFrame, by: list[str]) -> DataFrame:
    """by, n and the five statistics; the median is the sketch's, within some 2 percent of the ranks."""
    median = F.when(F.col("n") > F.col("n_nan"), _quantile(F.lit(0.5)))
    return merged_states.select(*by, "n", "mean", F.when(F.col("n") > 0, F.sqrt(F.greatest(F.col("m2") / F.col("n"), F.lit(0.0)))).alias("std"), "min", "max", median.alias("median"))


def _on(left: list[str]) -> Column:
    out = F.lit(True)
    for c in left:
        out = out & F.col(f"`{c}`").eqNullSafe(F.col(f"`__{c}`"))
    return out


def exact_medians(long: DataFrame, merged_states: DataFrame, by: list[str], value: str = "value", few: int = FEW, reach: float = REACH) -> DataFrame:
    """by and the interpolated median of each group. ``long`` is read once for each pass, so it should be a stored table."""
    rows = long.select(*by, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)")
    numbers = F.col("n") - F.col("n_nan")
    ranked = merged_states.where("n > 0").select(*[F.col(f"`{c}`").alias(f"__{c}") for c in by], numbers.alias("numbers"), F.floor((F.col("n") - 1) / 2).alias("r1"), F.floor(F.col("n") / 2).alias("r2"), "sketch", "max")
    # NaN comes after all numbers, so a median beyond these is NaN.
    done = ranked.where("r2 >= numbers").select(*[f"__{c}" for c in by], F.lit(float("nan")).alias("median"))
    searched = ranked.where("r2 < numbers")
    everything = (F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    names = [f"__{c}" for c in by]
    ready = searched.where(F.col("numbers") <= few).select(*names, *everything, F.lit(0).cast("long").alias("below"), "r1", "r2")

    def bracket(share: Column, up: bool, width: float) -> Column:
        edge = share + width if up else share - width
        inside = (edge < 1.0) if up else (edge > 0.0)
        return F.when(inside, _quantile(edge)).otherwise(F.lit(float("inf") if up else float("-inf")))

    width, rounds, found = reach, 0, []
    open_ = written(searched.where(F.col("numbers") > few).select(*names, bracket(F.col("r1") / F.col("numbers"), False, width).alias("lo"), bracket(F.col("r2") / F.col("numbers"), True, width).alias("hi"), "r1", "r2"), "brackets")
    while not open_.isEmpty():
        rounds += 1
        v, lo, hi = F.col("__v"), F.col("lo"), F.col("hi")
        inside = (v >= lo) & (v <= hi)
        met = rows.join(open_, _on(by))
        counted = met.groupBy(*names, "lo", "hi", "r1", "r2").agg(
            F.count_if(v < lo).alias("below"),
            F.count_if(inside).alias("inside"),
            F.count_if(v == lo).alias("at_lo"),
            F.count_if(v == hi).alias("at_hi"),
            F.min(F.when(v > lo, v)).alias("after"),
            F.max(F.when(v < hi, v)).alias("before"),
            F.kll_sketch_agg_double(F.when(inside, v)).alias("sketch"),
        )
        counted = written(counted, "brackets")
        end = F.col("below") + F.col("inside")
        held = counted.where((F.col("r1") >= F.col("below")) & (F.col("r2") < end))
        # A rank among the values equal to an edge, or next to them, is known without sorting.
        at = lambda r: (
            F.when(F.col(r) < F.col("below") + F.col("at_lo"), lo)
            .when(F.col(r) >= end - F.col("at_hi"), hi)
            .when(F.col(r) == F.col("below") + F.col("at_lo"), F.col("after"))
            .when(F.col(r) == end - F.col("at_hi") - 1, F.col("before"))
        )
        known = held.withColumn("v1", at("r1")).withColumn("v2", at("r2"))
        found.append(known.where("v1 IS NOT NULL AND v2 IS NOT NULL").select(*names, ((F.col("v1") + F.col("v2")) / 2).alias("median")))
        rest = known.where("v1 IS NULL OR v2 IS NULL")
        ready = ready.union(rest.where(F.col("inside") <= few).select(*names, "lo", "hi", "below", "r1", "r2"))
        # Narrower by the sketch of what is inside, and past the edges' values in any case.
        width = min(0.5, reach * (1 + 0.2 * rounds))
        low = F.greatest(bracket((F.col("r1") - F.col("below")) / F.col("inside"), False, width), F.when(F.col("r1") > F.col("below") + F.col("at_lo"), F.col("after")).otherwise(lo))
        high = F.least(bracket((F.col("r2") - F.col("below")) / F.col("inside"), True, width), F.when(F.col("r2") < end - F.col("at_hi"), F.col("before")).otherwise(hi))
        narrowed = rest.where(F.col("inside") > few).select(*names, low.alias("lo"), high.alias("hi"), "r1", "r2")
        missed = counted.where((F.col("r1") < F.col("below")) | (F.col("r2") >= end)).select(*names, *everything, "r1", "r2")
        open_ = written(narrowed.union(missed), "brackets")
    last = rows.join(ready, _on(by)).where("__v >= lo AND __v <= hi")
    picked = last.groupBy(*names, "below", "r1", "r2").agg(F.array_sort(F.collect_list("__v")).alias("sorted"))
    value_at = lambda r: F.element_at("sorted", (F.col(r) - F.col("below") + 1).cast("int"))
    out = done.union(picked.select(*names, ((value_at("r1") + value_at("r2")) / 2).alias("median")))
    for part in found:
        out = out.union(part)
    return out.select(*[F.col(f"__{c}").alias(c) for c in by], "median")


def five_stats(long: DataFrame, by: list[str], value: str = "value", of: DataFrame | None = None) -> DataFrame:
    """The five statistics of a stored ``long`` with exact medians and no group in one task; ``of``: its merged states, if there are."""
    of = written(states(long, by, value), "states") if of is None else of
    exact = exact_medians(long, of, by, value).select(*[F.col(f"`{c}`").alias(f"__{c}") for c in by], "median")
    return statistics(of, by).drop("n", "median").join(exact, _on(by), "left").select(*by, "mean", "std", "min", "max", "median")
