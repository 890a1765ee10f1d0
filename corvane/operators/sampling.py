"""Row numbers, seeded samples and splits.

The exact variants draw on the driver the same numbers as pandas
(``sample(n, random_state)``) and CPython (``random``) do, from the row count
alone, and join them on the row number; they are for tables of at most ``EXACT_ROWS``
rows, and refuse larger ones. The permuted variants compute where each row goes
from its number by a keyed permutation, in the row's own task, for any size. The
hash variants need no row numbers. Each draws other rows.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .permute import permuted

SEED = 42
#: Rows up to which the draws of pandas and CPython are made again; their permutation of all row numbers is made on the driver.
EXACT_ROWS = 1_000_000
ROW = "row_idx"


def with_row_index(df: DataFrame, order: str | list[str], name: str = ROW) -> DataFrame:
    """Rows numbered from 0 by ``order``: numbers within range partitions plus the counts of those before.

    Only one row per partition meets in one task, unlike a window over all rows.
    """
    order = [order] if isinstance(order, str) else list(order)
    return numbered_within(df, [], [F.col(o) for o in order], name)


def numbered_within(df: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    """Rows numbered from 0 by ``order`` within each value of ``by``, however many rows one value has.

    Rows are dealt to ranges of (by, order). A row's number is its number within its range and value, plus the counts of
    that value in the ranges before.
    """
    dealt = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__part", F.spark_partition_id())
    # Written, not cached: the counts and the numbers must see the same ranges even if an executor is lost.
    dealt = written(dealt, "numbered")
    counts = dealt.groupBy("__part", *by).count()
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__part", *by, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order)) - 1
    rows = dealt.withColumn(name, inside)
    # One row for each range and value that has rows in it: as many as there are ranges and values together, at most.
    keys = [F.col("__part") == F.col("__part_of"), *[F.col(f"`{c}`").eqNullSafe(F.col(f"`__{c}_of`")) for c in by]]
    before = before.select(F.col("__part").alias("__part_of"), *[F.col(f"`{c}`").alias(f"__{c}_of") for c in by], "__base")
    out = rows.join(before if by else F.broadcast(before), reduce(lambda x, y: x & y, keys))
    return out.withColumn(name, (F.col("__base") + F.col(name)).cast("long")).drop("__part", "__part_of", "__base", *[f"__{c}_of" for c in by])


def sample_indices(n_rows: int, n: int, seed: int = SEED) -> list[int]:
    """The rows that ``pandas.DataFrame.sample(n, random_state=seed)`` takes, in its order."""
    return np.random.RandomState(seed).permutation(n_rows)[:n].tolist()


def _few(n_rows: int) -> None:
    if n_rows > EXACT_ROWS:
        raise ValueError(f"exact draws are for {EXACT_ROWS} rows at most; draw from {n_rows} by method='permuted'")


def sample(df: DataFrame, n: int, seed: int = SEED, n_rows: int | None = None, method: str = "exact") -> DataFrame:
    """n rows of a numbered frame with their place as ``sample_idx``: as pandas draws them, or ``permuted``. All rows if there are no more."""
    n_rows = df.count() if n_rows is None else n_rows
    if n >= n_rows:
        return df.withColumn("sample_idx", F.col(ROW))
    if method == "permuted":
        return df.withColumn("sample_idx", permuted(ROW, n_rows, seed)).where(F.col("sample_idx") < n)
    _few(n_rows)
    drawn = df.sparkSession.createDataFrame(list(zip(sample_indices(n_rows, n, seed), range(n))), f"{ROW} long, sample_idx long")
    return df.join(F.broadcast(drawn), ROW)  # n rows


def hash_sample(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """n rows by a seeded hash of the key: no numbering, and a top-n that each task cuts first."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def few_shot_index(n_rows: int, seed: int = SEED) -> int:
    """The example row of the unpruned table."""
    return random.Random(seed).randint(0, n_rows - 1)


def row_at(df: DataFrame, index: int) -> DataFrame:
    if index < 0:
        raise IndexError(f"row {index} is out of range")
    return df.where(F.col(ROW) == index)


def head(df: DataFrame, n: int, order: str = ROW) -> DataFrame:
    return df.orderBy(order).limit(n)


def tail(df: DataFrame, n: int, order: str = ROW) -> DataFrame:
    """The last n rows; a top-n, so nothing is collected."""
    return df.orderBy(F.desc(order)).limit(n)


def split_sizes(n: int, train: float, validation: float) -> tuple[int, int]:
    """Rows for training and validation (at least one); the rest is left over."""
    return int(n * train), int(n * validation) or 1


def split(df: DataFrame, train: float, validation: float, seed: int = SEED, n_rows: int | None = None, method: str = "exact") -> DataFrame:
    """A numbered frame with ``split`` (train, validation or unused) by a seeded shuffle: CPython's, or ``permuted``."""
    n = df.count() if n_rows is None else n_rows
    n_train, n_validation = split_sizes(n, train, validation)
    if method == "permuted":
        shuffled = df.withColumn("shuffled_idx", permuted(ROW, n, seed))
    else:
        _few(n)
        order = list(range(n))
        random.Random(seed).shuffle(order)
        drawn = df.sparkSession.createDataFrame([(r, i) for i, r in enumerate(order)], f"{ROW} long, shuffled_idx long")
        shuffled = df.join(drawn, ROW)
    at = F.col("shuffled_idx")
    return shuffled.withColumn("split", F.when(at < n_train, "train").when(at < n_train + n_validation, "validation").otherwise("unused"))


def hash_split(df: DataFrame, key: str, train: float, validation: float, seed: int = SEED) -> DataFrame:
    """Splits by a hash bucket of the key; a row's split doesn't depend on other rows."""
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000))
    return df.withColumn("split", F.when(bucket < int(train * 1_000_000), "train").when(bucket < int((train + validation) * 1_000_000), "validation").otherwise("unused"))
