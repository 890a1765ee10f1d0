"""A keyed permutation of 0 .. n-1 as a column expression: shuffles, samples and splits without a list of rows anywhere.

The domain is a little larger than n: a * b with a = ceil(sqrt(n)), so that a number is a pair of digits. Each of
``ROUNDS`` rounds adds to one digit a keyed function of the other, which can be undone, so the whole is a permutation of
the domain (a Feistel network). Numbers that leave 0 .. n-1 are sent on until they are back, which is a permutation of
0 .. n-1; about one in sqrt(n) leaves it each time. All is arithmetic of 64-bit integers, the same in every engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
#: A prime below 2**31, so that squares stay below 2**62; digits must stay below it too.
PRIME = (1 << 31) - 1
MOST_ROWS = 1 << 60
# Multipliers of well-known congruential generators.
FIRST, SECOND, KEYS = 48271, 69621, 16807


def keys_of(seed: int) -> list[int]:
    """A key for each round."""
    out, x = [], (abs(seed) * 2 + (seed < 0) + 1) % PRIME
    for _ in range(ROUNDS):
        x = (x * KEYS + 12345) % PRIME
        out.append(x)
    return out


def sides(n: int) -> tuple[int, int]:
    """a and b of the domain."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, max(1, -(-n // a))


def walks(n: int) -> int:
    """Passes after which every number is back: the outside's size bounds them, and so does chance (1e-30 a number)."""
    a, b = sides(n)
    outside = a * b - n
    return 1 if not outside else min(outside + 1, math.ceil(math.log(1e-30) / math.log(outside / (a * b))) + 1)


def steps(passes: int, seed: int) -> list[int]:
    """A number for each round of each pass: its key, which digit it changes, and whether numbers that are back stop before it."""
    return [key * 4 + i % 2 * 2 + (p > 0 and i == 0) for p in range(passes) for i, key in enumerate(keys_of(seed))]


def step_sql(n: str, a: str, b: str, div: str) -> str:
    """SQL of one round for x and the step e; numbers that have stopped are kept as -1 - x."""

    def mixed(digit: str) -> str:
        first = f"((({digit}) + e {div} 4) % {PRIME} * {FIRST} + e {div} 12) % {PRIME}"
        return f"({first}) * ({first}) % {PRIME} * {SECOND} % {PRIME}"

    left, right = f"x {div} {b}", f"x % {b}"
    return f"CASE WHEN x < 0 THEN x WHEN e % 2 = 1 AND x < {n} THEN -1 - x WHEN e {div} 2 % 2 = 0 THEN ({left} + {mixed(right)}) % {a} * {b} + {right} ELSE ({left}) * {b} + ({right} + {mixed(left)}) % {b} END"


def permuted(row: str, n: int, seed: int) -> Column:
    """Where the row number in the column ``row``, of 0 .. n-1, goes."""
    if n > MOST_ROWS:
        raise ValueError(f"no more than {MOST_ROWS} rows")
    a, b = sides(n)
    todo = ", ".join(f"{e}L" for e in steps(walks(n), seed))
    last = F.expr(f"aggregate(array({todo}), CAST(`{row}` AS BIGINT), (x, e) -> {step_sql(f'{n}L', f'{a}L', f'{b}L', 'div')})")
    return F.when(last < 0, -1 - last).otherwise(last)


def duck_sql(row: str, n: str, seed: int, passes: int = 64) -> str:
    """The same in DuckDB's SQL, for a number of rows that is an expression; more passes than are needed change nothing."""
    last = f"list_reduce(list_prepend(CAST({row} AS BIGINT), CAST({steps(passes, seed)} AS BIGINT[])), lambda x, e: {step_sql('n', 'a', 'b', '//')})"
    sides_of_n = f"SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, CAST(floor(sqrt(greatest(n - 1, 0))) AS BIGINT) + 1 AS a FROM (SELECT {n} AS n))"
    return f"(SELECT CASE WHEN last < 0 THEN -1 - last ELSE last END FROM (SELECT {last} AS last FROM ({sides_of_n})))"
