"""Joins on equal keys, where null equals null.

The right side may be bounded by a number of rows; only then, and if the bound
is small, it is broadcast by hint. Beyond it, or without a bound, Spark chooses:
it broadcasts by its own size statistics or sorts and merges, splitting skew.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.errors import EngineError
from tarn.plans.compile import quoted

HOW = {"inner": "inner", "left": "left", "semi": "left_semi", "anti": "left_anti"}
#: Rows and bytes up to which a counted right side is broadcast.
SMALL, SMALL_BYTES = 100_000, 32 << 20


def bounded(right: DataFrame, max_right_rows: int | None) -> DataFrame:
    """right, checked against the bound, with a broadcast hint if it is small."""
    if max_right_rows is None:
        return right
    n = right.limit(max_right_rows + 1).count()
    if n > max_right_rows:
        raise EngineError("BUDGET_EXCEEDED", f"the right side has more than {max_right_rows} rows", limit=max_right_rows)
    size = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(right) if n <= SMALL and size <= SMALL_BYTES else right


def join(
    left: DataFrame,
    right: DataFrame,
    left_on: list[str],
    right_on: list[str] | None = None,
    how: str = "inner",
    max_right_rows: int | None = None,
    right_prefix: str = "right.",
) -> DataFrame:
    """left with the columns of matching right rows.

    A column of one name is kept once if it is a key on both sides; other right
    columns that clash get the prefix. semi and anti joins return left columns.
    """
    right_on = left_on if right_on is None else right_on
    if how not in HOW:
        raise EngineError("VALIDATION_ERROR", f"no join of type {how}")
    if not left_on or len(left_on) != len(right_on):
        raise EngineError("VALIDATION_ERROR", "keys must pair up")
    for side, names in ((left, left_on), (right, right_on)):
        if missing := [n for n in names if n not in side.columns]:
            raise EngineError("UNKNOWN_COLUMN", f"no column {missing[0]}", column=missing[0])
    shared = {k for k, r in zip(left_on, right_on, strict=True) if k == r}
    renamed = right.select(*[F.col(quoted(c)).alias(f"__r{i}") for i, c in enumerate(right.columns)])
    at = {c: f"__r{i}" for i, c in enumerate(right.columns)}
    same = functools.reduce(lambda p, q: p & q, [F.col(quoted(k)).eqNullSafe(F.col(at[r])) for k, r in zip(left_on, right_on, strict=True)])
    if how in ("semi", "anti"):
        return left.join(bounded(renamed.select(*[at[r] for r in right_on]).distinct(), max_right_rows), same, HOW[how])
    met = left.join(bounded(renamed, max_right_rows), same, HOW[how])
    taken = set(left.columns)
    keep = [F.col(at[c]).alias(right_prefix + c if c in taken else c) for c in right.columns if c not in shared]
    return met.select(*[F.col(quoted(c)) for c in left.columns], *keep)


def lookup_join(
    left: DataFrame,
    lookup: DataFrame | Callable[[list], list[dict]],
    left_on: list[str],
    right_on: list[str] | None = None,
    how: str = "inner",
    max_right_rows: int = SMALL,
    schema=None,
    right_prefix: str = "right.",
) -> DataFrame:
    """A join with a table, or with what a function gives for the distinct keys.

    The function sees at most max_right_rows keys; more raise BUDGET_EXCEEDED.
    """
    if callable(lookup):
        found = left.select(*[quoted(k) for k in left_on]).distinct().limit(max_right_rows + 1).collect()
        if len(found) > max_right_rows:
            raise EngineError("BUDGET_EXCEEDED", f"more than {max_right_rows} keys to look up", limit=max_right_rows)
        rows = lookup([tuple(r) for r in found])
        lookup = left.sparkSession.createDataFrame(rows, schema)
    return join(left, lookup, left_on, right_on, how, max_right_rows, right_prefix)
