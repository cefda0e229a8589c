"""The parsed form of a statement. Expressions are those of tarn.expr and four more."""

from __future__ import annotations

from dataclasses import dataclass

from tarn.expr import Expr
from tarn.plans.spec import Order


@dataclass(frozen=True)
class AggCall(Expr):
    """An aggregate call; arg is None for count(*)."""

    op: str
    arg: Expr | None = None
    distinct: bool = False
    quantile: float | None = None


@dataclass(frozen=True)
class ScalarQuery(Expr):
    query: Select


@dataclass(frozen=True)
class InQuery(Expr):
    keys: tuple[Expr, ...]
    query: Select
    negated: bool = False


@dataclass(frozen=True)
class Star(Expr):
    pass


@dataclass(frozen=True)
class Table:
    name: str
    alias: str


@dataclass(frozen=True)
class Join:
    table: Table
    how: str
    pairs: tuple[tuple[str, str], ...]
    using: tuple[str, ...] = ()


@dataclass(frozen=True)
class Select:
    items: tuple[tuple[Expr, str | None], ...]
    table: Table
    join: Join | None = None
    where: Expr | None = None
    group_by: tuple[str, ...] = ()
    having: Expr | None = None
    order_by: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int = 0
    distinct: bool = False
    cte: tuple[str, Select] | None = None


@dataclass(frozen=True)
class Describe:
    table: str
