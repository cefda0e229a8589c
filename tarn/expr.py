"""Expressions: a small tree of plain values that can be built, sent as JSON and compiled."""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass, fields
from typing import Any

from tarn.errors import EngineError, type_error

Scalar = str | int | float | bool | bytes | datetime.datetime | datetime.date | None


class Expr:
    """Base of all nodes."""

    def to_json(self) -> dict:
        def plain(x):
            if isinstance(x, Expr):
                return x.to_json()
            if isinstance(x, tuple):
                return [plain(y) for y in x]
            if isinstance(x, bytes):
                return {"$bytes": x.hex()}
            if isinstance(x, (datetime.datetime, datetime.date)):
                return {"$time": x.isoformat()}
            return x

        return {"kind": type(self).__name__} | {f.name: plain(getattr(self, f.name)) for f in fields(self)}

    def columns(self) -> set[str]:
        """Names of all columns below."""
        if isinstance(self, Col):
            return {self.name}
        found: set[str] = set()

        def walk(x):
            if isinstance(x, Expr):
                found.update(x.columns())
            elif isinstance(x, tuple):
                for y in x:
                    walk(y)

        for f in fields(self):
            walk(getattr(self, f.name))
        return found


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Col(Expr):
    name: str


@dataclass(frozen=True)
class Compare(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class In(Expr):
    target: Expr
    values: tuple[Expr, ...]
    negated: bool = False


@dataclass(frozen=True)
class Between(Expr):
    target: Expr
    low: Expr
    high: Expr


@dataclass(frozen=True)
class NullCheck(Expr):
    target: Expr
    negated: bool = False


@dataclass(frozen=True)
class Logical(Expr):
    op: str
    operands: tuple[Expr, ...]


@dataclass(frozen=True)
class Not(Expr):
    operand: Expr


@dataclass(frozen=True)
class Like(Expr):
    target: Expr
    pattern: str
    insensitive: bool = False


@dataclass(frozen=True)
class Arith(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Case(Expr):
    whens: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None = None


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


KINDS = {c.__name__: c for c in (Lit, Col, Compare, In, Between, NullCheck, Logical, Not, Like, Arith, Case, Call)}


def from_json(data: Any) -> Expr:
    """The inverse of Expr.to_json()."""

    def plain(x):
        if isinstance(x, dict):
            if "$bytes" in x:
                return bytes.fromhex(x["$bytes"])
            if "$time" in x:
                return datetime.datetime.fromisoformat(x["$time"])
            return from_json(x)
        return tuple(plain(y) for y in x) if isinstance(x, list) else x

    if not isinstance(data, dict) or data.get("kind") not in KINDS:
        raise EngineError("PARSE_ERROR", "not an expression")
    kind = KINDS[data["kind"]]
    try:
        return kind(**{k: plain(v) for k, v in data.items() if k != "kind"})
    except TypeError as e:
        raise EngineError("PARSE_ERROR", f"a {data['kind']} has other parts: {e}") from None


def wrap(x: Any) -> Expr:
    """Expressions as they are, scalars as literals."""
    if isinstance(x, Expr):
        return x
    if isinstance(x, Scalar):
        return Lit(x)
    raise type_error(f"{type(x).__name__} is not a scalar")


def col(name: str) -> Col:
    return Col(name)


def lit(value: Scalar) -> Lit:
    return Lit(value)


def _comparison(op: str):
    def make(left, right) -> Compare:
        return Compare(op, wrap(left), wrap(right))

    make.__name__ = op
    return make


def _arithmetic(op: str):
    def make(left, right) -> Arith:
        return Arith(op, wrap(left), wrap(right))

    make.__name__ = op
    return make


eq, ne, lt, lte, gt, gte = map(_comparison, ("eq", "ne", "lt", "lte", "gt", "gte"))
add, sub, mul, div, mod = map(_arithmetic, ("add", "sub", "mul", "div", "mod"))


def is_in(target, values) -> In:
    return In(wrap(target), tuple(map(wrap, values)))


def not_in(target, values) -> In:
    return In(wrap(target), tuple(map(wrap, values)), True)


def between(target, low, high) -> Between:
    return Between(wrap(target), wrap(low), wrap(high))


def is_null(target) -> NullCheck:
    return NullCheck(wrap(target))


def is_not_null(target) -> NullCheck:
    return NullCheck(wrap(target), True)


def _logical(op: str, operands) -> Logical:
    if len(operands) < 2:
        raise type_error(f"{op} needs two operands at least")
    flat: list[Expr] = []
    for x in operands:
        flat += x.operands if isinstance(x, Logical) and x.op == op else [wrap(x)]
    return Logical(op, tuple(flat))


def and_(*operands) -> Logical:
    return _logical("and", operands)


def or_(*operands) -> Logical:
    return _logical("or", operands)


def not_(operand) -> Not:
    return Not(wrap(operand))


def like(target, pattern: str) -> Like:
    return Like(wrap(target), pattern)


def ilike(target, pattern: str) -> Like:
    return Like(wrap(target), pattern, True)


def fn(name: str, *args) -> Call:
    return Call(name.lower(), tuple(map(wrap, args)))


# Geometry and H3, by name.


def st_point(lon, lat) -> Call:
    return fn("st_point", lon, lat)


def st_bbox(minx, miny, maxx, maxy) -> Call:
    return fn("st_bbox", minx, miny, maxx, maxy)


def st_geojson(shape: dict) -> Lit:
    """A GeoJSON object as a literal."""
    return Lit(json.dumps(shape, separators=(",", ":")))


def st_x(geometry) -> Call:
    return fn("st_x", geometry)


def st_y(geometry) -> Call:
    return fn("st_y", geometry)


def st_intersects(a, b) -> Call:
    return fn("st_intersects", a, b)


def st_disjoint(a, b) -> Call:
    return fn("st_disjoint", a, b)


def st_contains(a, b) -> Call:
    return fn("st_contains", a, b)


def st_within(a, b) -> Call:
    return fn("st_within", a, b)


def st_dwithin(a, b, distance) -> Call:
    return fn("st_dwithin", a, b, distance)


def st_distance(a, b) -> Call:
    return fn("st_distance", a, b)


def st_area(geometry) -> Call:
    return fn("st_area", geometry)


def st_length(geometry) -> Call:
    return fn("st_length", geometry)


def st_centroid(geometry) -> Call:
    return fn("st_centroid", geometry)


def st_envelope(geometry) -> Call:
    return fn("st_envelope", geometry)


def h3_in(cell, cells: list[str]) -> Call:
    return fn("h3_in", cell, json.dumps(cells))


def h3_parent(cell, resolution: int) -> Call:
    return fn("h3_parent", cell, resolution)


def h3_within(cell, origin, distance: int) -> Call:
    return fn("h3_within", cell, origin, distance)


def case(*whens, otherwise=None) -> Case:
    return Case(tuple((wrap(c), wrap(v)) for c, v in whens), None if otherwise is None else wrap(otherwise))


def conjuncts(expr: Expr | None) -> list[Expr]:
    """The operands of top-level ANDs."""
    if expr is None:
        return []
    if isinstance(expr, Logical) and expr.op == "and":
        return [y for x in expr.operands for y in conjuncts(x)]
    return [expr]
