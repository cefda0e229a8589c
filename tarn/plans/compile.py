"""From expressions to Columns, with the types checked before anything runs.

A value's kind decides what may be done with it: `number`, `string`, `boolean`,
`time` (timestamps and dates), `binary`, `null`, or `nested`. Kinds never mix,
but for timestamps against ISO strings.
"""

from __future__ import annotations

import datetime
import functools
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.errors import EngineError, type_error
from tarn.expr import Arith, Between, Call, Case, Col, Compare, Expr, In, Like, Lit, Logical, Not, NullCheck

COMPARE = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge}


@dataclass(frozen=True)
class Typed:
    """A Column, its kind, the literal behind it if it is one, and the point or box that a geometry is known to be."""

    column: Column
    kind: str
    literal: object = None
    is_literal: bool = False
    shape: tuple | None = None


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(t, T.BinaryType):
        return "binary"
    return "null" if isinstance(t, T.NullType) else "nested"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value) -> Typed:
    kinds = ((type(None), "null"), (bool, "boolean"), ((int, float), "number"), (str, "string"), (bytes, "binary"), ((datetime.datetime, datetime.date), "time"))
    for t, kind in kinds:
        if isinstance(value, t):
            return Typed(F.lit(value), kind, value, True)
    raise type_error(f"{type(value).__name__} is not a scalar")


class Compiler:
    """Compiles expressions against a schema."""

    def __init__(self, schema: T.StructType):
        self.types = {f.name: f.dataType for f in schema.fields}

    def column(self, name: str) -> Typed:
        if name not in self.types:
            raise EngineError("UNKNOWN_COLUMN", f"no column {name}", column=name, known=sorted(self.types))
        return Typed(F.col(quoted(name)), kind_of(self.types[name]))

    def __call__(self, e: Expr) -> Typed:
        match e:
            case Lit(value):
                return literal(value)
            case Col(name):
                return self.column(name)
            case Compare(op, left, right):
                a, b = self.alike(self.scalar(left), self.scalar(right))
                return Typed(COMPARE[op](a.column, b.column), "boolean")
            case In(target, values, negated):
                t = self.scalar(target)
                found = t.column.isin(*[self.alike(t, self.scalar(v))[1].column for v in values]) if values else F.lit(False)
                return Typed(~found if negated else found, "boolean")
            case Between(target, low, high):
                t = self.scalar(target)
                at_least, at_most = (self.alike(t, self.scalar(x)) for x in (low, high))
                return Typed((at_least[0].column >= at_least[1].column) & (at_most[0].column <= at_most[1].column), "boolean")
            case NullCheck(target, negated):
                c = self(target).column
                return Typed(c.isNotNull() if negated else c.isNull(), "boolean")
            case Logical(op, operands):
                join = operator.and_ if op == "and" else operator.or_
                return Typed(functools.reduce(join, [self.boolean(x) for x in operands]), "boolean")
            case Not(operand):
                return Typed(~self.boolean(operand), "boolean")
            case Like(target, pattern, insensitive):
                return Typed(self.of_kind(target, "string").rlike(like_regex(pattern, insensitive)), "boolean")
            case Arith(op, left, right):
                return Typed(arithmetic(op, self.number(left), self.number(right)), "number")
            case Case(whens, otherwise):
                return self.case(whens, otherwise)
            case Call(name, args):
                from tarn.functions import scalar

                return scalar.call(name, [self(a) for a in args])
        raise EngineError("PARSE_ERROR", f"no expression: {e!r}")

    def scalar(self, e: Expr) -> Typed:
        t = self(e)
        if t.kind in ("binary", "nested"):
            raise type_error(f"{t.kind} values cannot be compared")
        return t

    def alike(self, a: Typed, b: Typed) -> tuple[Typed, Typed]:
        """Both in comparable form."""
        if a.kind == b.kind or "null" in (a.kind, b.kind):
            return a, b
        if {a.kind, b.kind} == {"time", "string"}:
            return as_time(a), as_time(b)
        raise type_error(f"cannot compare {a.kind} with {b.kind}")

    def of_kind(self, e: Expr, kind: str) -> Column:
        t = self(e)
        if t.kind not in (kind, "null"):
            raise type_error(f"{kind} expected, not {t.kind}")
        return t.column

    def number(self, e: Expr) -> Column:
        return self.of_kind(e, "number").cast("double")

    def boolean(self, e: Expr) -> Column:
        return self.of_kind(e, "boolean").cast("boolean")

    def case(self, whens, otherwise) -> Typed:
        values = [self(v) for _, v in whens] + ([self(otherwise)] if otherwise is not None else [])
        kinds = {v.kind for v in values} - {"null"}
        if len(kinds) > 1:
            raise type_error(f"CASE branches of different kinds: {sorted(kinds)}")
        column = functools.reduce(lambda c, w: c.when(*w), [(self.boolean(c), v.column) for (c, _), v in zip(whens, values)], F)
        return Typed(column.otherwise(values[-1].column) if otherwise is not None else column, next(iter(kinds), "null"))


def as_time(t: Typed) -> Typed:
    """Timestamps as they are, ISO strings and epoch milliseconds as timestamps without a zone (UTC)."""
    if t.kind == "time" or t.kind == "null":
        return t
    if t.kind == "string":
        # An offset is taken into account; sessions run in UTC, which texts without one are in.
        return Typed(t.column.cast("timestamp").cast("timestamp_ntz"), "time")
    if t.kind == "number":
        return Typed(F.timestamp_millis(t.column.cast("long")), "time")
    raise type_error(f"a time is expected, not {t.kind}")


def like_regex(pattern: str, insensitive: bool = False) -> str:
    """% and _ stand for any characters and any one, but for line ends; nothing escapes them."""
    any_one = "[^\\n\\r\\u2028\\u2029]"
    body = "".join({"%": any_one + "*", "_": any_one}.get(c) or re.sub(r"([^\w\s])", r"\\\1", c) for c in pattern)
    return ("(?iu)" if insensitive else "") + f"^{body}\\z"


def arithmetic(op: str, a: Column, b: Column) -> Column:
    """Floating-point arithmetic; a zero divisor gives an infinity or NaN."""
    if op == "add":
        return a + b
    if op == "sub":
        return a - b
    if op == "mul":
        return a * b
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    if op == "div":
        by_zero = F.when((a == 0) | F.isnan(a), nan).when(a > 0, inf).otherwise(-inf)
        return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, by_zero).otherwise(a / b)
    if op == "mod":
        return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, nan).otherwise(a % b)
    raise EngineError("PARSE_ERROR", f"no operator {op}")
