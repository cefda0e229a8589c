"""Version 1 of the JSON query format: one table, filter, order and slice."""

from __future__ import annotations

from tarn import expr as x
from tarn.errors import EngineError
from tarn.plans.spec import Order, QuerySpec

FIELDS = {"version", "from", "select", "where", "distinct", "orderBy", "limit", "offset"}
COMPARE = {"eq": x.eq, "ne": x.ne, "lt": x.lt, "lte": x.lte, "gt": x.gt, "gte": x.gte}


def invalid(message: str) -> EngineError:
    return EngineError("PARSE_ERROR", message)


def column(v) -> x.Expr:
    if not isinstance(v, str):
        raise invalid("a column name is expected")
    return x.col(v)


def condition(data) -> x.Expr:
    """An object of exactly one operator."""
    if not isinstance(data, dict) or len(data) != 1:
        raise invalid("a condition is an object of exactly one operator")
    (op, arg), *_ = data.items()
    if op in ("and", "or"):
        if not isinstance(arg, list) or len(arg) < 2:
            raise invalid(f"{op} takes a list of two conditions at least")
        return (x.and_ if op == "and" else x.or_)(*map(condition, arg))
    if op == "not":
        return x.not_(condition(arg))
    if op in ("isNull", "isNotNull"):
        name = arg[0] if isinstance(arg, list) and len(arg) == 1 else arg
        return (x.is_null if op == "isNull" else x.is_not_null)(column(name))
    if not isinstance(arg, list):
        raise invalid(f"{op} takes a list")
    if op in COMPARE and len(arg) == 2:
        return COMPARE[op](column(arg[0]), arg[1])
    if op in ("in", "notIn") and len(arg) == 2 and isinstance(arg[1], list):
        return (x.is_in if op == "in" else x.not_in)(column(arg[0]), arg[1])
    if op == "between" and len(arg) == 3:
        return x.between(column(arg[0]), arg[1], arg[2])
    if op in ("like", "ilike") and len(arg) == 2 and isinstance(arg[1], str):
        return (x.like if op == "like" else x.ilike)(column(arg[0]), arg[1])
    raise invalid(f"{op} is no operator of these arguments")


def parse(data: dict) -> QuerySpec:
    if not isinstance(data, dict) or data.get("version") != 1:
        raise invalid("version 1 is expected")
    if extra := set(data) - FIELDS:
        raise invalid(f"unknown fields: {sorted(extra)}")
    if not isinstance(data.get("from"), str):
        raise invalid("from names a path")
    orders = []
    for o in data.get("orderBy") or []:
        if not isinstance(o, dict) or not isinstance(o.get("column"), str) or o.get("direction", "asc") not in ("asc", "desc") or o.get("nulls") not in (None, "first", "last"):
            raise invalid("orderBy holds objects of column, direction and nulls")
        nulls = None if o.get("nulls") is None else o["nulls"] == "first"
        orders.append(Order(o["column"], o.get("direction") == "desc", nulls))
    return QuerySpec(
        source=data["from"],
        select=None if data.get("select") is None else tuple(data["select"]),
        where=None if data.get("where") is None else condition(data["where"]),
        distinct=bool(data.get("distinct")),
        order_by=tuple(orders),
        offset=data.get("offset") or 0,
        limit=data.get("limit"),
    )
