"""What a query asks for, as plain values: the one form behind builder, JSON and SQL."""

from __future__ import annotations

import json
import threading
from dataclasses import dataclass, field, replace

from tarn.errors import EngineError, type_error
from tarn.expr import Expr, from_json


@dataclass(frozen=True)
class Order:
    """A sort term. Unless said, nulls come last ascending and first descending."""

    column: str
    descending: bool = False
    nulls_first: bool | None = None

    @property
    def nulls(self) -> bool:
        return self.descending if self.nulls_first is None else self.nulls_first


@dataclass(frozen=True)
class Aggregate:
    op: str
    column: str | None = None
    expr: Expr | None = None
    quantile: float | None = None


@dataclass(frozen=True)
class QuerySpec:
    """select: plain columns; project: computed ones by alias; distinct applies before offset and limit."""

    source: str
    hive: bool = False
    select: tuple[str, ...] | None = None
    project: tuple[tuple[str, Expr], ...] = ()
    where: Expr | None = None
    distinct: bool = False
    order_by: tuple[Order, ...] = ()
    offset: int = 0
    limit: int | None = None

    def __post_init__(self):
        for name, n in (("offset", self.offset), ("limit", self.limit)):
            if n is not None and (not isinstance(n, int) or isinstance(n, bool) or n < 0):
                raise type_error(f"{name} must be a whole number of 0 or more")

    def with_(self, **changes) -> QuerySpec:
        return replace(self, **changes)

    def columns(self) -> set[str]:
        """Columns that the query names."""
        used = set(self.select or ()) | {o.column for o in self.order_by}
        for e in [self.where, *[e for _, e in self.project]]:
            used |= e.columns() if e is not None else set()
        return used

    def to_json(self) -> dict:
        return {
            "source": self.source,
            "hive": self.hive,
            "select": None if self.select is None else list(self.select),
            "project": [[a, e.to_json()] for a, e in self.project],
            "where": None if self.where is None else self.where.to_json(),
            "distinct": self.distinct,
            "order_by": [[o.column, o.descending, o.nulls_first] for o in self.order_by],
            "offset": self.offset,
            "limit": self.limit,
        }

    @classmethod
    def from_json(cls, data: dict) -> QuerySpec:
        try:
            return cls(
                source=data["source"],
                hive=bool(data.get("hive")),
                select=None if data.get("select") is None else tuple(data["select"]),
                project=tuple((a, from_json(e)) for a, e in data.get("project") or ()),
                where=None if data.get("where") is None else from_json(data["where"]),
                distinct=bool(data.get("distinct")),
                order_by=tuple(Order(*o) for o in data.get("order_by") or ()),
                offset=data.get("offset", 0),
                limit=data.get("limit"),
            )
        except (KeyError, TypeError, ValueError) as e:
            raise EngineError("BOOKMARK_INVALID", f"not a query: {e}") from None


def stable_json(data) -> str:
    """One text for equal values: sorted keys, no blanks."""
    return json.dumps(data, sort_keys=True, separators=(",", ":"), default=str)


def fingerprint(data) -> str:
    """64-bit FNV-1a of the stable JSON."""
    h = 0xCBF29CE484222325
    for b in stable_json(data).encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


@dataclass(frozen=True)
class Budget:
    """Bounds that are checked before or while a query runs. None: unbounded.

    max_files, max_bytes, max_rows_decoded and max_range_requests (column chunks) are checked on the
    pruned files and their footers; max_buffered_rows and max_memory_bytes on the rows that an
    order has to hold; max_concurrent_reads bounds a scan's tasks; signal, an event, stops a run.
    """

    max_files: int | None = None
    max_bytes: int | None = None
    max_rows_decoded: int | None = None
    max_output_rows: int | None = None
    max_buffered_rows: int | None = None
    max_elapsed_ms: int | None = None
    max_range_requests: int | None = None
    max_memory_bytes: int | None = None
    max_concurrent_reads: int | None = None
    signal: threading.Event | None = None

    def check(self, name: str, found: int) -> None:
        most = getattr(self, name)
        if most is not None and found > most:
            raise EngineError("BUDGET_EXCEEDED", f"{name}: {found} is more than {most}", limit=most, found=found)


@dataclass(frozen=True)
class Policy:
    """What a caller may see: columns, rows, and how many. row_filter may be a function of a context."""

    allowed_columns: tuple[str, ...] | None = None
    max_limit: int | None = None
    row_filter: object = None
    context: dict = field(default_factory=dict)

    @property
    def rule(self) -> Expr | None:
        return self.row_filter(self.context) if callable(self.row_filter) else self.row_filter

    def check(self, used: set[str]) -> None:
        """Refuses columns that may not be seen."""
        if self.allowed_columns is not None and (bad := sorted(used - {*self.allowed_columns, "*"})):
            raise EngineError("VALIDATION_ERROR", f"columns are not allowed: {bad}", columns=bad)

    def most(self, limit: int | None) -> int | None:
        """A limit within the policy's."""
        return min((n for n in (limit, self.max_limit) if n is not None), default=None)

    def apply(self, spec: QuerySpec) -> QuerySpec:
        from tarn.expr import and_

        if self.allowed_columns is not None:
            self.check(spec.columns())
            if (spec.select is None and not spec.project) or spec.select == ("*",):
                spec = spec.with_(select=tuple(sorted(set(self.allowed_columns))))
        rule = self.rule
        if rule is not None:
            spec = spec.with_(where=rule if spec.where is None else and_(rule, spec.where))
        return spec.with_(limit=self.most(spec.limit))
