"""Runs parsed statements: subqueries first, then one DataFrame plan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import fields, is_dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn import expr as x
from tarn.errors import EngineError, unsupported
from tarn.operators import aggregate as agg
from tarn.operators import rows as row_ops
from tarn.operators.joins import join as join_frames
from tarn.plans.compile import Compiler, quoted
from tarn.plans.spec import Aggregate, Order, QuerySpec
from tarn.sql.ast import AggCall, Describe, InQuery, ScalarQuery, Select, Star, Table
from tarn.sql.parser import parse

#: Rows that the right side of a SQL JOIN may have; None lifts the bound. IN (SELECT …) has none.
JOIN_ROWS = 100_000


def walk(e) -> Iterator[x.Expr]:
    """An expression and all below it, subqueries' insides left out."""
    if isinstance(e, tuple):
        for y in e:
            yield from walk(y)
    elif isinstance(e, x.Expr):
        yield e
        for f in fields(e):
            v = getattr(e, f.name)
            if isinstance(v, (x.Expr, tuple)):
                yield from walk(v)


def rewrite(e, change):
    """An expression with change(node) applied from the leaves up."""
    if isinstance(e, tuple):
        return tuple(rewrite(y, change) for y in e)
    if not isinstance(e, x.Expr) or not is_dataclass(e):
        return e
    made = replace(e, **{f.name: rewrite(v, change) for f in fields(e) if isinstance(v := getattr(e, f.name), (x.Expr, tuple))})
    return change(made)


def execute(lake, text: str, parameters: tuple = (), tables: dict[str, str] | None = None, join_rows: int | None = JOIN_ROWS) -> DataFrame:
    found = parse(text, tuple(parameters))
    if isinstance(found, Describe):
        return describe(lake, found.table, tables or {})
    runner = Runner(lake, tables or {}, join_rows)
    try:
        out = runner.select(found)
    except EngineError as e:
        name = str(e.details.get("column") or "").rpartition(".")[2]
        if e.code == "TARN_UNKNOWN_COLUMN" and name in runner.hidden:
            raise EngineError("VALIDATION_ERROR", f"columns are not allowed: ['{name}']", columns=[name]) from None
        raise
    if lake.policy and lake.policy.max_limit is not None:
        out = out.limit(lake.policy.max_limit)
    return lake.finished(out)


def describe(lake, table: str, tables: dict[str, str]) -> DataFrame:
    df = Runner(lake, tables, None).scan(Table(table, table))
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields if f.name != agg.ORDINAL]
    return lake.spark.createDataFrame(rows, "column string, type string, nullable boolean")


class Runner:
    def __init__(self, lake, tables: dict[str, str], join_rows: int | None):
        self.lake, self.tables, self.join_rows, self.ctes = lake, tables, join_rows, {}
        self.hidden: set[str] = set()  # columns that the policy keeps back

    def scan(self, t: Table, where: x.Expr | None = None) -> DataFrame:
        if t.name in self.ctes:
            return self.ctes[t.name]
        if t.name not in self.lake.tables and t.name not in self.tables:
            raise EngineError("UNKNOWN_TABLE", f"no table {t.name}", table=t.name)
        spec = QuerySpec(t.name if t.name in self.lake.tables else self.tables[t.name], where=where)
        df = self.lake.relation(spec)
        if self.lake.policy and self.lake.policy.allowed_columns is not None:
            self.hidden |= set(self.lake.source(spec, check=False).columns) - set(df.columns)
        return df

    def select(self, s: Select) -> DataFrame:
        if s.cte:
            name, body = s.cte
            self.ctes[name] = self.select(body)
        s = self.resolved(s)
        subqueries = [e for e in x.conjuncts(s.where) if isinstance(e, InQuery)]
        roots = [e for e, _ in s.items] + [e for e in (s.where, s.having) if e is not None]
        if len([e for r in roots for e in walk(r) if isinstance(e, InQuery)]) != len(subqueries):
            raise unsupported("IN (SELECT …) stands as a condition of its own, joined by AND")
        if len(subqueries) > 1:
            raise unsupported("one IN (SELECT …) at most")
        grouped = bool(s.group_by) or s.having is not None or any(isinstance(e, AggCall) for i, _ in s.items for e in walk(i))
        if grouped and (s.join or subqueries):
            raise unsupported("aggregates over a join or an IN subquery are not supported")
        if s.join:
            df = self.joined(s)
        else:
            s = self.unqualified(s)
            df = self.scan(s.table, s.where if not subqueries else None)
        if subqueries:
            rest = [e for e in x.conjuncts(s.where) if not isinstance(e, InQuery)]
            own = next(e for e in x.conjuncts(s.where) if isinstance(e, InQuery))
            df = self.in_query(df, own)
            s = replace(s, where=None if not rest else rest[0] if len(rest) == 1 else x.and_(*rest))
        return self.grouped(df, s) if grouped else self.plain(df, s)

    def unqualified(self, s: Select) -> Select:
        """Without the table's name before columns."""
        prefix = s.table.alias + "."

        def change(e):
            if isinstance(e, x.Col) and "." in e.name:
                if not e.name.startswith(prefix):
                    raise EngineError("UNKNOWN_COLUMN", f"no column {e.name}", column=e.name)
                return x.Col(e.name.removeprefix(prefix))
            return e

        one = lambda n: n.removeprefix(prefix)
        return replace(
            s,
            items=tuple((rewrite(e, change), a) for e, a in s.items),
            where=rewrite(s.where, change),
            having=rewrite(s.having, change),
            group_by=tuple(map(one, s.group_by)),
            order_by=tuple(replace(o, column=one(o.column)) for o in s.order_by),
        )

    def resolved(self, s: Select) -> Select:
        """Scalar subqueries as literals."""

        def change(e):
            return x.Lit(self.scalar(e.query)) if isinstance(e, ScalarQuery) else e

        return replace(s, items=tuple((rewrite(e, change), a) for e, a in s.items), where=rewrite(s.where, change), having=rewrite(s.having, change))

    def scalar(self, q: Select):
        has_aggregate = any(isinstance(e, AggCall) for i, _ in q.items for e in walk(i))
        if len(q.items) != 1 or isinstance(q.items[0][0], Star) or not (has_aggregate and not q.group_by or q.limit == 1):
            raise unsupported("a scalar subquery gives one column, of an aggregate or LIMIT 1")
        row = Runner(self.lake, self.tables, self.join_rows).select(q).head(1)
        return row[0][0] if row else None

    def in_query(self, df: DataFrame, e: InQuery) -> DataFrame:
        q = e.query
        if q.group_by or q.having is not None or q.order_by or q.limit is not None or q.offset or q.join or q.distinct:
            raise unsupported("an IN subquery is a plain SELECT of one table")
        if not all(isinstance(k, x.Col) for k in e.keys) or not all(isinstance(i, x.Col) for i, _ in q.items) or len(q.items) != len(e.keys):
            raise unsupported("an IN subquery gives a column for each key")
        right = Runner(self.lake, self.tables, self.join_rows).select(replace(q, items=tuple((i, f"k{n}") for n, (i, _) in enumerate(q.items))))
        names = [f"k{n}" for n in range(len(e.keys))]
        # Rows are only kept or dropped: no bound on the right side, Spark deals both by key where it is large.
        return join_frames(df, right, [k.name for k in e.keys], names, "anti" if e.negated else "semi")

    def joined(self, s: Select) -> DataFrame:
        """Both sides with columns named alias.column."""
        sides = []
        for t in (s.table, s.join.table):
            df = self.scan(t)
            sides.append(df.select(*[F.col(quoted(c)).alias(f"{t.alias}.{c}") for c in df.columns if c != agg.ORDINAL]))
        left_on = [f"{s.table.alias}.{a}" for a, _ in s.join.pairs]
        right_on = [f"{s.join.table.alias}.{b}" for _, b in s.join.pairs]
        return join_frames(*sides, left_on, right_on, s.join.how, self.join_rows)

    def named(self, df: DataFrame, s: Select):
        """A function from names as written to columns of df."""

        def of(name: str) -> str:
            if name in df.columns or not s.join:
                return name
            if name in s.join.using:
                return f"{s.table.alias}.{name}"
            found = [c for c in df.columns if c.partition(".")[2] == name]
            if len(found) > 1:
                raise EngineError("UNKNOWN_COLUMN", f"{name} is in both tables", column=name)
            return found[0] if found else name

        return of

    def plain(self, df: DataFrame, s: Select) -> DataFrame:
        of = self.named(df, s)
        change = lambda e: x.Col(of(e.name)) if isinstance(e, x.Col) else e
        items: list[tuple[str, x.Expr]] = []
        for e, alias in s.items:
            if isinstance(e, Star):
                items += [(c, x.Col(c)) for c in df.columns if c != agg.ORDINAL]
            else:
                items.append((alias or e.name.rpartition(".")[2], rewrite(e, change)))
        aliases = dict(items)
        # A name in ORDER BY is a source column, else a plain alias of one.
        orders = []
        for o in s.order_by:
            name = of(o.column)
            if name not in df.columns and isinstance(aliases.get(o.column), x.Col):
                name = aliases[o.column].name
            orders.append(replace(o, column=name))
        computed = [o for o in orders if o.column not in df.columns and o.column in aliases]
        if computed:
            df = df.withColumns({o.column: Compiler(df.schema)(aliases[o.column]).column for o in computed})
        spec = QuerySpec(s.table.name, project=tuple(items), where=rewrite(s.where, change), distinct=s.distinct, order_by=tuple(orders), offset=s.offset, limit=s.limit)
        return row_ops.run(df, spec)

    def grouped(self, df: DataFrame, s: Select) -> DataFrame:
        """Aggregates under names of their own, then the items computed over them."""
        if s.where is not None:
            df = df.where(Compiler(df.schema).boolean(s.where))
        calls: dict[AggCall, str] = {}

        def lift(e):
            if isinstance(e, AggCall):
                return x.Col(calls.setdefault(e, f"__a{len(calls)}"))
            return e

        items: list[tuple[str, x.Expr]] = []
        for e, alias in s.items:
            if isinstance(e, Star):
                raise unsupported("* is not supported with GROUP BY")
            items.append((alias or e.name, rewrite(e, lift)))
        known = dict(items)
        having = rewrite(s.having, lift)
        having = rewrite(having, lambda e: known.get(e.name, e) if isinstance(e, x.Col) and e.name not in s.group_by else e)
        for _, e in items:
            if bad := [c for c in e.columns() if c not in s.group_by and not c.startswith("__a")]:
                raise unsupported(f"{bad[0]} is neither grouped nor aggregated")
        spec = {name: Aggregate(c.op, None if not isinstance(c.arg, x.Col) else c.arg.name, None if isinstance(c.arg, x.Col) else c.arg, c.quantile) for c, name in calls.items()}
        rows = agg.aggregate(df, list(s.group_by), spec, having)
        compiler = Compiler(rows.schema)
        extra = [g for g in s.group_by if g not in known]
        wide = rows.select(*[compiler(e).column.alias(a) for a, e in items], *[F.col(quoted(g)).alias(g) for g in extra])
        out = QuerySpec(s.table.name, select=tuple(known), distinct=s.distinct, order_by=s.order_by, offset=s.offset, limit=s.limit)
        return row_ops.run(wide, out)


def spec_of(text: str, parameters: tuple = ()) -> QuerySpec:
    """A plain single-table SELECT as a query description."""
    s = parse(text, tuple(parameters))
    if not isinstance(s, Select) or s.join or s.cte or s.group_by or s.having is not None or any(isinstance(e, AggCall) for i, _ in s.items for e in walk(i)):
        raise unsupported("only a plain SELECT of one table has a description")
    star = any(isinstance(e, Star) for e, _ in s.items)
    return QuerySpec(s.table.name, select=("*",) if star else None, project=tuple((a or e.name, e) for e, a in s.items if not isinstance(e, Star)), where=s.where, distinct=s.distinct, order_by=tuple(Order(o.column, o.descending, o.nulls_first) for o in s.order_by), offset=s.offset, limit=s.limit)
