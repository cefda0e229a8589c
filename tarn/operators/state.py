"""Operator state: what a query can go on from, over more files, another day or another machine.

A state is a small JSON value that names Parquet tables below a shared folder:

* of an order with a limit, the rows that can still be among the first;
* of an order without one, its runs, one for each query so far;
* of groups, partial aggregates that merge exactly: counts, sums, means with their
  squared deviations, extremes, and for distinct values, medians, quantiles and modes
  the values of each group with their numbers.

Nothing of it passes through the driver. Rows of equal rank stay in the order in
which the queries saw them.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.errors import EngineError
from tarn.operators import aggregate as agg
from tarn.operators import rows as row_ops
from tarn.plans.compile import Compiler, quoted
from tarn.plans.spec import Aggregate, QuerySpec, fingerprint
from tarn.scratch import scratch

#: From 2 on no two rows of a state have one place.
VERSION = 2
#: Aggregates that are made from the values of a group and their numbers.
BY_VALUE = {"count_distinct", "approx_count_distinct", "median", "quantile", "mode"}


def _check(state: dict | None, kind: str, of: str) -> list[str]:
    """The tables of a state, if it is one of this query."""
    if state is None:
        return []
    if not isinstance(state, dict) or state.get("version") != VERSION or state.get("kind") != kind or not isinstance(state.get("tables"), list) or not isinstance(state.get("units"), int):
        raise EngineError("BOOKMARK_INVALID", f"not a state of a {kind}")
    if state.get("of") != of:
        raise EngineError("BOOKMARK_INVALID", "the state is of another query")
    return state["tables"]


def _kept(df: DataFrame, folder: str, name: str) -> tuple[DataFrame, str]:
    where = f"{folder.rstrip('/')}/{name}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where), where


def _marked(df: DataFrame, unit: int) -> DataFrame:
    """df with its rows' places, behind those of all units before."""
    place = F.col(agg.ORDINAL) if agg.ORDINAL in df.columns else F.struct(F.lit("").alias("path"), F.monotonically_increasing_id().alias("row"))
    return df.withColumn(agg.ORDINAL, F.struct(F.lit(unit).alias("unit"), place["path"].alias("path"), place["row"].alias("row")))


def ordered(spark: SparkSession, df: DataFrame, spec: QuerySpec, kind: str, state: dict | None, folder: str | None) -> tuple[DataFrame, dict]:
    """Rows of df and of those behind the state, in spec's order; kind: top-k or sort."""
    own = fingerprint([kind, [[o.column, o.descending, o.nulls] for o in spec.order_by], spec.offset, spec.limit, spec.to_json()["select"], spec.to_json()["project"]])
    tables, unit = _check(state, kind, own), state["units"] if state else 0
    folder = folder or scratch(spark, "state")
    rows = _marked(df if spec.where is None else df.where(Compiler(df.schema).boolean(spec.where)), unit)
    if spec.select != ("*",) and (spec.select or spec.project):  # nothing is kept that is not asked for
        needed = spec.with_(where=None).columns()
        rows = rows.select(*[quoted(c) for c in rows.columns if c in needed or c == agg.ORDINAL])
    if kind == "sort":
        _, made = _kept(rows, folder, f"run-{unit:06d}")
        tables = [*tables, made]
        rows = spark.read.schema(rows.schema).parquet(*tables)
    else:
        before = [spark.read.schema(rows.schema).parquet(t) for t in tables]
        rows = functools.reduce(DataFrame.unionByName, before, rows)
        first = rows.orderBy(*row_ops.sort_keys(rows, spec.order_by), F.col(agg.ORDINAL)).limit(spec.offset + spec.limit)
        rows, made = _kept(first, folder, f"top-{unit:06d}")
        tables = [made]
    return row_ops.run(rows, spec.with_(where=None)), {"version": VERSION, "kind": kind, "of": own, "units": unit + 1, "tables": tables}


def _moments(x: Column) -> Column:
    return F.struct(F.count(x).alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias("m2"))


def _merged_moments(parts: Column) -> Column:
    """Counts, means and squared deviations of parts, put together one after another."""

    def both(a, b):
        n = a["n"] + b["n"]
        gap, share = b["mean"] - a["mean"], F.when(n > 0, b["n"] / n).otherwise(F.lit(0.0))
        return F.struct(n.alias("n"), (a["mean"] + gap * share).alias("mean"), (a["m2"] + b["m2"] + gap * gap * a["n"] * share).alias("m2"))

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(F.collect_list(parts), zero, both)


class Partials:
    """Partial aggregates of a query's groups: one table of columns, and one of values for each aggregate that needs them."""

    def __init__(self, schema, keys: list[str], spec: dict[str, Aggregate]):
        self.keys, self.spec = keys, spec
        self.names = [F.col(f"k{i}") for i in range(len(keys))]
        self.by_value = [a for a, s in spec.items() if agg.ALIASES.get(s.op, s.op) in BY_VALUE]
        self.fields = list(spec)
        self.inputs = agg.checked(Compiler(schema), keys, spec, has_order=True)

    def _op(self, alias: str) -> str:
        return agg.ALIASES.get(self.spec[alias].op, self.spec[alias].op)

    def _base(self, df: DataFrame) -> DataFrame:
        keys = [F.col(quoted(k)).alias(f"k{i}") for i, k in enumerate(self.keys)]
        return df.select(*keys, F.col(agg.ORDINAL), *[x.alias(f"x{i}") for i, x in enumerate(self.inputs.values())])

    def of(self, df: DataFrame, unit: int) -> dict[str, DataFrame]:
        """The partials of one unit's rows."""
        base = self._base(_marked(df, unit))
        made = [F.count(F.lit(1)).alias("rows")]
        out = {}
        for i, alias in enumerate(self.fields):
            x, op = F.col(f"x{i}"), self._op(alias)
            if alias in self.by_value:
                out[f"v{i}"] = base.where(x.isNotNull()).groupBy(*self.names, x.alias("x")).agg(F.count(F.lit(1)).alias("n"), F.min(agg.ORDINAL).alias("o"))
                continue
            d = x.cast("double") if op in agg.NUMERIC else x
            part = {
                "count": lambda x=x: F.count(x),
                "sum": lambda d=d: F.coalesce(F.sum(d), F.lit(0.0)),
                "min": lambda x=x: F.min(x),
                "max": lambda x=x: F.max(x),
                "first": lambda x=x: F.struct(F.min(agg.ORDINAL).alias("o"), F.min_by(x, F.col(agg.ORDINAL)).alias("x")),
                "last": lambda x=x: F.struct(F.max(agg.ORDINAL).alias("o"), F.max_by(x, F.col(agg.ORDINAL)).alias("x")),
            }
            made.append(part.get("first" if op == "any" else op, lambda d=d: _moments(d))().alias(f"p{i}"))
        return {"plain": base.groupBy(*self.names).agg(*made)} | out

    def merged(self, units: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """The partials of several units as those of one."""
        together = {t: functools.reduce(DataFrame.unionByName, [u[t] for u in units]) for t in units[0]}
        made = [F.sum("rows").alias("rows")]
        for i, alias in enumerate(self.fields):
            p, op = F.col(f"p{i}"), self._op(alias)
            if alias in self.by_value:
                continue
            part = {"count": lambda p=p: F.sum(p), "sum": lambda p=p: F.sum(p), "min": lambda p=p: F.min(p), "max": lambda p=p: F.max(p)}
            part |= {"first": lambda p=p: F.min_by(p, p["o"]), "any": lambda p=p: F.min_by(p, p["o"]), "last": lambda p=p: F.max_by(p, p["o"])}
            made.append(part.get(op, lambda p=p: _merged_moments(p))().alias(f"p{i}"))
        out = {"plain": together["plain"].groupBy(*self.names).agg(*made)}
        for t in together:
            if t != "plain":
                out[t] = together[t].groupBy(*self.names, "x").agg(F.sum("n").alias("n"), F.min("o").alias("o"))
        return out

    def finished(self, parts: dict[str, DataFrame]) -> DataFrame:
        """The groups' rows."""
        plain, columns = parts["plain"].where("rows > 0"), {}
        for i, alias in enumerate(self.fields):
            p, op = F.col(f"p{i}"), self._op(alias)
            if alias in self.by_value:
                plain = _joined(plain, self._from_values(parts[f"v{i}"], alias, f"p{i}"), len(self.keys))
                columns[alias] = F.coalesce(p, F.lit(0)) if op.endswith("count_distinct") else p
                continue
            n = F.col(f"p{i}.n") if op in ("avg", "var_samp", "var_pop", "stddev_samp", "stddev_pop") else None
            if op == "avg":
                columns[alias] = F.when(n > 0, p["mean"])
            elif op.startswith(("var", "stddev")):
                least, base = (1, n - 1) if op.endswith("samp") else (0, n)
                variance = F.when(n > least, p["m2"] / base)
                columns[alias] = F.sqrt(variance) if op.startswith("stddev") else variance
            else:
                columns[alias] = p["x"] if op in ("first", "any", "last") else p
        return plain.select(*[c.alias(k) for c, k in zip(self.names, self.keys, strict=True)], *[c.alias(a) for a, c in columns.items()])

    def _from_values(self, values: DataFrame, alias: str, name: str) -> DataFrame:
        op, keys = self._op(alias), [f"k{i}" for i in range(len(self.keys))]
        if op.endswith("count_distinct"):
            return values.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
        if op == "mode":
            return values.groupBy(*keys).agg(F.min_by("x", F.struct(-F.col("n"), F.col("o"))).alias(name))
        share = 0.5 if op == "median" else self.spec[alias].quantile
        return agg.by_rank(values.select(*keys, "x", "n"), keys, share, name)


def _joined(left: DataFrame, right: DataFrame, keys: int) -> DataFrame:
    """left with right's columns, by keys k0, k1, … that may be null; without keys both have one row at most."""
    if not keys:
        return left.withColumn("one", F.lit(1)).join(right.withColumn("one", F.lit(1)), "one", "left").drop("one")
    renamed = right.select(*[F.col(f"k{i}").alias(f"r{i}") for i in range(keys)], *[c for c in right.columns if not c.startswith("k")])
    same = functools.reduce(lambda a, b: a & b, [F.col(f"k{i}").eqNullSafe(F.col(f"r{i}")) for i in range(keys)])
    return left.join(renamed, same, "left").drop(*[f"r{i}" for i in range(keys)])


def _identity(keys: list[str], spec: dict[str, Aggregate]) -> str:
    return fingerprint([keys, [[n, a.op, a.column, None if a.expr is None else a.expr.to_json(), a.quantile] for n, a in spec.items()]])


def _written(parts: dict[str, DataFrame], folder: str, unit: int) -> dict[str, str]:
    return {t: _kept(df, folder, f"groups-{unit:06d}-{t}")[1] for t, df in parts.items()}


def _read(spark: SparkSession, tables: dict[str, str]) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(where) for t, where in tables.items()}


def aggregated(spark: SparkSession, df: DataFrame, keys: list[str], spec: dict[str, Aggregate], state: dict | None, folder: str | None) -> tuple[DataFrame, dict]:
    """Groups of df's rows and of those behind the state."""
    own = _identity(keys, spec)
    tables, unit = _check(state, "groups", own), state["units"] if state else 0
    partials = Partials(df.schema, keys, spec)
    parts = partials.of(df, unit)
    if tables:
        parts = partials.merged([_read(spark, tables[0]), parts])
    made = _written(parts, folder or scratch(spark, "state"), unit)
    return partials.finished(_read(spark, made)), {"version": VERSION, "kind": "groups", "of": own, "units": unit + 1, "tables": [made]}


def aggregate_units(spark: SparkSession, units: list, scan, keys: list[str], spec: dict[str, Aggregate], folder: str | None = None, max_concurrent: int = 4, max_buffered: int = 16) -> DataFrame:
    """Groups over work units: each gives written partials, which are merged in the units' order.

    scan(unit) gives its rows. At most max_concurrent units run and max_buffered partials wait at a time.
    As many partials of a level are merged into one of the next, so that a value is written once a level.
    """
    from tarn.plans.tasks import fan_in

    folder, made = folder or scratch(spark, "units"), {}

    def run(numbered):
        number, unit = numbered
        df = scan(unit)
        made.setdefault("partials", Partials(df.schema, keys, spec))
        return number, _written(made["partials"].of(df, number), folder, number)

    def reduce(held: list, part) -> list:
        number, tables = part
        held, level, width = [*held, (0, tables)], 0, max(2, max_buffered)
        while len(held) >= width and held[-width][0] == level:
            merged = made["partials"].merged([_read(spark, t) for _, t in held[-width:]])
            level += 1
            held = [*held[:-width], (level, _written(merged, f"{folder}/merged-{level}", number))]
        return held

    if not units:
        raise EngineError("VALIDATION_ERROR", "there are no units")
    held = [_read(spark, t) for _, t in fan_in(enumerate(units), run, reduce, [], max_concurrent, max_buffered=max_buffered)]
    return made["partials"].finished(made["partials"].merged(held) if len(held) > 1 else held[0])
