"""Grouped and global aggregates.

Sums of nothing are 0; a global aggregate of no rows has no row. Aggregates that
depend on the order of the input (first, last, any, ties of mode) take it from
the files: path, then row. Most aggregates are single partial-then-final
aggregations. Mode counts the values of each group first. Medians and quantiles are
held in memory only over inputs whose size is known to be small (IN_MEMORY); beyond
it, and for strings, a group's values are counted, dealt by range over all tasks, and
found by their rank from the tasks' counts, so that no group is gathered in one place.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.errors import EngineError, type_error
from tarn.plans.compile import Compiler, quoted
from tarn.plans.spec import Aggregate, Order
from tarn.scratch import scratch

#: Bytes of input, by Spark's estimate, up to which exact quantiles are held in memory.
IN_MEMORY = 256 << 20

ORDINAL = "__ordinal"
ALIASES = {"var": "var_samp", "variance": "var_samp", "stddev": "stddev_samp", "quantile_cont": "quantile"}
NUMERIC = {"sum", "avg", "var_samp", "var_pop", "stddev_samp", "stddev_pop", "quantile"}
ORDERED = {"first", "last", "any", "mode"}
OPS = NUMERIC | ORDERED | {"count", "median", "min", "max", "count_distinct", "approx_count_distinct"}


def simple(op: str, x: Column, quantile: float | None) -> Column:
    d = x.cast("double") if op in NUMERIC else x
    made = {
        "count": lambda: F.count(x),
        "sum": lambda: F.coalesce(F.sum(d), F.lit(0.0)),
        "avg": lambda: F.avg(d),
        "var_samp": lambda: F.var_samp(d),
        "var_pop": lambda: F.var_pop(d),
        "stddev_samp": lambda: F.stddev_samp(d),
        "stddev_pop": lambda: F.stddev_pop(d),
        "median": lambda: F.median(x.cast("double")),
        "quantile": lambda: F.percentile(d, quantile),
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
        "count_distinct": lambda: F.count_distinct(x),
        "approx_count_distinct": lambda: F.count_distinct(x),
        "first": lambda: F.min_by(x, F.col(ORDINAL)),
        "any": lambda: F.min_by(x, F.col(ORDINAL)),
        "last": lambda: F.max_by(x, F.col(ORDINAL)),
    }
    return made[op]()


def mode(df: DataFrame, keys: list[str], x: str, alias: str) -> DataFrame:
    """The most frequent value; of equally frequent ones, that which occurs first."""
    counted = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("__n"), F.min(ORDINAL).alias("__o"))
    return counted.groupBy(*keys).agg(F.min_by(F.col(x), F.struct(-F.col("__n"), F.col("__o"))).alias(alias))


def by_rank(counted: DataFrame, keys: list[str], share: float, alias: str) -> DataFrame:
    """The value at a share of each group's rows, from the numbers n of its values x.

    Between two values numbers are interpolated; of strings the lower one is taken.
    """
    spark = counted.sparkSession
    names = [F.col(k) for k in keys]
    # Written, so that a value's task is the same wherever it is asked for.
    where = scratch(spark, "ranks")
    counted.repartitionByRange(*names, F.col("x")).withColumn("__task", F.spark_partition_id()).write.parquet(where)
    dealt = spark.read.parquet(where)
    # A row for each group and task.
    own = Window.partitionBy(*names)
    held = dealt.groupBy(*names, "__task").agg(F.sum("n").alias("__held"))
    held = held.select(*names, "__task", (F.sum("__held").over(own.orderBy("__task")) - F.col("__held")).alias("__before"), F.sum("__held").over(own).alias("__all"))
    held = held.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)], F.col("__task").alias("__t"), "__before", "__all")
    same = functools.reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys)], F.col("__task") == F.col("__t"))
    upto = F.sum("n").over(Window.partitionBy(*names, "__task").orderBy("x"))
    ranked = dealt.withColumn("__upto", upto).join(held, same).withColumn("__upto", F.col("__upto") + F.col("__before"))
    place = F.lit(float(share)) * (F.col("__all") - 1)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("__upto") - F.col("n") <= rank) & (rank < F.col("__upto")), F.col("x")))

    found = ranked.groupBy(*names).agg(at(F.floor(place)).alias("__low"), at(F.ceil(place)).alias("__high"), F.first(place).alias("__place"))
    value = F.col("__low")
    if dict(found.dtypes)["__low"] != "string":
        part = F.col("__place") - F.floor("__place")
        value = F.when(part == 0, F.col("__low").cast("double")).otherwise((1 - part) * F.col("__low") + part * F.col("__high"))
    return found.select(*names, value.alias(alias))


def ranked(share: float):
    """An aggregate apart, like mode()."""

    def of(df: DataFrame, keys: list[str], x: str, alias: str) -> DataFrame:
        counted = df.where(F.col(x).isNotNull()).groupBy(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)], F.col(x).alias("x")).agg(F.count(F.lit(1)).alias("n"))
        found = by_rank(counted, [f"__g{i}" for i in range(len(keys))], share, "__value")
        return found.select(*[F.col(f"__g{i}").alias(k.strip("`").replace("``", "`")) for i, k in enumerate(keys)], F.col("__value").alias(alias))

    return of


def small(df: DataFrame) -> bool:
    """Whether Spark's estimate of the input leaves it in memory."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= IN_MEMORY


def checked(compiler: Compiler, keys: list[str], spec: dict[str, Aggregate], has_order: bool) -> dict[str, Column]:
    """The input of each aggregate, all of it of supported types."""
    for k in keys:
        if compiler.column(k).kind in ("binary", "nested"):
            raise type_error(f"cannot group by {k}")
    inputs = {}
    for alias, a in spec.items():
        op = ALIASES.get(a.op, a.op)
        if op not in OPS:
            raise EngineError("VALIDATION_ERROR", f"no aggregate {a.op}")
        if a.column is not None and a.expr is not None:
            raise EngineError("VALIDATION_ERROR", f"{alias}: give a column or an expression")
        if op == "quantile" and not (isinstance(a.quantile, (int, float)) and 0 <= a.quantile <= 1):
            raise type_error(f"{alias}: a quantile from 0 to 1 is needed")
        if a.column is None and a.expr is None:
            if op != "count":
                raise EngineError("VALIDATION_ERROR", f"{alias}: {op} needs a column")
            inputs[alias] = F.lit(1)
            continue
        x = compiler.column(a.column) if a.column is not None else compiler(a.expr)
        if x.kind in ("binary", "nested") or (op in NUMERIC and x.kind not in ("number", "null")):
            raise type_error(f"{alias}: {op} of {x.kind}")
        if op == "median" and x.kind not in ("number", "string", "null"):
            raise type_error(f"{alias}: median of {x.kind}")
        if op in ORDERED and not has_order:
            raise EngineError("VALIDATION_ERROR", f"{alias}: {op} needs the order of a file scan")
        inputs[alias] = x.column.cast("double") if op in ("median", "quantile") and x.kind == "number" else x.column
    return inputs


def aggregate(
    df: DataFrame,
    keys: list[str],
    spec: dict[str, Aggregate],
    having=None,
    order_by: tuple[Order, ...] = (),
    limit: int | None = None,
    offset: int = 0,
    max_groups: int | None = None,
) -> DataFrame:
    """Rows of keys and aggregates by alias. having sees the output's columns."""
    compiler = Compiler(df.schema)
    wanted = checked(compiler, keys, spec, ORDINAL in df.columns)
    plain, apart, inputs, in_memory = {}, {}, {}, None
    for i, (alias, a) in enumerate(spec.items()):
        op, name = ALIASES.get(a.op, a.op), f"__x{i}"
        inputs[name] = wanted[alias]
        if op in ("median", "quantile"):
            kind = (compiler.column(a.column) if a.column is not None else compiler(a.expr)).kind
            in_memory = small(df) if in_memory is None and kind != "string" else in_memory
            if kind == "string" or not in_memory:
                apart[alias] = (ranked(0.5 if op == "median" else a.quantile), name)
                continue
        if op == "mode":
            apart[alias] = (mode, name)
        else:
            plain[alias] = simple(op, F.col(name), a.quantile)
    ordinal = [ORDINAL] if ORDINAL in df.columns else []
    base = df.select(*[F.col(quoted(k)) for k in keys], *ordinal, *[c.alias(n) for n, c in inputs.items()])
    names = [quoted(k) for k in keys]
    if not spec:
        out = base.select(*names).distinct()
    elif keys:
        out = base.groupBy(*names).agg(*[c.alias(a) for a, c in plain.items()]) if plain else base.select(*names).distinct()
        for alias, (of, x) in apart.items():
            other = of(base, names, x, alias).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(names)], F.col(quoted(alias)))
            same = functools.reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(names)])
            out = out.join(other, same, "left").drop(*[f"__k{i}" for i in range(len(names))])
    else:
        out = base.agg(F.count(F.lit(1)).alias("__rows"), *[c.alias(a) for a, c in plain.items()])
        for alias, (of, x) in apart.items():  # one row each
            out = out.withColumn("__one", F.lit(1)).join(of(base.withColumn("__one", F.lit(1)), ["__one"], x, alias), "__one", "left").drop("__one")
        out = out.where("__rows > 0").drop("__rows")
    out = out.select(*names, *[F.col(quoted(a)) for a in spec])
    if max_groups is not None and out.limit(max_groups + 1).count() > max_groups:
        raise EngineError("GROUP_LIMIT_EXCEEDED", f"more than {max_groups} groups", limit=max_groups)
    if having is not None:
        out = out.where(Compiler(out.schema).boolean(having))
    if not (order_by or offset or limit is not None):
        return out
    from tarn.operators.rows import sliced_rows, sort_keys

    return sliced_rows(out, sort_keys(out, order_by), order_by, offset, limit)
