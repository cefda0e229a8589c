"""Projection, filter, order, distinct, offset and limit of one query description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.errors import EngineError, type_error
from tarn.operators.aggregate import ORDINAL
from tarn.plans.compile import Compiler, quoted
from tarn.plans.spec import Order, QuerySpec
from tarn.scratch import scratch


def sort_keys(df: DataFrame, order_by: tuple[Order, ...]) -> list[Column]:
    compiler, keys = Compiler(df.schema), []
    for o in order_by:
        found = compiler.column(o.column)
        if found.kind in ("binary", "nested"):
            raise type_error(f"cannot order by {o.column}")
        c = found.column
        if o.descending:
            keys.append(c.desc_nulls_first() if o.nulls else c.desc_nulls_last())
        else:
            keys.append(c.asc_nulls_first() if o.nulls else c.asc_nulls_last())
    return keys


def outputs(df: DataFrame, spec: QuerySpec) -> list[Column]:
    """Selected columns, then computed ones; all columns if neither is given."""
    compiler = Compiler(df.schema)
    visible = [c for c in df.columns if c != ORDINAL]
    if spec.select is None:
        names = [] if spec.project else visible
    else:
        names = [n for s in spec.select for n in (visible if s == "*" else [s])]
    made = [compiler.column(n).column.alias(n) for n in names] + [compiler(e).column.alias(a) for a, e in spec.project]
    all_names = names + [a for a, _ in spec.project]
    if len(set(all_names)) < len(all_names):
        raise EngineError("VALIDATION_ERROR", "two output columns have one name")
    return made


def run(df: DataFrame, spec: QuerySpec) -> DataFrame:
    """The rows of a description over a source.

    Order is by source columns, so a hidden column may decide it. Distinct rows
    keep their first place in the order. With a limit but no order, the order of
    files and rows decides, so that the same rows come back every time.
    """
    if spec.where is not None:
        df = df.where(Compiler(df.schema).boolean(spec.where))
    keys = sort_keys(df, spec.order_by)
    scan = [F.col(ORDINAL)] if ORDINAL in df.columns else []
    if keys or spec.limit is not None or spec.offset:
        keys = keys + scan
    made = outputs(df, spec)
    if spec.distinct and keys:
        named = [f"__o{i}" for i in range(len(made))]
        wide = df.select(*[c.alias(n) for c, n in zip(made, named, strict=True)], *[F.col(quoted(c)) for c in df.columns])
        first = F.row_number().over(Window.partitionBy(*named).orderBy(*keys))
        rows = sliced_rows(wide.withColumn("__nth", first).where("__nth = 1"), keys, spec.order_by, spec.offset, spec.limit)
        return rows.select(*[F.col(n).alias(c) for n, c in zip(named, df.select(*made).columns, strict=True)])
    if spec.distinct:  # of a table without places, in no order
        return sliced_rows(df.select(*made).distinct(), [], (), spec.offset, spec.limit)
    # Sorted before it is projected: with a limit this is one top-k operator.
    return sliced_rows(df, keys, spec.order_by, spec.offset, spec.limit).select(*made)


#: Rows up to which those that an offset skips are held by a task, to find the first that is left.
SKIPPED = 100_000


def sliced_rows(df: DataFrame, keys: list[Column], order_by: tuple[Order, ...], offset: int, limit: int | None) -> DataFrame:
    """df in the order of keys, which are order_by and the rows' places if they have any, from an offset on.

    Spark's own offset without a limit puts all rows into one task. Here the first row that is
    left is found, and all rows from it on are sorted by all tasks.
    """
    if limit is not None or not offset:
        df = df.orderBy(*keys) if keys else df
        df = df.offset(offset) if offset else df
        return df if limit is None else df.limit(limit)
    if ORDINAL in df.columns and offset <= SKIPPED:  # an order without ties
        terms = [*order_by, Order(ORDINAL, False)]
        own = [F.col(quoted(o.column)) for o in terms]
        first = df.orderBy(*keys).offset(offset).limit(1).select(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(own)])).scalar()
        left = _from_on([(c, first[f"c{i}"], o) for i, (c, o) in enumerate(zip(own, terms, strict=True))])
        return df.where(first.isNotNull() & left).orderBy(*keys)
    return _written_from(df.orderBy(*keys) if keys else df, offset)


def _from_on(terms: list[tuple[Column, Column, Order]]) -> Column:
    """Whether a row's values are those of another, or behind them in their order."""
    found = F.lit(True)
    for own, other, o in reversed(terms):
        on_null = own.isNotNull() & other.isNull() if o.nulls else own.isNull() & other.isNotNull()
        behind = F.when(own.isNull() | other.isNull(), on_null).otherwise(own < other if o.descending else own > other)
        found = behind | (own.eqNullSafe(other) & found)
    return found


def _written_from(df: DataFrame, offset: int) -> DataFrame:
    """The rows of df, which is in order, from an offset on: written with their places, which the tasks' counts number."""
    where = scratch(df.sparkSession, "sorted")
    df.withColumns({"__task": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}).write.parquet(where)
    rows = df.sparkSession.read.parquet(where)
    left = offset
    for task, first, n in sorted(tuple(r) for r in rows.groupBy("__task").agg(F.min("__at"), F.count(F.lit(1))).collect()):  # a row for each task
        if left < n:
            return rows.where(F.col("__at") >= first + left).orderBy("__at").drop("__task", "__at")
        left -= n
    return rows.limit(0).drop("__task", "__at")
