"""Filters, projections and windowed aggregates on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.errors import unsupported
from tarn.operators.aggregate import ALIASES, NUMERIC, simple
from tarn.operators.rows import outputs
from tarn.plans.compile import Compiler, quoted
from tarn.plans.spec import Aggregate, QuerySpec


def read_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as they appear in a folder."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", max_files_per_trigger) if max_files_per_trigger else reader
    return reader.parquet(path)


def apply(df: DataFrame, spec: QuerySpec) -> DataFrame:
    """The filter and projection of a description; order and slices need an end, which streams lack."""
    if spec.order_by or spec.offset or spec.limit is not None or spec.distinct:
        raise unsupported("a stream has no order, slice or distinct rows")
    if spec.where is not None:
        df = df.where(Compiler(df.schema).boolean(spec.where))
    return df.select(*outputs(df, spec))


def windowed(df: DataFrame, time: str, window: str, watermark: str, keys: list[str], spec: dict[str, Aggregate], slide: str | None = None) -> DataFrame:
    """Aggregates by time window and keys; rows later than the watermark are left out."""
    aggs = []
    for alias, a in spec.items():
        op = ALIASES.get(a.op, a.op)
        if op not in NUMERIC | {"count", "min", "max"}:
            raise unsupported(f"{a.op} is not supported on streams")
        c = F.lit(1) if a.column is None and a.expr is None else Compiler(df.schema)(a.expr).column if a.expr is not None else F.col(quoted(a.column))
        aggs.append(simple(op, c, a.quantile).alias(alias))
    late = df.withColumn(time, F.col(quoted(time)).cast("timestamp")).withWatermark(time, watermark)
    span = F.window(time, window, slide) if slide else F.window(time, window)
    return late.groupBy(span.alias("__w"), *map(quoted, keys)).agg(*aggs).select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *map(quoted, keys), *spec)
