"""Rows and Arrow tables held by the caller."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tarn.errors import EngineError


def from_rows(spark: SparkSession, rows: list[dict], schema=None, max_rows: int | None = None, max_bytes: int | None = None) -> DataFrame:
    if max_rows is not None and len(rows) > max_rows:
        raise EngineError("BUDGET_EXCEEDED", f"more than {max_rows} rows", limit=max_rows)
    if max_bytes is not None and sum(len(json.dumps(r, default=str)) for r in rows) > max_bytes:
        raise EngineError("BUDGET_EXCEEDED", f"more than {max_bytes} bytes", limit=max_bytes)
    if schema is None:
        import pyarrow as pa

        names = list(dict.fromkeys(k for r in rows for k in r))
        try:
            return spark.createDataFrame(pa.table({n: [r.get(n) for r in rows] for n in names}))
        except pa.ArrowInvalid as e:
            raise EngineError("VALIDATION_ERROR", f"a column mixes types: {e}") from None
    return spark.createDataFrame(rows, schema)


def from_arrow(spark: SparkSession, table) -> DataFrame:
    return spark.createDataFrame(table)


def in_memory_lake(spark: SparkSession, tables: dict[str, list[dict]], max_rows: int | None = None, max_bytes: int | None = None):
    """A lake whose tables are lists of rows."""
    from tarn.lake import Lake

    return Lake(spark, tables={n: from_rows(spark, rows, None, max_rows, max_bytes) for n, rows in tables.items()})
