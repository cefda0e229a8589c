"""An index beside the data: bounds of each file, to leave out files before they are read."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.expr import Expr
from tarn.plans.compile import quoted
from tarn.plans.explain import may_match


@dataclass
class Sidecar:
    """bounds: {path: {column: (least, greatest), "bbox:<column>": (…4), "cells:<column>": set}}."""

    columns: tuple[str, ...]
    bounds: dict[str, dict]

    def prune(self, paths: list[str], where: Expr | None) -> set[str]:
        """Paths that may hold matching rows; a path that the index does not know may."""
        if where is None:
            return set(paths)
        return {p for p in paths if p not in self.bounds or may_match(where, self.bounds[p])}


def build(spark: SparkSession, paths: list[str], columns: list[str], bbox: dict[str, tuple[str, str, str, str]] | None = None, cells: list[str] | None = None) -> Sidecar:
    """One aggregation by file. bbox: {geometry column: (minx, miny, maxx, maxy columns)}."""
    df: DataFrame = spark.read.parquet(*paths).withColumn("__f", F.col("_metadata.file_path"))
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.min(quoted(c)).alias(f"lo{i}"), F.max(quoted(c)).alias(f"hi{i}")]
    for i, (a, b, c, d) in enumerate((bbox or {}).values()):
        aggs += [F.min(a).alias(f"x{i}"), F.min(b).alias(f"y{i}"), F.max(c).alias(f"u{i}"), F.max(d).alias(f"v{i}")]
    for i, c in enumerate(cells or []):
        aggs.append(F.collect_set(quoted(c)).alias(f"c{i}"))
    out = {}
    for r in df.groupBy("__f").agg(*aggs).collect():  # a row for each file
        own = {c: (r[f"lo{i}"], r[f"hi{i}"]) for i, c in enumerate(columns) if r[f"lo{i}"] is not None}
        own |= {f"bbox:{g}": (r[f"x{i}"], r[f"y{i}"], r[f"u{i}"], r[f"v{i}"]) for i, g in enumerate(bbox or {})}
        own |= {f"cells:{c}": set(r[f"c{i}"]) for i, c in enumerate(cells or [])}
        out[re.sub(r"^file:/+", "/", r["__f"])] = own
    return Sidecar(tuple(columns), out)
