"""Paths, globs, Parquet files and Hive-partitioned directories.

Paths are listed by Hadoop's file systems, so any store that Spark reads works.
In a pattern, * crosses slashes and ? is one character; files come in path order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.errors import EngineError
from tarn.operators.aggregate import ORDINAL
from tarn.plans.compile import quoted


@dataclass(frozen=True)
class SourceFile:
    path: str
    size: int
    modified: int


def glob_regex(pattern: str) -> re.Pattern:
    return re.compile("".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern) + r"\Z", re.DOTALL)


def _local_form(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


def list_files(spark: SparkSession, pattern: str) -> list[SourceFile]:
    """The files that a path, directory or pattern names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    first = re.search(r"[*?]", pattern)
    root = pattern if not first else pattern[: first.start()].rpartition("/")[0] or "."
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        raise EngineError("OBJECT_NOT_FOUND", f"nothing at {pattern}", path=pattern)
    found = []
    walk = fs.listFiles(path, True)
    matches = None
    if first:
        full = pattern if "://" in pattern or pattern.startswith("/") else None
        matches = glob_regex(_local_form(full or pattern))
    while walk.hasNext():
        s = walk.next()
        name = _local_form(s.getPath().toString())
        below = name[len(_local_form(fs.makeQualified(path).toString())) :]
        if re.search(r"(^|/)[_.][^/=]*(/|$)", below):
            continue
        if matches is None or matches.match(name) or matches.match(name.removeprefix("/")):
            found.append(SourceFile(name, s.getLen(), s.getModificationTime()))
    if not found:
        raise EngineError("OBJECT_NOT_FOUND", f"nothing at {pattern}", path=pattern)
    return sorted(found, key=lambda f: f.path)


def check_schema(df: DataFrame, columns: set[str] | None = None) -> None:
    """Refuses struct columns and decimals of more than 15 digits among the columns used."""
    for f in df.schema.fields:
        if columns is not None and f.name not in columns:
            continue
        if isinstance(f.dataType, T.StructType):
            raise EngineError("UNSUPPORTED_PARQUET_FEATURE", f"{f.name} is a struct", column=f.name)
        if isinstance(f.dataType, T.DecimalType) and f.dataType.precision > 15:
            raise EngineError("UNSUPPORTED_PARQUET_FEATURE", f"{f.name} has {f.dataType.precision} digits", column=f.name)


def with_ordinal(df: DataFrame) -> DataFrame:
    """df with the place of each row: file, then row. Pruned away where nothing asks for it."""
    return df.withColumn(ORDINAL, F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row")))


def read_parquet(spark: SparkSession, files: list[SourceFile], ordinal: bool = True) -> DataFrame:
    df = spark.read.parquet(*[f.path for f in files])
    return with_ordinal(df) if ordinal else df


def partition_values(path: str) -> dict[str, str]:
    """key=value segments of a path, decoded; always strings."""
    pairs = (s.partition("=") for s in path.split("/")[:-1] if "=" in s)
    return {k: unquote(v) for k, _, v in pairs}


def read_hive(spark: SparkSession, files: list[SourceFile], ordinal: bool = True) -> DataFrame:
    """A partitioned directory tree. Partition values are strings; a file's own column of the name wins.

    Filters on partition columns prune directories.
    """
    key = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        keys = list(partition_values(files[0].path))
        root = files[0].path.split(f"/{keys[0]}=")[0] if keys else files[0].path.rpartition("/")[0]
        own = spark.read.parquet(files[0].path)
        df = spark.read.option("basePath", root).parquet(*[f.path for f in files])
        df = with_ordinal(df) if ordinal else df
        if clash := [k for k in keys if k in own.columns]:
            types = {k: own.schema[k].dataType for k in clash}
            raw = spark.read.parquet(*[f.path for f in files])
            df = with_ordinal(raw) if ordinal else raw
            place = F.col("_metadata.file_path")
            for k in keys:
                if k not in types:
                    df = df.withColumn(k, F.url_decode(F.regexp_extract(place, f"/{re.escape(k)}=([^/]*)/", 1)))
        return df
    finally:
        spark.conf.set(key, before)


def prune_hive(files: list[SourceFile], where) -> tuple[list[SourceFile], list[SourceFile]]:
    """(kept, skipped) files by the partition columns alone; what cannot be told is kept."""
    from tarn.plans.explain import may_match

    kept, skipped = [], []
    for f in files:
        values = partition_values(f.path)
        bounds = {k: (v, v) for k, v in values.items()}
        (kept if where is None or may_match(where, bounds) else skipped).append(f)
    return kept, skipped


def fields(df: DataFrame) -> list[str]:
    return [quoted(c) for c in df.columns if c != ORDINAL]
