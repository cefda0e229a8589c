"""One face for Parquet and Iceberg tables: plan the files, then scan batches or rows of the plan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tarn.errors import EngineError
from tarn.expr import Expr
from tarn.operators.aggregate import ORDINAL
from tarn.plans.compile import Compiler, quoted
from tarn.sources import files, iceberg


@dataclass(frozen=True)
class FilePlan:
    """files: path, bytes and, of Iceberg tables, partition and rows; skipped: how many the filter left out."""

    table: Table
    files: list[dict]
    skipped: int
    where: Expr | None = None
    which: dict = field(default_factory=dict)

    def frame(self, columns: list[str] | None = None) -> DataFrame:
        """The plan's rows as one DataFrame."""
        return self.table.frame(self, columns)

    def batches(self, size: int = 4096, columns: list[str] | None = None) -> Iterator[list[dict]]:
        """Rows in lists of at most size, fetched a partition at a time."""
        held: list[dict] = []
        for row in self.frame(columns).toLocalIterator():
            held.append(row.asDict())
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held

    def rows(self, columns: list[str] | None = None) -> Iterator[dict]:
        for batch in self.batches(columns=columns):
            yield from batch


@dataclass(frozen=True)
class Table:
    spark: SparkSession
    format: str
    path: str
    iceberg: object = None

    def plan(self, where: Expr | None = None, **which) -> FilePlan:
        """which, of Iceberg tables: mode, snapshot_id, ref or as_of_ms."""
        if self.format == "parquet":
            found = files.list_files(self.spark, self.path)
            return FilePlan(self, [{"path": f.path, "bytes": f.size} for f in found], 0, where)
        made = self.iceberg.plan(where, **which)
        listed = [{"path": f.path, "bytes": f.size, "partition": f.partition, "rows": f.rows} for f in made.files]
        return FilePlan(self, listed, made.skipped, where, which)

    def frame(self, plan: FilePlan, columns: list[str] | None) -> DataFrame:
        if self.format == "iceberg":
            return self.iceberg.read(where=plan.where, columns=columns, **plan.which)
        df = self.spark.read.parquet(*[f["path"] for f in plan.files])
        df = df if plan.where is None else df.where(Compiler(df.schema).boolean(plan.where))
        return df.select(*[quoted(c) for c in columns or df.columns if c != ORDINAL])


def load_table(spark: SparkSession, path: str, format: str = "parquet") -> Table:
    """A table by its path, of Iceberg tables that of the table or of a metadata file."""
    if format == "parquet":
        return Table(spark, format, path)
    if format == "iceberg":
        return Table(spark, format, path, iceberg.IcebergTable(spark, path) if path.endswith(".json") else iceberg.load_location(spark, path))
    raise EngineError("CATALOG_ERROR", f"no table format {format}")
