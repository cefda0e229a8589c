"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.scratch import shared

#: White space that parts words, as byte values: space and \x09 to \x0D.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, on the file system that Spark finds it on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared(spark))
    # A path without a scheme is on Spark's default file system, which need not be the local one.
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


class Workspace:
    """A folder of its own below the shared one, for tables that cut lineage.

    Tables stay readable after an executor is lost. The folder may be deleted
    once the results that read it have been written.
    """

    def __init__(self, spark: SparkSession, label: str, path: str | None = None):
        """path: a folder that is there already, to go on with."""
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/tarn-{label}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and read it back."""
        where = f"{self.path}/{name}"
        df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, name: str = "") -> None:
        """Delete a table that nothing reads any more, or the whole folder."""
        path, fs = self._fs(name)
        fs.delete(path, True)


    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, prefix: str) -> list[str]:
        """Names in the folder that begin so, in order."""
        path, fs = self._fs("")
        found = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in found if n.startswith(prefix))

    def keep_text(self, name: str, text: str) -> None:
        """Writes a small file, whole or not at all."""
        path, fs = self._fs(name)
        part, _ = self._fs(f"_{name}.{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(part, path):
            raise OSError(f"{path} exists")

    def text(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings are these inside the block, and what they were behind it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """All columns of df but some as one, row, whose names cannot clash with an operator's own."""
    names = [c for c in df.columns if c not in without]
    return F.struct(*[F.col(f"`{c}`") for c in names], *([] if names else [F.lit(None).cast("string").alias("_none")])).alias("row")


def unpacked(df: DataFrame, outputs: dict[str, Column]) -> DataFrame:
    """The columns that row holds, then the outputs; of equal names, in whatever case, the output stays."""
    taken = {c.lower() for c in outputs} | {"_none"}
    own = [c for c in df.schema["row"].dataType.names if c.lower() not in taken]
    return df.select(*[F.col("row").getField(c).alias(c) for c in own], *[v.alias(c) for c, v in outputs.items()])


def map_texts(df: DataFrame, make, fields: dict[str, str], text: str = "text") -> DataFrame:
    """df without `text` but with the columns of `fields`, made from each whole text in Arrow batches.

    make() runs once for each task and gives a function from a list of texts
    (None for null) to {name: list}. Input columns named like a field, in whatever case, are dropped.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(1000, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))))
    taken = {c.lower() for c in (text, *fields)}
    keep = [c for c in df.columns if c.lower() not in taken]
    df = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([*df.schema.fields[:-1], *[T.StructField(n, T._parse_datatype_string(t)) for n, t in fields.items()]])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        of, target = make(), to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):  # bounds the texts held as Python strings
                part = batch.slice(at, 250)
                made = of(part.column(part.num_columns - 1).to_pylist())
                arrays = [part.column(i).cast(target.field(i).type) for i in range(len(keep))]
                arrays += [pa.array(made[n], type=target.field(n).type) for n in fields]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)
