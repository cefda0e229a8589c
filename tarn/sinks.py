"""Results as text streams, Arrow data and Parquet files with manifests."""

from __future__ import annotations

import datetime
import decimal
import json
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote, unquote_plus

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.errors import EngineError
from tarn.plans import tasks
from tarn.plans.compile import quoted


def json_safe(v):
    """A value as JSON can hold it: wide integers as text, bytes as hexadecimal, times as ISO text."""
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int):
        return v if abs(v) <= 2**53 - 1 else str(v)
    if isinstance(v, float):
        return v if math.isfinite(v) else str(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, datetime.datetime):
        return v.strftime("%Y-%m-%dT%H:%M:%S.") + f"{v.microsecond // 1000:03d}Z"
    if isinstance(v, datetime.date):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return {k: json_safe(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {str(k): json_safe(x) for k, x in v.items()}
    return [json_safe(x) for x in v]


def _texts(df: DataFrame) -> Iterator[str]:
    for row in df.toLocalIterator():
        yield json.dumps({k: json_safe(v) for k, v in row.asDict().items()}, ensure_ascii=False, separators=(",", ":"))


def ndjson(df: DataFrame) -> Iterator[str]:
    for text in _texts(df):
        yield text + "\n"


def json_array(df: DataFrame) -> Iterator[str]:
    first = True
    for text in _texts(df):
        yield ("[" if first else ",") + text
        first = False
    yield "[]" if first else "]"


def _cell(v) -> str:
    v = json_safe(v)
    text = "" if v is None else str(v).lower() if isinstance(v, bool) else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    return '"' + text.replace('"', '""') + '"' if re.search(r'[",\r\n]', text) else text


def csv(df: DataFrame, header: bool = True) -> Iterator[str]:
    if header:
        yield ",".join(map(_cell, df.columns)) + "\n"
    for row in df.toLocalIterator():
        yield ",".join(map(_cell, row)) + "\n"


def _flat(df: DataFrame) -> None:
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            raise EngineError("TYPE_ERROR", f"{f.name} cannot be sent as Arrow", column=f.name)


def arrow_batches(df: DataFrame, size: int = 4096) -> Iterator:
    """Record batches of at most size rows, fetched a partition at a time."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    _flat(df)
    schema, held = to_arrow_schema(df.schema), []
    zones = [f.dataType for f in df.schema.fields]

    def batch():
        columns = zip(*held, strict=True) if held else [[] for _ in schema]
        arrays = [pa.array([v.replace(tzinfo=datetime.timezone.utc) if isinstance(t, T.TimestampType) and v is not None and v.tzinfo is None else v for v in c], type=f.type) for c, f, t in zip(columns, schema, zones, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    sent = False
    for row in df.toLocalIterator():
        held.append(tuple(row))
        if len(held) == size:
            yield batch()
            held, sent = [], True
    if held or not sent:
        yield batch()


def arrow_stream(df: DataFrame, size: int = 4096) -> Iterator[bytes]:
    """An Arrow IPC stream in pieces, none of which holds the whole result."""
    import pyarrow as pa

    class Sink:
        def __init__(self):
            self.pieces, self.closed = [], False

        def write(self, data):
            self.pieces.append(bytes(data))
            return len(data)

        def flush(self):
            pass

        def close(self):
            self.closed = True

    sink, writer = Sink(), None
    for batch in arrow_batches(df, size):
        writer = writer or pa.ipc.new_stream(pa.PythonFile(sink, "w"), batch.schema)
        writer.write_batch(batch)
        yield b"".join(sink.pieces)
        sink.pieces.clear()
    writer.close()
    yield b"".join(sink.pieces)


def arrow_ipc(df: DataFrame, stream: bool = True) -> bytes:
    """The rows as one Arrow IPC stream or file. Nested and binary columns are refused."""
    import pyarrow as pa

    _flat(df)
    table, out = df.toArrow(), pa.BufferOutputStream()
    with (pa.ipc.new_stream if stream else pa.ipc.new_file)(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


@dataclass(frozen=True)
class Validation:
    """Conditions on rows to be written."""

    required: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    ranges: dict = field(default_factory=dict)
    enums: dict = field(default_factory=dict)

    def check(self, df: DataFrame) -> None:
        """One pass for all but uniqueness, an aggregation each for that."""
        bad = {f"{c} is null": F.col(quoted(c)).isNull() for c in self.required}
        for c, (low, high) in self.ranges.items():
            own = F.col(quoted(c))
            outside = (own < low if low is not None else F.lit(False)) | (own > high if high is not None else F.lit(False))
            bad[f"{c} is out of range"] = outside
        bad |= {f"{c} is none of its values": ~F.col(quoted(c)).isin(*v) for c, v in self.enums.items()}
        if bad:
            row = df.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(bad.values())]).first()
            for (name, _), n in zip(bad.items(), row, strict=True):
                if n:
                    raise EngineError("VALIDATION_ERROR", f"{name} in {n} rows", rows=n)
        for names in self.unique:
            if not df.groupBy(*map(quoted, names)).count().where("count > 1").isEmpty():
                raise EngineError("VALIDATION_ERROR", f"{', '.join(names)} repeat", columns=list(names))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """mode: overwrite, or create, which refuses an existing target."""
    if mode not in ("overwrite", "create"):
        raise EngineError("PARQUET_WRITE_ERROR", f"no mode {mode}")
    df.write.mode("overwrite" if mode == "overwrite" else "errorifexists").parquet(path)


def check_written(df: DataFrame) -> None:
    """Refuses what a written file could not hold plainly: no rows, columns without a value, non-finite numbers, nested values."""
    bad, kinds = [], []
    for f in df.schema.fields:
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType, T.NullType)):
            raise EngineError("VALIDATION_ERROR", f"{f.name} holds no scalars", column=f.name)
        kinds.append((f.name, "has no value"))
        bad.append(F.count(c) == 0)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            kinds.append((f.name, "holds a number that is not finite"))
            bad.append(F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))) > 0)
    n, *found = df.agg(F.count(F.lit(1)), *[c.alias(f"b{i}") for i, c in enumerate(bad)]).first()
    if not n:
        raise EngineError("VALIDATION_ERROR", "there are no rows to write")
    for (name, what), wrong in zip(kinds, found, strict=True):
        if wrong:
            raise EngineError("VALIDATION_ERROR", f"{name} {what}", column=name)


def _place(spark: SparkSession, path: str):
    """A Hadoop path and its file system, of whatever store Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(place), fs


def _plain(path: str) -> str:
    """Local files without their scheme."""
    return re.sub(r"^file:/+", "/", path)


def _hashed(spark: SparkSession, folder: str) -> dict[str, tuple[int, int, str]]:
    """(rows, bytes, sha256) of each Parquet file below folder, found out by the tasks that read them."""
    every = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    hashes = {r["path"]: (r["length"], r["hash"]) for r in every.select("path", "length", F.sha2("content", 256).alias("hash")).collect()}
    counted = spark.read.option("recursiveFileLookup", "true").parquet(folder).groupBy(F.col("_metadata.file_path").alias("path")).count().collect()
    rows = {_plain(unquote(r["path"])): r["count"] for r in counted}
    return {_plain(p): (rows.get(_plain(p), 0), size, f"sha256:{h}") for p, (size, h) in hashes.items()}


def write_partitioned(
    df: DataFrame,
    prefix: str,
    partition_by: list[str] | None = None,
    max_rows_per_file: int | None = None,
    max_bytes_per_file: int | None = None,
    job_id: str = "job",
    task_id: str | None = None,
    idempotency_key: str | None = None,
    validation: Validation | None = None,
) -> list[dict]:
    """Files with predictable names below prefix, and an entry (path, rows, bytes, sha256, partition) of each.

    Spark writes them in parallel to a folder beside the target, on the same store, and
    hashes and counts them in parallel; the driver renames each file, of which it needs
    the name alone. A partition value is dealt to as many tasks as its size asks for.
    """
    spark, keys = df.sparkSession, list(partition_by or [])
    if len(set(keys)) < len(keys):
        raise EngineError("VALIDATION_ERROR", "a partition column repeats")
    if missing := [k for k in keys if k not in df.columns]:
        raise EngineError("UNKNOWN_COLUMN", f"no column {missing[0]}", column=missing[0])
    if validation:
        validation.check(df)
    check_written(df)
    root, fs = _place(spark, prefix.rstrip("/"))
    rows = max_rows_per_file
    if max_bytes_per_file:
        width = max(1, sum(_width(f.dataType) for f in df.schema.fields))
        rows = min(rows or 1 << 31, max(1, max_bytes_per_file // width))
    staging = f"{root.getParent().toString().rstrip('/')}/_staging-{uuid.uuid4().hex}"
    # Partition directories take the encoded text of a column's value.
    folders = [f"__p{i}" for i in range(len(keys))]
    marked = df.withColumns({p: F.coalesce(F.url_encode(F.col(quoted(k)).cast("string")), F.lit("__null__")) for p, k in zip(folders, keys, strict=True)}).drop(*keys) if keys else df
    # Adaptive execution splits what it rebalances by size, a frequent value too.
    writer = (marked.hint("rebalance", *folders) if keys else marked).write
    writer = writer.option("maxRecordsPerFile", rows) if rows else writer
    out, counts = [], {}
    tag = "-".join(x for x in (job_id, task_id, idempotency_key) if x)
    try:
        (writer.partitionBy(*folders) if keys else writer).parquet(staging)
        for source, (n_rows, size, found_hash) in sorted(_hashed(spark, staging).items()):
            if not n_rows:
                continue
            below = source[len(_plain(staging)) :].strip("/").split("/")[:-1]
            decoded = [unquote_plus(unquote(x.partition("=")[2])) for x in below]
            place = "/".join(f"{k}={quote(v, safe='')}" for k, v in zip(keys, decoded, strict=True))
            n = counts[place] = counts.get(place, -1) + 1
            target = "/".join(x for x in (root.toString(), place, f"part-{tag}-{n:05d}.parquet") if x)
            old, new = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
            fs.mkdirs(new.getParent())
            if fs.exists(new):
                fs.delete(new, False)
            if not fs.rename(old, new):
                raise EngineError("PARQUET_WRITE_ERROR", f"{target} could not be put in place", path=target)
            out.append({"path": _plain(target), "rows": n_rows, "bytes": size, "sha256": found_hash, "partition": dict(zip(keys, decoded, strict=True))})
    finally:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(staging), True)
    return sorted(out, key=lambda e: e["path"])


def _width(t: T.DataType) -> int:
    return {T.BooleanType: 1, T.IntegerType: 4, T.FloatType: 4}.get(type(t), 24 if isinstance(t, (T.StringType, T.BinaryType)) else 8)


def write_task(store: tasks.CheckpointStore, df: DataFrame, prefix: str, task_id: str, key: str, **more) -> list[dict]:
    """A partitioned write that is done once: a repeated call returns what was recorded."""
    done = store.get(task_id)
    if done and done.idempotency_key == key and tasks.STATES.index(done.state) >= tasks.STATES.index("output-written"):
        return list(done.outputs)
    if done is None:
        store.advance(tasks.Checkpoint(task_id, "planned", key))
    store.advance(tasks.Checkpoint(task_id, "running", key))
    made = write_partitioned(df, prefix, task_id=task_id, idempotency_key=key, **more)
    for state in tasks.STATES[2:]:
        store.advance(tasks.Checkpoint(task_id, state, key, outputs=tuple(made)))
    return made


def create_table_as(df: DataFrame, prefix: str, job_id: str = "job", **more) -> dict:
    """Writes a query's rows and gives the files, their manifest and the number of rows."""
    files = write_partitioned(df, prefix, job_id=job_id, **more)
    return {"files": files, "manifest": tasks.output_manifest(job_id, files), "rows": sum(f["rows"] for f in files)}


def compact(spark, source: str, target: str, max_rows_per_file: int = 1_000_000) -> int:
    """Rewrites many small files as few, of about equally many rows; returns their number."""
    df = spark.read.parquet(source)
    files = max(1, -(-df.count() // max_rows_per_file))
    df.repartition(files).write.mode("overwrite").parquet(target)
    return files


def read_manifest(path: str) -> dict:
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_manifest(manifest: dict, path: str) -> None:
    """In one step, so that a reader sees the old manifest or the new one."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    place, fs = _place(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{place.getParent().toString().rstrip('/')}/_{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    if fs.exists(place):
        fs.delete(place, False)
    if not fs.rename(part, place):
        raise EngineError("PARQUET_WRITE_ERROR", f"{path} could not be put in place", path=path)
