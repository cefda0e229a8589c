"""Catalogue entries that write tables and read them back: formats, pruning, slices, Iceberg."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tarn import expr as x
from tarn import sinks
from tarn.catalogue import add, query, refused
from tarn.lake import Lake
from tarn.plans import resume, tasks
from tarn.scratch import scratch
from tarn.sources import files, iceberg, memory, sidecar, tables, text
from tarn.sql.run import spec_of


@query("hive_partition_pruning", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 50000")
def _(lake, p):
    root = scratch(lake.spark, "hive")
    lake.spark.read.parquet(p["orders"]).select("o_orderkey", "o_totalprice", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(root)
    found = lake.hive(f"{root}/*.parquet").where(x.and_(x.eq(x.col("o_orderstatus"), "P"), x.gt(x.col("o_totalprice"), 50000)))
    return found.select("o_orderkey", "o_orderstatus").frame()


@query("sidecar_pruning", "SELECT event_id FROM events WHERE event_id BETWEEN 100 AND 180")
def _(lake, p):
    root = scratch(lake.spark, "sidecar")
    lake.spark.read.parquet(p["events"]).select("event_id").repartitionByRange(6, "event_id").write.parquet(root)
    paths = [f.path for f in files.list_files(lake.spark, root)]
    lake.use_sidecar(root, sidecar.build(lake.spark, paths, ["event_id"]))
    return lake.path(root).where(x.between(x.col("event_id"), 100, 180)).frame()


@query("slice_resume", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 60 OFFSET 5")
def _(lake, p):
    found = lake.path(p["part"]).select("p_partkey", "p_size").order_by("-p_size", "p_partkey").offset(5).limit(60)
    rows = [r for part, _ in found.resumable_batches(25) for r in part]  # 60 rows
    return lake.spark.createDataFrame(rows, "p_partkey long, p_size int")


@query("csv_roundtrip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(lake, p):
    root = scratch(lake.spark, "csv")
    lake.spark.read.parquet(p["customer"]).select("c_custkey", "c_name", "c_acctbal").coalesce(1).write.option("header", True).csv(root)
    found = text.read_csv(lake.spark, root)
    return found.withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("ndjson_roundtrip", "SELECT n_nationkey, n_name FROM nation")
def _(lake, p):
    root = scratch(lake.spark, "json")
    lake.spark.read.parquet(p["nation"]).select("n_nationkey", "n_name").write.json(root)
    return text.read_json(lake.spark, root).select(F.col("n_nationkey").cast("int"), "n_name")


@query("partitioned_write_readback", "SELECT o_orderkey, o_orderpriority FROM orders")
def _(lake, p):
    root = scratch(lake.spark, "written")
    sinks.write_partitioned(lake.spark.read.parquet(p["orders"]).select("o_orderkey", "o_orderpriority"), root, ["o_orderpriority"], max_rows_per_file=2000, validation=sinks.Validation(required=("o_orderkey",), unique=(("o_orderkey",),)))
    return lake.hive(f"{root}/*.parquet").frame()


@query("ctas", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def _(lake, p):
    root = scratch(lake.spark, "ctas")
    made = sinks.create_table_as(lake.sql("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey", (), p), root)
    assert made["rows"] == made["manifest"]["rows"]
    return lake.path(f"{root}/*.parquet").frame()


def make_table(spark, source: str) -> str:
    """A table of two snapshots: nations of regions 0 and 1, then also of 2, with both kinds of deletes."""
    root = scratch(spark, "iceberg")
    location = "wh/nations"
    schema = {"schema-id": 0, "fields": [{"id": 1, "name": "n_nationkey", "type": "int", "required": True}, {"id": 2, "name": "n_name", "type": "string"}, {"id": 3, "name": "n_regionkey", "type": "int"}]}
    renamed = {"schema-id": 1, "fields": [schema["fields"][0], {"id": 4, "name": "title", "sourceId": 2, "type": "string"}, schema["fields"][2]]}
    entries = []
    for r in range(3):
        rows = spark.read.parquet(source).where(F.col("n_regionkey") == r).orderBy("n_nationkey").coalesce(1)
        made = sinks.write_partitioned(rows.withColumn("region", F.col("n_regionkey")), f"{root}/data", ["region"], job_id=f"r{r}")
        entries += [{"status": 1, "sequence_number": 1 + (r == 2), "data_file": {"content": 0, "file_path": location + f["path"].removeprefix(root), "partition": f["partition"], "record_count": f["rows"], "file_size_in_bytes": f["bytes"]}} for f in made]
    first = entries[0]["data_file"]
    keys = spark.read.parquet(root + first["file_path"].removeprefix(location)).select("n_nationkey", F.col("_metadata.row_index").alias("at"))
    second = keys.orderBy("n_nationkey").limit(2).collect()[1]["at"]
    spark.createDataFrame([(first["file_path"], second)], "file_path string, pos long").coalesce(1).write.parquet(f"{root}/deletes/pos")
    last = spark.read.parquet(source).where("n_regionkey = 2").agg(F.max("n_nationkey")).first()[0]
    spark.createDataFrame([(last,)], "n_nationkey int").coalesce(1).write.parquet(f"{root}/deletes/eq")
    name = lambda d: location + files.list_files(spark, f"{root}/deletes/{d}")[0].path.removeprefix(root)
    deletes = [
        {"status": 1, "sequence_number": 3, "data_file": {"content": 1, "file_path": name("pos"), "partition": first["partition"]}},
        {"status": 1, "sequence_number": 3, "data_file": {"content": 2, "file_path": name("eq"), "partition": entries[-1]["data_file"]["partition"], "equality_ids": [1]}},
    ]
    for n, part in (("one", entries[:-1]), ("two", entries[-1:]), ("deletes", deletes)):
        sinks.write_manifest({"entries": part}, f"{root}/metadata/{n}.json")
    ref = lambda *names: [{"path": f"{location}/metadata/{n}.json"} for n in names]
    meta = {
        "format-version": 2,
        "location": location,
        "current-snapshot-id": 2,
        "last-sequence-number": 3,
        "current-schema-id": 1,
        "schemas": [schema, renamed],
        "refs": {"old": {"type": "tag", "snapshot-id": 1}},
        "snapshots": [
            {"snapshot-id": 1, "timestamp-ms": 1000, "schema-id": 0, "manifests": ref("one")},
            {"snapshot-id": 2, "timestamp-ms": 2000, "schema-id": 1, "manifests": ref("one", "two", "deletes")},
        ],
    }
    sinks.write_manifest(meta, f"{root}/metadata/v1.metadata.json")
    return root


_SECOND = "(SELECT n_nationkey FROM nation WHERE n_regionkey = 0 ORDER BY n_nationkey LIMIT 1 OFFSET 1)"
_LAST = "(SELECT max(n_nationkey) FROM nation WHERE n_regionkey = 2)"


@query("iceberg_deletes", f"SELECT n_nationkey, n_name AS title, n_regionkey FROM nation WHERE n_regionkey < 3 AND n_nationkey <> {_SECOND} AND n_nationkey <> {_LAST}")
def _(lake, p):
    return iceberg.load_location(lake.spark, make_table(lake.spark, p["nation"])).read()


@query("iceberg_position_deletes", f"SELECT n_nationkey, n_name AS title FROM nation WHERE n_regionkey = 0 AND n_nationkey <> {_SECOND}")
def _(lake, p):
    table = iceberg.load_location(lake.spark, make_table(lake.spark, p["nation"]))
    return table.read(where=x.eq(x.col("n_regionkey"), 0), columns=["n_nationkey", "title"])


@query("iceberg_equality_deletes", f"SELECT n_nationkey FROM nation WHERE n_regionkey = 2 AND n_nationkey <> {_LAST}")
def _(lake, p):
    table = iceberg.load_location(lake.spark, make_table(lake.spark, p["nation"]))
    return table.read(where=x.eq(x.col("n_regionkey"), 2), columns=["n_nationkey"], respect_sequence_numbers=True)


@query("iceberg_time_travel", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey < 2")
def _(lake, p):
    table = iceberg.load_location(lake.spark, make_table(lake.spark, p["nation"]))
    assert table.snapshot(ref="old") == table.snapshot(as_of_ms=1500)
    return table.read(as_of_ms=1500)


@query("iceberg_append", "SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 1, 3)")
def _(lake, p):
    root = make_table(lake.spark, p["nation"])
    table = iceberg.load_location(lake.spark, root)
    rows = lake.spark.read.parquet(p["nation"]).where("n_regionkey = 3").withColumn("region", F.col("n_regionkey"))
    made = sinks.write_partitioned(rows, f"{root}/data", ["region"], job_id="more")
    table.metadata["current-snapshot-id"] = 1
    return table.append(made).read(columns=["n_nationkey"])


add(
    "stream_filter",
    lambda spark, sf: _stream(spark, sf),
    "SELECT event_id, value * 2 AS twice FROM events WHERE event_type <> 'view' AND value > 10",
)


def _stream(spark, sf):
    from tarn.plans.spec import QuerySpec
    from tarn.streaming import queries as stream

    root = scratch(spark, "stream")
    source = spark.read.parquet(f"{sf}/events.parquet")
    source.write.parquet(f"{root}/in")
    spec = QuerySpec("", project=(("event_id", x.col("event_id")), ("twice", x.mul(x.col("value"), 2))), where=x.and_(x.ne(x.col("event_type"), "view"), x.gt(x.col("value"), 10)))
    made = stream.apply(stream.read_stream(spark, f"{root}/in", source.schema), spec)
    made.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


# Rows and Arrow data of the caller, streams read back, files written in other ways.


@query("memory_rows", "SELECT * FROM (VALUES ('a', 2), ('b', 1)) AS v(k, n)")
def _(lake, p):
    rows = [{"k": "a", "v": 1.5}, {"k": "b", "v": None}, {"k": "a", "v": -2.0}]
    return memory.in_memory_lake(lake.spark, {"t": rows}).table("t").group_by("k").aggregate({"n": "count"})


@query("arrow_ingest", "SELECT * FROM (VALUES (1, 'x'), (3, 'z')) AS v(i, s)")
def _(lake, p):
    import pyarrow as pa

    table = pa.table({"i": pa.array([1, 2, 3], pa.int32()), "s": ["x", "y", "z"]})
    return Lake(lake.spark, tables={"t": memory.from_arrow(lake.spark, table)}).sql("SELECT i, s FROM t WHERE s <> 'y'")


def _nations(lake, p):
    return lake.path(p["nation"]).select("n_nationkey", "n_name")


_NATIONS, _NATION_ROW = "SELECT n_nationkey, n_name FROM nation", "n_nationkey int, n_name string"


@query("stream_ndjson", _NATIONS)
def _(lake, p):
    return lake.spark.createDataFrame([json.loads(line) for line in _nations(lake, p).stream_ndjson()], _NATION_ROW)


@query("stream_json_array", _NATIONS)
def _(lake, p):
    return lake.spark.createDataFrame(json.loads("".join(_nations(lake, p).stream_json())), _NATION_ROW)


@query("stream_csv", _NATIONS)
def _(lake, p):
    import csv

    rows = list(csv.reader("".join(_nations(lake, p).stream_csv()).splitlines()))
    return lake.spark.createDataFrame([(int(k), n) for k, n in rows[1:]], _NATION_ROW)


@query("stream_arrow", _NATIONS)
def _(lake, p):
    import pyarrow as pa

    data = b"".join(sinks.arrow_stream(_nations(lake, p).frame(), 10))
    return memory.from_arrow(lake.spark, pa.ipc.open_stream(data).read_all())


@query("arrow_file", _NATIONS)
def _(lake, p):
    import pyarrow as pa

    return memory.from_arrow(lake.spark, pa.ipc.open_file(sinks.arrow_ipc(_nations(lake, p).frame(), stream=False)).read_all())


@query("http_source", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def _(lake, p):
    """A file by HTTP, from a server on this machine."""
    import functools
    import http.server
    import threading

    root = scratch(lake.spark, "served")
    lake.spark.read.parquet(p["supplier"]).coalesce(1).write.parquet(root)
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=root)
    handler.log_message = handler.func.log_message = lambda *a: None
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        name = files.list_files(lake.spark, root)[0].path.rpartition("/")[2]
        out = lake.path(f"http://127.0.0.1:{server.server_port}/{name}").where(x.gt(x.col("s_acctbal"), 0)).select("s_suppkey", "s_name").frame()
        server.shutdown()
    return out


@query("first_and_count", "SELECT count(*) AS n, min(p_partkey) AS k FROM part WHERE p_size > 25")
def _(lake, p):
    found = lake.path(p["part"]).where(x.gt(x.col("p_size"), 25)).order_by("p_partkey")
    return lake.spark.createDataFrame([(found.count(), found.first()["p_partkey"])], "n long, k long")


@query("object_batches", "SELECT n_nationkey, n_name FROM nation")
def _(lake, p):
    batches = list(_nations(lake, p).batches(7))
    assert [len(b) for b in batches] == [7, 7, 7, 4]
    return lake.spark.createDataFrame([r for b in batches for r in b], _NATION_ROW)


@query("write_parquet", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(lake, p):
    root = scratch(lake.spark, "plain")
    sinks.write_parquet(lake.path(p["supplier"]).select("s_suppkey", "s_name", "s_acctbal").frame(), root)
    return lake.path(f"{root}/*.parquet").frame()


@query("write_task_once", "SELECT count(*) AS n, true AS same, true AS hashed FROM customer")
def _(lake, p):
    root, store = scratch(lake.spark, "task"), tasks.CheckpointStore()
    df = lake.path(p["customer"]).select("c_custkey", "c_mktsegment").frame()
    once = sinks.write_task(store, df, root, "t1", "k1", partition_by=["c_mktsegment"])
    again = sinks.write_task(store, df.limit(1), root, "t1", "k1", partition_by=["c_mktsegment"])
    made = tasks.manifest_from_checkpoints("job", store)
    sinks.write_manifest(made, f"{root}/manifest.json")
    kept = sinks.read_manifest(f"{root}/manifest.json")
    # The hashes are those of the files as they lie there.
    read = lake.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(root).select(F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("h"))
    hashed = {r["h"] for r in read.collect()} == {f["sha256"] for f in kept["files"]}
    return lake.spark.createDataFrame([(kept["rows"], once == again, hashed)], "n long, same boolean, hashed boolean")


@query("compacted_files", "SELECT event_id, event_type FROM events")
def _(lake, p):
    root, target = scratch(lake.spark, "many"), scratch(lake.spark, "few")
    lake.path(p["events"]).select("event_id", "event_type").frame().repartition(12).write.parquet(root)
    made = sinks.compact(lake.spark, root, target)
    assert len(files.list_files(lake.spark, target)) == made  # one for each million rows
    return lake.spark.read.parquet(target)


@query("command_line_write", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 1")
def _(lake, p):
    import io

    from tarn.cli import main

    root, out = scratch(lake.spark, "cli"), io.StringIO()
    assert main(["write", "SELECT r_regionkey, r_name FROM input WHERE r_regionkey > $1", "--table", p["region"], "--param", "1", "--output", root], lake.spark, out) == 0
    assert main(["query", "SELECT r_name FROM input ORDER BY r_name LIMIT 2", "--table", p["region"], "--format", "ndjson"], lake.spark, out) == 0
    return lake.path(f"{root}/*.parquet").frame()


@query("signed_pages", "SELECT p_partkey FROM part WHERE p_size < 20 ORDER BY p_retailprice DESC, p_partkey LIMIT 30")
def _(lake, p):
    found, secret, rows = lake.path(p["part"]).select("p_partkey").where(x.lt(x.col("p_size"), 20)).order_by("-p_retailprice", "p_partkey").limit(30), b"secret", []
    part, mark = found.run_slice(8)
    while True:
        rows += part
        if mark is None:
            return lake.spark.createDataFrame(rows, "p_partkey long")
        token = resume.sign(resume.Bookmark.from_json(mark), secret)
        mark = resume.verify(token, secret).to_json()
        part, mark = lake.resume(mark).run_slice(8, mark)


@query("table_facade", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 2 AND n_nationkey > 1")
def _(lake, p):
    """A Parquet table and an Iceberg one through one face; the second as of its first snapshot."""
    where = x.gt(x.col("n_nationkey"), 1)
    plain = tables.load_table(lake.spark, p["nation"]).plan(x.and_(where, x.lt(x.col("n_regionkey"), 2)))
    lake_table = tables.load_table(lake.spark, make_table(lake.spark, p["nation"]), "iceberg").plan(where, as_of_ms=1500)
    rows = sorted((r["n_nationkey"], r["n_name"]) for b in lake_table.batches(3) for r in b)
    assert rows == sorted((r["n_nationkey"], r["n_name"]) for r in plain.rows(["n_nationkey", "n_name"])) and len(lake_table.files) == 2
    return lake_table.frame(["n_nationkey", "n_name"])


@query("iceberg_by_metadata_path", "SELECT n_nationkey FROM nation WHERE n_regionkey < 3")
def _(lake, p):
    root = make_table(lake.spark, p["nation"])
    return iceberg.IcebergTable(lake.spark, f"{root}/metadata/v1.metadata.json").read(columns=["n_nationkey"], mode="ignore-deletes")


@query("iceberg_append_manifest", "SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 1, 4)")
def _(lake, p):
    root = make_table(lake.spark, p["nation"])
    table = iceberg.load_location(lake.spark, root)
    table.metadata["current-snapshot-id"] = 1
    rows = lake.spark.read.parquet(p["nation"]).where("n_regionkey = 4").withColumn("region", F.col("n_regionkey"))
    return table.append_manifest(sinks.create_table_as(rows, f"{root}/data", "more", partition_by=["region"])["manifest"]).read(columns=["n_nationkey"])


@query("h3_within", "SELECT event_id FROM events WHERE event_id % 2 = 0")
def _(lake, p):
    cell = x.case((x.eq(x.mod(x.col("event_id"), 2), 0), "8829a1d757fffff"), otherwise="8829a1d755fffff")
    return lake.path(p["events"]).select("event_id").where(x.h3_within(cell, "8829a1d757fffff", 0)).frame()


def _source_cases(spark, sf):
    def written(name: str, text: str) -> str:
        root = scratch(spark, name)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(root)
        return root

    nested = spark.range(2).select(F.struct("id").alias("s"), F.col("id").cast("decimal(20,2)").alias("d"), "id")
    root = scratch(spark, "nested")
    nested.write.parquet(root)
    lake, number = Lake(spark), spark.range(3).select("id", F.lit(None).cast("string").alias("none"), (F.col("id") / 0.5).alias("x"))
    target = lambda: scratch(spark, "refused")
    iceberg_root = make_table(spark, f"{sf}/nation.parquet")
    table = iceberg.load_location(spark, iceberg_root)

    def changed(**more):
        other = iceberg.load_location(spark, iceberg_root)
        other.metadata = other.metadata | {k.replace("_", "-"): v for k, v in more.items()}
        return other.validate()

    return {
        "csv ragged row": lambda: text.read_csv(spark, written("csv", "a,b\n1,2\n3")),
        "csv repeated header": lambda: text.read_csv(spark, written("csv", "a,a\n1,2"), header=True),
        "csv empty header": lambda: text.read_csv(spark, written("csv", "a,\n1,2"), header=True),
        "csv bytes": lambda: text.read_csv(spark, written("csv", "a,b\n1,2"), max_bytes=3),
        "csv rows": lambda: text.read_csv(spark, written("csv", "a,b\n1,2\n3,4"), max_rows=1),
        "json no object": lambda: text.read_json(spark, written("json", '{"a":1}\n5')),
        "json invalid line": lambda: text.read_json(spark, written("json", '{"a":1}\nnope')),
        "parquet struct": lambda: lake.path(root).select("s").frame(),
        "parquet wide decimal": lambda: lake.path(root).select("d").frame(),
        "parquet wide decimal, sql": lambda: lake.sql("SELECT d FROM t", (), {"t": root}),
        "parquet wide decimal, groups": lambda: lake.path(root).group_by("d").aggregate({"n": "count"}),
        "parquet wide decimal unused": lambda: lake.path(root).select("id").frame(),
        "write no rows": lambda: sinks.write_partitioned(number.limit(0), target()),
        "write no value": lambda: sinks.write_partitioned(number, target()),
        "write infinite": lambda: sinks.write_partitioned(number.select("id", (F.col("x") + float("inf")).alias("y")), target()),
        "write nested": lambda: sinks.write_partitioned(nested.select("s"), target()),
        "write repeated partition": lambda: sinks.write_partitioned(number.select("id", "x"), target(), ["x", "x"]),
        "write unknown partition": lambda: sinks.write_partitioned(number.select("id"), target(), ["z"]),
        "write not in range": lambda: sinks.write_partitioned(number.select("id"), target(), validation=sinks.Validation(ranges={"id": (1, None)})),
        "write none of its values": lambda: sinks.write_partitioned(number.select("id"), target(), validation=sinks.Validation(enums={"id": [0, 1]})),
        "nothing there": lambda: lake.path(f"{root}/no/*.parquet").frame(),
        "iceberg version": lambda: changed(format_version=3),
        "iceberg sort order": lambda: changed(sort_orders=[{"fields": [1]}]),
        "iceberg transform": lambda: changed(partition_specs=[{"fields": [{"transform": "bucket[4]"}]}]),
        "iceberg snapshot": lambda: table.snapshot(77),
        "iceberg path": lambda: table.resolve("wh/nations/../x"),
        "catalog service": lambda: iceberg.load_catalog("glue"),
        "h3 disk": lambda: lake.path(f"{sf}/events.parquet").select("event_id").where(x.h3_within("8829a1d757fffff", "8829a1d757fffff", 1)).frame(),
        "state without an order": lambda: lake.path(f"{sf}/orders.parquet").limit(3).top_k_with_state(),
        "state without a limit": lambda: lake.path(f"{sf}/orders.parquet").order_by("o_orderkey").top_k_with_state(),
        "state of distinct rows": lambda: lake.path(f"{sf}/orders.parquet").distinct().order_by("o_orderkey").sort_with_state(),
        "state of another query": lambda: lake.path(f"{sf}/region.parquet").order_by("r_name").sort_with_state({"version": 1, "kind": "sort", "of": "x", "units": 1, "tables": []}),
        "bookmark of another query": lambda: lake.path(f"{sf}/region.parquet").run_slice(1, lake.path(f"{sf}/nation.parquet").bookmark()),
        "token of another secret": lambda: resume.verify(resume.sign(lake.path(f"{sf}/region.parquet").bookmark(), b"a"), b"b"),
        "explain of an aggregate": lambda: spec_of("SELECT count(*) AS n FROM region"),
        "JSON of another version": lambda: lake.query({"version": 2, "from": "t"}),
    }


_V, _C, _I = "VALIDATION_ERROR", "CATALOG_ERROR", "UNSUPPORTED_ICEBERG_FEATURE"
refused(
    "source_and_sink_refusals",
    _source_cases,
    {
        **dict.fromkeys(("csv ragged row", "csv repeated header", "csv empty header", "json no object"), _V), **dict.fromkeys(("csv bytes", "csv rows"), "BUDGET_EXCEEDED"), "json invalid line": "PARSE_ERROR",
        **dict.fromkeys(("parquet struct", "parquet wide decimal", "parquet wide decimal, sql", "parquet wide decimal, groups"), "UNSUPPORTED_PARQUET_FEATURE"), "parquet wide decimal unused": None,
        **dict.fromkeys(("write no rows", "write no value", "write infinite", "write nested", "write repeated partition", "write not in range", "write none of its values"), _V), "write unknown partition": "UNKNOWN_COLUMN", "nothing there": "OBJECT_NOT_FOUND",
        **dict.fromkeys(("iceberg version", "iceberg sort order", "iceberg transform"), _I), **dict.fromkeys(("iceberg snapshot", "iceberg path", "catalog service"), _C), "h3 disk": "GEO_BACKEND_MISSING",
        **dict.fromkeys(("state without an order", "state without a limit", "state of distinct rows"), "TYPE_ERROR"), **dict.fromkeys(("state of another query", "bookmark of another query", "token of another secret"), "BOOKMARK_INVALID"),
        "explain of an aggregate": "SQL_UNSUPPORTED", "JSON of another version": "PARSE_ERROR",
    },
)
