"""Iceberg tables of versions 1 and 2: planned on the driver, read by one Spark plan.

Data files are read together; row-level deletes are anti joins on file and place
or on column values. A delete applies to the data files whose partition equals
its own; with respect_sequence_numbers, only to older ones, as the format says.
"""

from __future__ import annotations

import functools
import json
import posixpath
import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.errors import EngineError
from tarn.expr import Expr
from tarn.plans.compile import quoted
from tarn.plans.explain import may_match
from tarn.plans.spec import fingerprint
from tarn.sources import avro

CONTENT = {0: "data", 1: "position-deletes", 2: "equality-deletes"}
MODES = ("strict", "ignore-deletes", "ignore-unsupported-deletes")
TYPES = {"boolean": "boolean", "int": "int", "long": "bigint", "float": "float", "double": "double", "string": "string", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "binary": "binary"}


class Store:
    """Small files by Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        if not fs.exists(p):
            raise EngineError("OBJECT_NOT_FOUND", f"nothing at {path}", path=path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def write(self, path: str, data: bytes, replace: bool = True) -> bool:
        """False if the file exists and must not be replaced."""
        fs, p = self._at(path)
        try:
            stream = fs.create(p, replace)
        except Exception:
            if not replace and fs.exists(p):
                return False
            raise
        stream.write(bytearray(data))
        stream.close()
        return True


@dataclass(frozen=True)
class DataFile:
    path: str
    content: str
    partition: dict = field(default_factory=dict, hash=False)
    rows: int = 0
    size: int = 0
    sequence: int = 0
    equality_ids: tuple[int, ...] = ()


@dataclass
class Plan:
    files: list[DataFile]
    deletes: list[DataFile]
    snapshot: dict
    skipped: int


def plain(v) -> str | None:
    return None if v is None else str(v)


class IcebergTable:
    def __init__(self, spark: SparkSession, metadata_path: str, metadata: dict | None = None):
        """metadata: what a catalog says the file holds; the table then lies where it says."""
        self.spark, self.store, self.metadata_path = spark, Store(spark), metadata_path
        try:
            self.metadata = json.loads(self.store.read(metadata_path)) if metadata is None else metadata
        except ValueError:
            raise EngineError("CATALOG_ERROR", "the metadata is no JSON") from None
        self.validate()
        self.root = posixpath.dirname(posixpath.dirname(metadata_path)) if metadata is None else self.local(self.metadata["location"].rstrip("/"))
        self._manifests: dict[str, list[DataFile]] = {}

    def validate(self) -> None:
        m = self.metadata
        if m.get("format-version") not in (1, 2):
            raise EngineError("UNSUPPORTED_ICEBERG_FEATURE", f"format version {m.get('format-version')}")
        if not isinstance(m.get("location"), str):
            raise EngineError("CATALOG_ERROR", "the metadata names no location")
        if m.get("features") or m.get("feature-flags"):
            raise EngineError("UNSUPPORTED_ICEBERG_FEATURE", "feature flags")
        specs = m.get("partition-specs") or [{"fields": m.get("partition-spec") or []}]
        for f in (f for s in specs for f in s.get("fields", [])):
            if f.get("transform", "identity") not in ("identity", "void"):
                raise EngineError("UNSUPPORTED_ICEBERG_FEATURE", f"partition transform {f['transform']}")
        if any(o.get("fields") for o in m.get("sort-orders") or []):
            raise EngineError("UNSUPPORTED_ICEBERG_FEATURE", "sort orders")

    def resolve(self, path: str) -> str:
        """A path of the metadata as one below the table's folder."""
        location = self.metadata["location"].rstrip("/")
        if path.startswith(location + "/"):
            below = path[len(location) + 1 :]
        elif path.startswith(self.root.rstrip("/") + "/"):
            below = path[len(self.root.rstrip("/")) + 1 :]
        elif "://" in path or path.startswith("/"):
            raise EngineError("CATALOG_ERROR", f"{path} is outside the table", path=path)
        else:
            below = path
        if any(p in ("..", ".", "") for p in below.split("/")):
            raise EngineError("CATALOG_ERROR", f"{path} is no safe path", path=path)
        return f"{self.root}/{below}"

    # Snapshots and schemas.

    def snapshot(self, snapshot_id: int | None = None, ref: str | None = None, as_of_ms: int | None = None) -> dict | None:
        """An id goes before a ref, a ref before a time, a time before the current snapshot."""
        known = {s["snapshot-id"]: s for s in self.metadata.get("snapshots") or []}
        if snapshot_id is None and ref is not None:
            found = (self.metadata.get("refs") or {}).get(ref)
            if not found:
                raise EngineError("CATALOG_ERROR", f"no ref {ref}", ref=ref)
            snapshot_id = found["snapshot-id"]
        if snapshot_id is None and as_of_ms is not None:
            past = [s for s in known.values() if s["timestamp-ms"] <= as_of_ms]
            if not past:
                raise EngineError("CATALOG_ERROR", "no snapshot is that old")
            return max(past, key=lambda s: s["timestamp-ms"])
        if snapshot_id is None:
            snapshot_id = self.metadata.get("current-snapshot-id")
            if snapshot_id in (None, -1):
                return None
        if snapshot_id not in known:
            raise EngineError("CATALOG_ERROR", f"no snapshot {snapshot_id}", snapshot=snapshot_id)
        return known[snapshot_id]

    def schema(self, schema_id: int | None = None) -> list[dict]:
        schemas = {s.get("schema-id", 0): s["fields"] for s in self.metadata.get("schemas") or [self.metadata.get("schema") or {"fields": []}]}
        wanted = schema_id if schema_id is not None else self.metadata.get("current-schema-id", max(schemas))
        if wanted not in schemas:
            raise EngineError("CATALOG_ERROR", f"no schema {wanted}")
        return schemas[wanted]

    def names_of(self, f: dict) -> list[str]:
        """The names that a field has or had, the present one first."""
        ids = {f["id"], f.get("sourceId", f["id"])}
        every = [g["name"] for s in self.metadata.get("schemas") or [] for g in s["fields"] if g["id"] in ids]
        return list(dict.fromkeys([f["name"], *every]))

    # Manifests.

    def entries(self, snapshot: dict) -> list[DataFile]:
        found: list[DataFile] = []
        if snapshot.get("manifest-list"):
            for m in self.load(snapshot["manifest-list"], "manifests"):
                found += self.manifest(m.get("manifest_path") or m.get("path") or m["manifest-path"], m.get("sequence_number", m.get("sequence-number")))
            return found
        for m in snapshot.get("manifests") or []:
            if isinstance(m, str):
                m = {"path": m}
            if "entries" in m or "files" in m:
                found += [self.data_file(e, None) for e in m.get("entries") or m["files"] if e.get("status") != 2]
            else:
                found += self.manifest(m["path"], m.get("sequence-number"))
        return found

    def load(self, path: str, key: str) -> list[dict]:
        data = self.store.read(self.resolve(path))
        if data[:4] == b"Obj\x01":
            return avro.records(data)
        try:
            found = json.loads(data)
        except ValueError:
            raise EngineError("CATALOG_ERROR", f"{path} is neither Avro nor JSON") from None
        return found if isinstance(found, list) else found.get(key) or found.get("entries") or found.get("files") or []

    def manifest(self, path: str, sequence: int | None) -> list[DataFile]:
        if path not in self._manifests:
            self._manifests[path] = [self.data_file(e, sequence) for e in self.load(path, "entries") if e.get("status") != 2]
        return self._manifests[path]

    def data_file(self, e: dict, sequence: int | None) -> DataFile:
        f = e.get("data_file") or e.get("data-file") or e
        get = lambda *names: next((f[n] for n in names if f.get(n) is not None), None)
        content = get("content") or 0
        path = get("file_path", "file-path", "path")
        kind = CONTENT.get(content, content) if isinstance(content, int) else content
        if str(get("file_format", "file-format", "format") or "").lower() == "puffin":
            kind = "deletion-vector"
        number = next((x for x in (e.get("sequence_number"), e.get("sequence-number"), get("sequence_number", "sequence-number"), sequence) if x is not None), 0)
        ids = get("equality_ids", "equality-ids") or ()
        return DataFile(self.resolve(path), kind, {k: plain(v) for k, v in (get("partition") or {}).items()}, get("record_count", "record-count") or 0, get("file_size_in_bytes", "file-size-in-bytes") or 0, number, tuple(ids))

    # Planning and reading.

    def plan(self, where: Expr | None = None, mode: str = "strict", **which) -> Plan:
        """Files of a snapshot that a filter's partition values leave, and their deletes."""
        if mode not in MODES:
            raise EngineError("VALIDATION_ERROR", f"no mode {mode}")
        snapshot = self.snapshot(**which)
        if snapshot is None:
            return Plan([], [], {}, 0)
        files, deletes, skipped = [], [], 0
        for f in self.entries(snapshot):
            bounds = {k: (v, v) for k, v in f.partition.items() if v is not None}
            if f.content == "data":
                if where is None or may_match(where, bounds):
                    files.append(f)
                else:
                    skipped += 1
            elif f.content in ("position-deletes", "equality-deletes"):
                deletes.append(f)
            elif mode == "strict":
                raise EngineError("UNSUPPORTED_DELETE_FILES", f"{f.content} files", path=f.path)
        if mode == "ignore-deletes":
            deletes = []
        return Plan(sorted(files, key=lambda f: (f.sequence, f.path)), deletes, snapshot, skipped)

    def read(self, where: Expr | None = None, columns: list[str] | None = None, mode: str = "strict", respect_sequence_numbers: bool = False, apply_where: bool = True, **which) -> DataFrame:
        """The rows of a snapshot under its schema; which: snapshot_id, ref or as_of_ms."""
        found = self.plan(where, mode, **which)
        fields = self.schema(found.snapshot.get("schema-id"))
        if not found.files:
            empty = ", ".join(f"{quoted(f['name'])} {TYPES.get(f['type'], 'string')}" for f in fields)
            return self.spark.createDataFrame([], empty).select(*[quoted(c) for c in columns or [f["name"] for f in fields]])
        df = self.spark.read.option("mergeSchema", "true").parquet(*[f.path for f in found.files])
        df = df.withColumns({"__path": F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/"), "__row": F.col("_metadata.row_index")})
        own, held = set(df.columns), {n for g in found.files for n in g.partition}
        lone = [f for f in fields if not own.intersection(self.names_of(f)) and held.intersection(self.names_of(f))]
        if lone or found.deletes:  # a row for each file: its partition and its place in the order of changes
            values = lambda g: {k: None if v is None else str(v) for k, v in g.partition.items()}
            listed = [(self.local(g.path), fingerprint(g.partition), g.sequence, values(g)) for g in found.files]
            table = self.spark.createDataFrame(listed, "__path string, __part string, __seq long, __values map<string,string>")
            df = df.join(table, "__path")
        df = self.without_deleted(df, found, respect_sequence_numbers)
        out = []
        for f in fields:
            there = [F.col(quoted(n)) for n in self.names_of(f) if n in own]
            kind = TYPES.get(f["type"])
            if f in lone:
                there = [F.col("__values")[n] for n in self.names_of(f) if n in held]
            c = F.coalesce(*there) if there else F.lit(None)
            out.append((c.cast(kind) if kind else c).alias(f["name"]))
        df = df.select(*out)
        if where is not None and apply_where:
            from tarn.plans.compile import Compiler

            df = df.where(Compiler(df.schema).boolean(where))
        return df if columns is None else df.select(*[quoted(c) for c in columns])

    @staticmethod
    def local(path: str) -> str:
        return re.sub(r"^file:/+", "/", path)

    def without_deleted(self, df: DataFrame, found: Plan, by_sequence: bool) -> DataFrame:
        """One anti join for position deletes and one for each set of columns that is deleted by, however many files there are."""
        by_id = {f["id"]: f for s in self.metadata.get("schemas") or [] for f in s["fields"]}
        groups: dict[tuple, list[DataFile]] = {}
        for d in found.deletes:
            groups.setdefault((d.content, d.equality_ids), []).append(d)
        for (content, ids), files in groups.items():
            listed = self.spark.createDataFrame([(self.local(d.path), fingerprint(d.partition), d.sequence) for d in files], "__from string, __dpart string, __dseq long")
            gone = self.spark.read.parquet(*[d.path for d in files])
            names = [by_id[i]["name"] for i in ids if i in by_id] or [c for c in gone.columns if not c.startswith("_")]
            gone = gone.withColumn("__from", F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")).join(listed, "__from")
            limits = [F.col("__part") == F.col("__dpart")]
            if content == "position-deletes":
                gone = gone.select(self.resolved(F.col("file_path")).alias("__dpath"), F.col("pos").alias("__dpos"), "__dpart", "__dseq")
                limits += [F.col("__path") == F.col("__dpath"), F.col("__row") == F.col("__dpos")]
            else:
                gone = gone.select(*[F.col(quoted(n)).alias(f"__d{i}") for i, n in enumerate(names)], "__dpart", "__dseq")
                for i, n in enumerate(names):
                    own = next((c for g in by_id.values() if g["name"] == n for c in self.names_of(g) if c in df.columns), n)
                    if own not in df.columns:
                        raise EngineError("UNKNOWN_COLUMN", f"no column {n} to delete by", column=n)
                    limits.append(F.col(quoted(own)).eqNullSafe(F.col(f"__d{i}")))
            if by_sequence:
                limits.append(F.col("__seq") < F.col("__dseq") if content == "equality-deletes" else F.col("__seq") <= F.col("__dseq"))
            df = df.join(gone, functools.reduce(lambda p, q: p & q, limits), "left_anti")
        return df

    def resolved(self, path):
        """A delete file's path column in the form of __path."""
        location, root = self.metadata["location"].rstrip("/"), self.local(self.root)
        inside = F.concat(F.lit(root), F.substring(path, len(location) + 1, 1 << 30))
        return F.when(path.startswith(location + "/"), inside).otherwise(F.regexp_replace(path, "^file:/+", "/"))

    # Appending.

    def next_snapshot(self, files: list[dict], now_ms: int | None = None) -> dict:
        """The snapshot that has these data files too (entries of path, rows, bytes and partition); its manifest is written."""
        for f in files:
            if not {"path", "rows", "bytes"} <= set(f):
                raise EngineError("VALIDATION_ERROR", "an entry needs path, rows and bytes")
        m, old = self.metadata, self.snapshot()
        number = m.get("last-sequence-number", 0) + 1
        ident = uuid.uuid4().int >> 65
        now = int(time.time() * 1000) if now_ms is None else now_ms
        location, root = m["location"].rstrip("/"), self.local(self.root)
        name = lambda p: location + self.local(p).removeprefix(root) if self.local(p).startswith(root + "/") else p
        manifest = {"entries": [{"status": 1, "sequence_number": number, "data_file": {"content": 0, "file_path": name(f["path"]), "file_format": "parquet", "partition": f.get("partition") or {}, "record_count": f["rows"], "file_size_in_bytes": f["bytes"]}} for f in files]}
        for e in manifest["entries"]:
            self.resolve(e["data_file"]["file_path"])
        path = f"metadata/manifest-{ident}.json"
        self.store.write(f"{self.root}/{path}", json.dumps(manifest).encode())
        before: list = []
        if old is not None:
            if old.get("manifest-list"):
                before = [{"path": x.get("manifest_path") or x["path"], "sequence-number": x.get("sequence_number", x.get("sequence-number", 0))} for x in self.load(old["manifest-list"], "manifests")]
            else:
                before = list(old.get("manifests") or [])
        summary = {"operation": "append", "added-data-files": str(len(files)), "added-records": str(sum(f["rows"] for f in files))}
        schema_id = old["schema-id"] if old and "schema-id" in old else m.get("current-schema-id", 0)
        snapshot = {"snapshot-id": ident, "timestamp-ms": now, "sequence-number": number, "schema-id": schema_id, "summary": summary, "manifests": [*before, {"path": f"{location}/{path}", "sequence-number": number}]}
        if old is not None:
            snapshot["parent-snapshot-id"] = old["snapshot-id"]
        return snapshot

    def append(self, files: list[dict], now_ms: int | None = None) -> IcebergTable:
        """The table with one more snapshot, committed by a metadata file that only one writer can create."""
        snapshot = self.next_snapshot(files, now_ms)
        ident, m = snapshot["snapshot-id"], json.loads(json.dumps(self.metadata))
        m["snapshots"] = [*(m.get("snapshots") or []), snapshot]
        m |= {"current-snapshot-id": ident, "last-sequence-number": snapshot["sequence-number"], "last-updated-ms": snapshot["timestamp-ms"]}
        m.setdefault("refs", {})["main"] = {"type": "branch", "snapshot-id": ident}
        found = re.search(r"v(\d+)", posixpath.basename(self.metadata_path))
        version = int(found[1]) + 1 if found else 1
        target = f"{self.root}/metadata/v{version}.metadata.json"
        if not self.store.write(target, json.dumps(m).encode(), replace=False):
            raise EngineError("ICEBERG_COMMIT_CONFLICT", f"version {version} was committed by another", version=version)
        self.store.write(f"{self.root}/metadata/version-hint.text", str(version).encode())
        return IcebergTable(self.spark, target)

    def append_manifest(self, output: dict) -> IcebergTable:
        """Appends the files of an output manifest."""
        return self.append(output["files"])


def load_location(spark: SparkSession, location: str) -> IcebergTable:
    """By the version hint, else the highest version's metadata."""
    store, root = Store(spark), location.rstrip("/")
    hint = f"{root}/metadata/version-hint.text"
    if store.exists(hint):
        text = store.read(hint).decode().strip()
        return IcebergTable(spark, f"{root}/metadata/v{text}.metadata.json")
    versions = [int(m[1]) for n in store.names(f"{root}/metadata") if (m := re.fullmatch(r"v(\d+)\.metadata\.json", n))]
    if not versions:
        raise EngineError("OBJECT_NOT_FOUND", f"no table at {location}", path=location)
    return IcebergTable(spark, f"{root}/metadata/v{max(versions)}.metadata.json")


def load_catalog(kind: str, **settings):
    """A REST catalog by uri and namespace; others are not supported."""
    if kind == "rest":
        from tarn.sources.rest import RestCatalog

        return RestCatalog(**settings)
    raise EngineError("CATALOG_ERROR", f"catalog {kind} is not supported: use REST, a location or a metadata file")


def load_table(spark: SparkSession, path: str, format: str = "parquet", **read) -> DataFrame:
    """One call for both kinds of tables."""
    if format == "iceberg":
        table = IcebergTable(spark, path) if path.endswith(".json") else load_location(spark, path)
        return table.read(**read)
    if format != "parquet":
        raise EngineError("CATALOG_ERROR", f"no table format {format}")
    from tarn.sources import files

    return files.read_parquet(spark, files.list_files(spark, path), ordinal=False)
