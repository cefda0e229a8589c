"""What a query will touch: predicate classes, pruned files, statistics of footers."""

from __future__ import annotations

import json
import threading
from collections import OrderedDict

from pyspark.sql import SparkSession

from tarn.errors import EngineError
from tarn.expr import Between, Call, Col, Compare, Expr, In, Lit, Logical, conjuncts

FLIP = {"lt": "gt", "gt": "lt", "lte": "gte", "gte": "lte"}


def sides(e: Compare) -> tuple[str, str, object] | None:
    """(column, operator, value) of a comparison of a column with a literal."""
    if isinstance(e.left, Col) and isinstance(e.right, Lit):
        return e.left.name, e.op, e.right.value
    if isinstance(e.left, Lit) and isinstance(e.right, Col):
        return e.right.name, FLIP.get(e.op, e.op), e.left.value
    return None


def _holds(op: str, low, high, value) -> bool:
    """Whether some x from low to high can satisfy `x op value`."""
    return {
        "eq": lambda: low <= value <= high,
        "ne": lambda: not (low == high == value),
        "lt": lambda: low < value,
        "lte": lambda: low <= value,
        "gt": lambda: high > value,
        "gte": lambda: high >= value,
    }[op]()


def may_match(e: Expr, bounds: dict[str, tuple]) -> bool:
    """Whether rows within the bounds (least, greatest) of their columns may satisfy e.

    Columns without bounds, and expressions that bounds say nothing about, may.
    bounds may hold "bbox" of a geometry column and "cells" lists, as sidecars do.
    """
    try:
        match e:
            case Logical("and", operands):
                return all(may_match(x, bounds) for x in operands)
            case Logical("or", operands):
                return any(may_match(x, bounds) for x in operands)
            case Compare() if found := sides(e):
                name, op, value = found
                if value is None:
                    return False
                return name not in bounds or _holds(op, *bounds[name], value)
            case Between(Col(name), Lit(low), Lit(high)) if name in bounds and low is not None and high is not None:
                return bounds[name][1] >= low and bounds[name][0] <= high
            case In(Col(name), values, False) if name in bounds and all(isinstance(v, Lit) for v in values):
                return any(v.value is not None and bounds[name][0] <= v.value <= bounds[name][1] for v in values)
            case Call("st_intersects", (Col(name), Lit(shape))) if f"bbox:{name}" in bounds and isinstance(shape, str):
                from tarn.functions.geo import parse

                a, b, c, d = parse(shape).box
                p = bounds[f"bbox:{name}"]
                return p[0] <= c and a <= p[2] and p[1] <= d and b <= p[3]
            case Call("h3_in", (Col(name), Lit(cells))) if f"cells:{name}" in bounds and isinstance(cells, str):
                return not bounds[f"cells:{name}"].isdisjoint(json.loads(cells))
            case Call("h3_within", (Col(name), Lit(origin), Lit(0))) if f"cells:{name}" in bounds:
                return origin in bounds[f"cells:{name}"]
    except TypeError:  # bounds of another type tell nothing
        return True
    return True


def classify(where: Expr | None, partitions: set[str], indexed: set[str] = frozenset()) -> dict[str, list]:
    """Top-level conjuncts by what can use them: partition, file_stats, row_group_stats, residual."""
    out: dict[str, list] = {"partition": [], "file_stats": [], "row_group_stats": [], "residual": []}
    for e in conjuncts(where):
        names = e.columns()
        simple = isinstance(e, (Between, In)) or (isinstance(e, Compare) and sides(e) is not None)
        if names and names <= partitions and not isinstance(e, Call):
            out["partition"].append(e.to_json())
        elif simple and names <= indexed:
            out["file_stats"].append(e.to_json())
        elif simple:
            out["row_group_stats"].append(e.to_json())
        else:
            out["residual"].append(e.to_json())
    return out


class Footers:
    """Parquet footers by path, size and time of change, the most recent of them remembered."""

    def __init__(self, most: int = 1_000):
        self.most, self.held, self.lock, self.hits, self.misses = most, OrderedDict(), threading.Lock(), 0, 0

    def of(self, spark: SparkSession, path: str):
        """A file's metadata, from any store that Spark reads: only the footer is fetched."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
        status = fs.getFileStatus(place)
        size = status.getLen()
        key = (path, size, status.getModificationTime())
        with self.lock:
            if key in self.held:
                self.hits += 1
                self.held.move_to_end(key)
                return self.held[key]
            self.misses += 1
        to_bytes = spark._jvm.org.apache.commons.io.IOUtils.toByteArray
        stream = fs.open(place)
        try:
            stream.seek(size - 8)
            tail = bytes(to_bytes(stream, 8))
            if tail[4:] != b"PAR1":
                raise EngineError("PARQUET_READ_ERROR", f"{path} is no Parquet file", path=path)
            length = int.from_bytes(tail[:4], "little")
            stream.seek(size - 8 - length)
            footer = bytes(to_bytes(stream, length + 8))
        finally:
            stream.close()
        meta = pq.read_metadata(pa.BufferReader(b"PAR1" + footer))
        with self.lock:
            self.held[key] = meta
            while len(self.held) > self.most:
                self.held.popitem(last=False)
        return meta


FOOTERS = Footers()


def planned(spark: SparkSession, files: list, spec) -> dict:
    """What a query over the files will read, by their footers."""
    out = {"row_groups_read": 0, "row_groups_skipped": 0, "rows_decoded": 0, "range_requests": 0, "bytes_requested": 0}
    named = spec.columns() - {"*"}
    read_all = spec.select == ("*",) or not (spec.select or spec.project)
    for f in files:
        found = row_groups(f.path, spec.where, None if read_all else named)
        out["row_groups_read"] += len(found["row_groups"])
        out["row_groups_skipped"] += found["skipped"]
        out["rows_decoded"] += sum(g["row_end"] - g["row_start"] for g in found["row_groups"])
        out["range_requests"] += sum(g["chunks"] for g in found["row_groups"])
        out["bytes_requested"] += sum(g["chunk_bytes"] for g in found["row_groups"])
    return out


def row_groups(path: str, where: Expr | None, columns: set[str] | None = None) -> dict:
    """Row groups of a Parquet file that statistics keep or skip, with byte ranges, and the chunks of the columns to be read."""
    meta = FOOTERS.of(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), path)
    kept, skipped = [], 0
    at = 0
    for i in range(meta.num_row_groups):
        g = meta.row_group(i)
        bounds, start, size, chunks, chunk_bytes = {}, None, 0, 0, 0
        for j in range(g.num_columns):
            c = g.column(j)
            first = c.dictionary_page_offset or c.data_page_offset
            start = first if start is None else min(start, first)
            size += c.total_compressed_size
            if columns is None or c.path_in_schema.partition(".")[0] in columns:
                chunks, chunk_bytes = chunks + 1, chunk_bytes + c.total_compressed_size
            s = c.statistics
            if s is not None and s.has_min_max:
                bounds[c.path_in_schema] = (s.min, s.max)
        if where is None or may_match(where, bounds):
            kept.append({"index": i, "row_start": at, "row_end": at + g.num_rows, "byte_start": start, "bytes": size, "chunks": chunks, "chunk_bytes": chunk_bytes})
        else:
            skipped += 1
        at += g.num_rows
    return {"row_groups": kept, "skipped": skipped, "rows": meta.num_rows}
