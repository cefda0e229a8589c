"""Avro object container files, for table manifests: a small decoder."""

from __future__ import annotations

import json
import struct
import zlib

from tarn.errors import EngineError


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise EngineError("CATALOG_ERROR", "the Avro file ends early")
        self.at += n
        return out

    def long(self) -> int:
        shift = value = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 127) << shift
            if b < 128:
                return (value >> 1) ^ -(value & 1)
            shift += 7

    def bytes(self) -> bytes:
        return self.take(self.long())

    def items(self):
        """Counts of the blocks of an array or map."""
        while n := self.long():
            if n < 0:
                self.long()
                n = -n
            yield from range(n)

    def value(self, schema, names: dict):
        if isinstance(schema, list):
            return self.value(schema[self.long()], names)
        if isinstance(schema, str):
            if schema in names:
                return self.value(names[schema], names)
            kind, schema = schema, {}
        else:
            kind = schema["type"]
        if isinstance(kind, (dict, list)):
            return self.value(kind, names)
        if "name" in schema and kind in ("record", "fixed", "enum"):
            names[schema["name"]] = schema
        match kind:
            case "null":
                return None
            case "boolean":
                return self.take(1) == b"\x01"
            case "int" | "long":
                return self.long()
            case "float":
                return struct.unpack("<f", self.take(4))[0]
            case "double":
                return struct.unpack("<d", self.take(8))[0]
            case "bytes":
                return self.bytes()
            case "string":
                return self.bytes().decode()
            case "fixed":
                return self.take(schema["size"])
            case "enum":
                return schema["symbols"][self.long()]
            case "array":
                return [self.value(schema["items"], names) for _ in self.items()]
            case "map":
                return {self.bytes().decode(): self.value(schema["values"], names) for _ in self.items()}
            case "record":
                return {f["name"]: self.value(f["type"], names) for f in schema["fields"]}
        raise EngineError("CATALOG_ERROR", f"Avro type {kind} is not supported")


def records(data: bytes) -> list[dict]:
    """All records of a container file."""
    r = Reader(data)
    if r.take(4) != b"Obj\x01":
        raise EngineError("CATALOG_ERROR", "not an Avro file")
    meta = {r.bytes().decode(): r.bytes() for _ in r.items()}
    schema, codec = json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode()
    if codec not in ("null", "deflate"):
        raise EngineError("CATALOG_ERROR", f"Avro codec {codec} is not supported")
    mark, out = r.take(16), []
    while r.at < len(data):
        n, block = r.long(), r.bytes()
        inner = Reader(zlib.decompress(block, -15) if codec == "deflate" else block)
        out += [inner.value(schema, {}) for _ in range(n)]
        if r.take(16) != mark:
            raise EngineError("CATALOG_ERROR", "the Avro file is damaged")
    return out
