"""Files by HTTP: sizes, ranges, and whole files brought to the folder that all executors share."""

from __future__ import annotations

import urllib.error
import urllib.request
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from tarn.errors import EngineError
from tarn.scratch import scratch

PIECE = 4 << 20


def is_http(source: str) -> bool:
    return source.startswith(("http://", "https://"))


@dataclass
class HttpStore:
    """max_bytes: of one file. What was fetched is kept until the server tells another size or tag."""

    headers: dict[str, str] = field(default_factory=dict)
    timeout: float = 30.0
    max_bytes: int | None = None
    fetched: dict[str, tuple[tuple, str]] = field(default_factory=dict)

    def _open(self, url: str, method: str = "GET", **headers):
        try:
            return urllib.request.urlopen(urllib.request.Request(url, headers=self.headers | headers, method=method), timeout=self.timeout)
        except urllib.error.HTTPError as e:
            code = "OBJECT_NOT_FOUND" if e.code in (404, 410) else "PARQUET_READ_ERROR"
            raise EngineError(code, f"the server answered {e.code} for {url}", path=url, status=e.code) from None
        except OSError as e:
            raise EngineError("PARQUET_READ_ERROR", f"{url} cannot be read: {e}", path=url) from None

    def head(self, url: str) -> tuple[int | None, str | None]:
        """Size and tag, as far as the server tells them."""
        with self._open(url, "HEAD") as answer:
            size = answer.headers.get("Content-Length")
            return None if size is None else int(size), answer.headers.get("ETag") or answer.headers.get("Last-Modified")

    def read(self, url: str, start: int, length: int) -> bytes:
        """A part of a file, cut out here if the server sends all of it."""
        with self._open(url, Range=f"bytes={start}-{start + length - 1}") as answer:
            data = answer.read() if answer.status == 206 else answer.read(start + length)[start:]
        return data[:length]

    def fetch(self, spark: SparkSession, url: str) -> str:
        """The path of a copy, made piece by piece."""
        tag = self.head(url)
        if self.max_bytes is not None and (tag[0] or 0) > self.max_bytes:
            raise EngineError("BUDGET_EXCEEDED", f"max_bytes: {tag[0]} is more than {self.max_bytes}", limit=self.max_bytes, found=tag[0])
        held = self.fetched.get(url)
        if held and held[0] == tag and tag != (None, None):
            return held[1]
        path = f"{scratch(spark, 'http')}/{url.rstrip('/').rpartition('/')[2].partition('?')[0] or 'file'}"
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        out, size = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True), 0
        try:
            with self._open(url) as answer:
                while data := answer.read(PIECE):
                    size += len(data)
                    if self.max_bytes is not None and size > self.max_bytes:
                        raise EngineError("BUDGET_EXCEEDED", f"max_bytes: more than {self.max_bytes}", limit=self.max_bytes)
                    out.write(bytearray(data))
        finally:
            out.close()
        if tag[0] is not None and size != tag[0]:
            raise EngineError("PARQUET_READ_ERROR", f"{url} broke off after {size} of {tag[0]} bytes", path=url)
        self.fetched[url] = tag, path
        return path
