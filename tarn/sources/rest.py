"""Iceberg tables by a REST catalog, as the open specification of its protocol describes it.

Only the catalog speaks HTTP; data and metadata files are read by Spark's file systems.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from dataclasses import dataclass, field
from urllib.parse import quote, urlencode

from pyspark.sql import SparkSession

from tarn.errors import EngineError
from tarn.sources.iceberg import IcebergTable

#: What parts the levels of a namespace in a path.
LEVELS = "\x1f"


@dataclass
class RestCatalog:
    uri: str
    namespace: tuple[str, ...]
    warehouse: str | None = None
    prefix: str | None = None
    token: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    timeout: float = 30.0
    _config: dict | None = None

    def __post_init__(self):
        if not self.namespace or not all(self.namespace):
            raise EngineError("VALIDATION_ERROR", "a namespace is needed")

    def _ask(self, method: str, url: str, body: dict | None = None) -> dict:
        headers = {"Accept": "application/json", **self.headers}
        headers |= {"Authorization": f"Bearer {self.token}"} if self.token else {}
        headers |= {"Content-Type": "application/json"} if body is not None else {}
        request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), headers, method=method)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                text = answer.read()
        except urllib.error.HTTPError as e:
            if e.code == 409 and method == "POST":
                raise EngineError("ICEBERG_COMMIT_CONFLICT", "another commit was first", url=url) from None
            raise EngineError("CATALOG_ERROR", f"the catalog answered {e.code}", url=url, status=e.code) from None
        except OSError as e:
            raise EngineError("CATALOG_ERROR", f"the catalog cannot be reached: {e}", url=url) from None
        try:
            found = json.loads(text) if text.strip() else {}
        except ValueError:
            raise EngineError("CATALOG_ERROR", "the catalog's answer is no JSON", url=url) from None
        if not isinstance(found, dict):
            raise EngineError("CATALOG_ERROR", "the catalog's answer is no object", url=url)
        return found

    def config(self) -> dict:
        """defaults and overrides, asked for once."""
        if self._config is None:
            more = f"?{urlencode({'warehouse': self.warehouse})}" if self.warehouse else ""
            found = self._ask("GET", f"{self.uri.rstrip('/')}/v1/config{more}")
            if not all(isinstance(found.get(k, {}), dict) for k in ("defaults", "overrides")):
                raise EngineError("CATALOG_ERROR", "the catalog's settings are no objects")
            self._config = found
        return self._config

    def _tables_url(self) -> str:
        found = self.config()
        prefix = (found.get("overrides") or {}).get("prefix") or self.prefix or (found.get("defaults") or {}).get("prefix")
        parts = [quote(p, safe="") for p in (prefix or "").split("/") if p]
        return "/".join([self.uri.rstrip("/"), "v1", *parts, "namespaces", quote(LEVELS.join(self.namespace), safe=""), "tables"])

    def _url(self, table: str) -> str:
        if not table:
            raise EngineError("VALIDATION_ERROR", "a table is needed")
        return f"{self._tables_url()}/{quote(table, safe='')}"

    def tables(self) -> list[str]:
        """The namespace's tables."""
        names, page = [], None
        while True:
            found = self._ask("GET", self._tables_url() + (f"?{urlencode({'pageToken': page})}" if page else ""))
            try:
                names += [t["name"] for t in found["identifiers"]]
            except (KeyError, TypeError):
                raise EngineError("CATALOG_ERROR", "the catalog lists no tables") from None
            page = found.get("next-page-token")
            if not page:
                return names

    def load(self, spark: SparkSession, table: str) -> IcebergTable:
        """A table as the catalog has it now."""
        found = self._ask("GET", self._url(table))
        if not isinstance(found.get("metadata"), dict):
            raise EngineError("CATALOG_ERROR", "the catalog gives no metadata")
        return IcebergTable(spark, found.get("metadata-location") or "", found["metadata"])

    def append(self, spark: SparkSession, table: str, files: list[dict], now_ms: int | None = None) -> IcebergTable:
        """A snapshot with more data files: the manifest is written beside the table, the catalog commits."""
        old = self.load(spark, table)
        snapshot = old.next_snapshot(files, now_ms)
        before = (old.snapshot() or {}).get("snapshot-id")
        body = {
            "identifier": {"namespace": list(self.namespace), "name": table},
            "requirements": [{"type": "assert-ref-snapshot-id", "ref": "main", "snapshot-id": before}],
            "updates": [{"action": "add-snapshot", "snapshot": snapshot}, {"action": "set-snapshot-ref", "ref-name": "main", "type": "branch", "snapshot-id": snapshot["snapshot-id"]}],
        }
        self._ask("POST", self._url(table), body)
        return self.load(spark, table)
