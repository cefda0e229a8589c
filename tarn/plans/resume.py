"""Slices of a query that can be taken up again, and signed page tokens."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from dataclasses import dataclass

from tarn.errors import EngineError
from tarn.plans.spec import QuerySpec, fingerprint, stable_json


@dataclass(frozen=True)
class Bookmark:
    """The whole query, how many rows were returned, and the files it was planned over."""

    query: dict
    row_offset: int
    plan: str
    state: dict | None = None

    def to_json(self) -> dict:
        return {"version": 1, "query": self.query, "row_offset": self.row_offset, "plan": self.plan, "state": self.state}

    @classmethod
    def from_json(cls, data) -> Bookmark:
        ok = isinstance(data, dict) and data.get("version") == 1 and isinstance(data.get("query"), dict) and isinstance(data.get("plan"), str)
        n = data.get("row_offset") if ok else None
        if not ok or not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise EngineError("BOOKMARK_INVALID", "not a bookmark")
        QuerySpec.from_json(data["query"])
        return cls(data["query"], n, data["plan"], data.get("state"))


def plan_fingerprint(files) -> str:
    """Of the files' paths, sizes and times; order and slice of a query are no part of it."""
    return fingerprint([[f.path, f.size, f.modified] for f in files])


def check_fresh(mark: Bookmark, files) -> None:
    if mark.plan != plan_fingerprint(files):
        raise EngineError("BOOKMARK_STALE", "the files have changed since the bookmark")


def sign(mark: Bookmark, secret: bytes) -> str:
    body = base64.urlsafe_b64encode(stable_json(mark.to_json()).encode()).decode().rstrip("=")
    return f"{body}.{hmac.new(secret, body.encode(), hashlib.sha256).hexdigest()}"


def verify(token: str, secret: bytes) -> Bookmark:
    body, _, given = token.rpartition(".")
    if not body or not hmac.compare_digest(given, hmac.new(secret, body.encode(), hashlib.sha256).hexdigest()):
        raise EngineError("BOOKMARK_INVALID", "the token is not signed with this secret")
    try:
        return Bookmark.from_json(json.loads(base64.urlsafe_b64decode(body + "=" * (-len(body) % 4))))
    except ValueError:
        raise EngineError("BOOKMARK_INVALID", "not a token") from None
