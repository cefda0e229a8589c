"""Typed errors: every refusal carries a code and details."""

from __future__ import annotations

# The error codes.
CODES = (
    "PARSE_ERROR SQL_UNSUPPORTED TYPE_ERROR UNKNOWN_TABLE UNKNOWN_COLUMN UNSUPPORTED_PUSHDOWN BUDGET_EXCEEDED "
    "GROUP_LIMIT_EXCEEDED OBJECT_NOT_FOUND CATALOG_ERROR UNSUPPORTED_ICEBERG_FEATURE UNSUPPORTED_PARQUET_FEATURE "
    "ICEBERG_COMMIT_CONFLICT UNSUPPORTED_DELETE_FILES PARQUET_READ_ERROR PARQUET_WRITE_ERROR VALIDATION_ERROR "
    "BOOKMARK_STALE BOOKMARK_INVALID ABORTED GEO_BACKEND_MISSING"
).split()


class EngineError(Exception):
    """code is one of CODES with the prefix TARN_."""

    def __init__(self, code: str, message: str, **details):
        if code not in CODES:
            raise ValueError(code)
        super().__init__(f"TARN_{code}: {message}")
        self.code, self.message, self.details = f"TARN_{code}", message, details


def type_error(message: str, **details) -> EngineError:
    return EngineError("TYPE_ERROR", message, **details)


def unsupported(message: str, **details) -> EngineError:
    return EngineError("SQL_UNSUPPORTED", message, **details)
