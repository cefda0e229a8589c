"""H3 cells as lower-case hexadecimal strings, by bit arithmetic on Columns.

A cell holds its resolution in bits 52 to 55 and a 3-bit digit for each of 15
levels below. Indexing coordinates and disks of k > 0 need the grid's geometry,
for which no library is here; they raise GEO_BACKEND_MISSING.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.errors import EngineError, type_error


def _string(t) -> Column:
    if t.kind not in ("string", "null"):
        raise type_error("an H3 cell is a string")
    return t.column


def h3_in(cell, cells) -> Column:
    if cells.is_literal and isinstance(cells.literal, str):
        try:
            known = json.loads(cells.literal)
        except ValueError:
            raise type_error("h3_in() expects a JSON list of cells") from None
        return _string(cell).isin(*known) if known else F.when(_string(cell).isNotNull(), F.lit(False))
    return F.array_contains(F.from_json(_string(cells), "array<string>"), _string(cell))


def resolution(cell: Column) -> Column:
    bits = F.conv(cell, 16, 10).cast("decimal(20,0)").cast("long")
    return F.shiftright(bits, 52).bitwiseAND(F.lit(15))


def h3_parent(cell, res) -> Column:
    if not res.is_literal or not isinstance(res.literal, int) or not 0 <= res.literal <= 15:
        raise type_error("h3_parent() expects a literal resolution from 0 to 15")
    c, r = _string(cell), res.literal
    bits = F.conv(c, 16, 10).cast("decimal(20,0)").cast("long")
    without = bits.bitwiseAND(F.lit(~(15 << 52)))
    unused = (1 << 3 * (15 - r)) - 1  # the digits below are all 7
    parent = without.bitwiseOR(F.lit(r << 52)).bitwiseOR(F.lit(unused))
    finer = F.when(resolution(c) >= r, F.lower(F.hex(parent)))
    return F.when(c.isNull(), F.lit(None)).otherwise(F.coalesce(finer, F.raise_error(F.lit("TARN_TYPE_ERROR: the parent is finer than the cell")).cast("string")))


def h3_within(cell, origin, k) -> Column:
    if not k.is_literal or not isinstance(k.literal, int) or k.literal < 0:
        raise type_error("h3_within() expects a literal distance")
    if k.literal:
        raise EngineError("GEO_BACKEND_MISSING", "grid disks need an H3 library")
    return _string(cell) == _string(origin)


def h3_cell(lat, lon, res) -> Column:
    raise EngineError("GEO_BACKEND_MISSING", "indexing coordinates needs an H3 library")


FUNCTIONS = [("h3_in", 2, h3_in, "boolean"), ("h3_parent", 2, h3_parent, "string"), ("h3_within", 3, h3_within, "boolean"), ("h3_cell", 3, h3_cell, "string")]
