"""Planar geometry: points, line strings, polygons and boxes.

Geometries are GeoJSON or box JSON strings, POINT(x y) text, or WKB/EWKB bytes. What is
known to be a point or a box, made by st_point() and st_bbox() or written as a literal,
is plain Columns throughout. Other shapes are examined in Arrow-batched functions; in a
condition on texts a Column compares the envelopes first, and only rows whose envelopes
meet reach Python. Edges belong to their polygon for st_intersects, not for st_contains
of a point.
"""

from __future__ import annotations

import functools
import json
import math
import re
import struct
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.errors import type_error

Point = tuple[float, float]


@dataclass(frozen=True)
class Shape:
    """kind: Point, LineString, Polygon or BBox. Polygons and boxes are closed rings, the first the outer one."""

    kind: str
    rings: tuple[tuple[Point, ...], ...]

    @property
    def points(self) -> list[Point]:
        return [p for r in self.rings for p in r]

    @property
    def box(self) -> tuple[float, float, float, float]:
        xs, ys = zip(*self.points, strict=True)
        return min(xs), min(ys), max(xs), max(ys)

    @property
    def solid(self) -> bool:
        return self.kind in ("Polygon", "BBox")


def _closed(ring) -> tuple[Point, ...]:
    ring = tuple((float(p[0]), float(p[1])) for p in ring)
    return ring if ring[0] == ring[-1] else (*ring, ring[0])


def box_shape(a: float, b: float, c: float, d: float) -> Shape:
    return Shape("BBox", (((a, b), (c, b), (c, d), (a, d), (a, b)),))


def from_wkb(data: bytes) -> Shape:
    order = "<" if data[0] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", data, 1)
    at = 9 if code & 0x20000000 else 5
    plain = code & 0x0FFFFFFF
    dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000) + {1: 1, 2: 1, 3: 2}.get(plain // 1000, 0)

    def take(n: int) -> list[Point]:
        nonlocal at
        values = struct.unpack_from(f"{order}{n * dims}d", data, at)
        at += 8 * n * dims
        return [(values[i * dims], values[i * dims + 1]) for i in range(n)]

    def size() -> int:
        nonlocal at
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        return n

    kind = plain % 1000
    if kind == 1:
        return Shape("Point", (tuple(take(1)),))
    if kind == 2:
        return Shape("LineString", (tuple(take(size())),))
    if kind == 3:
        return Shape("Polygon", tuple(_closed(take(size())) for _ in range(size())))
    raise type_error(f"WKB geometry type {kind} is not supported")


_WKT = re.compile(r"\s*POINT\s*\(\s*(\S+)\s+(\S+)\s*\)\s*$", re.IGNORECASE)


def parse(value) -> Shape:
    try:
        if isinstance(value, (bytes, bytearray, memoryview)):
            return from_wkb(bytes(value))
        if m := _WKT.match(value):
            return Shape("Point", (((float(m[1]), float(m[2])),),))
        data = json.loads(value)
        kind, places = data["type"], data.get("coordinates")
        if kind == "Point":
            return Shape(kind, (((float(places[0]), float(places[1])),),))
        if kind == "LineString":
            return Shape(kind, (tuple((float(p[0]), float(p[1])) for p in places),))
        if kind == "Polygon":
            return Shape(kind, tuple(map(_closed, places)))
        if kind == "BBox":
            return box_shape(*(float(data[k]) for k in ("minx", "miny", "maxx", "maxy")))
    except (ValueError, KeyError, TypeError, IndexError, struct.error) as e:
        raise type_error(f"not a geometry: {e}") from None
    raise type_error(f"geometry type {kind} is not supported")


def _turn(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _on(p: Point, a: Point, b: Point) -> bool:
    return _turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _cross(a: Point, b: Point, c: Point, d: Point) -> bool:
    """Whether two closed segments share a point."""
    s, t, u, v = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    if s * t < 0 and u * v < 0:
        return True
    return _on(c, a, b) or _on(d, a, b) or _on(a, c, d) or _on(b, c, d)


def _edges(shape: Shape) -> list[tuple[Point, Point]]:
    return [(a, b) for r in shape.rings for a, b in zip(r, r[1:], strict=False)] or [(p, p) for p in shape.points]


def place(p: Point, shape: Shape) -> int:
    """1 inside, 0 on an edge, -1 outside of a polygon with holes."""
    inside = False
    for ring in shape.rings:
        for a, b in zip(ring, ring[1:], strict=False):
            if _on(p, a, b):
                return 0
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
                inside = not inside
    return 1 if inside else -1


def _apart(a: Shape, b: Shape, by: float = 0.0) -> bool:
    p, q = a.box, b.box
    return p[0] > q[2] + by or q[0] > p[2] + by or p[1] > q[3] + by or q[1] > p[3] + by


def intersects(a: Shape, b: Shape) -> bool:
    if _apart(a, b):
        return False
    if any(_cross(*e, *f) for e in _edges(a) for f in _edges(b)):
        return True
    return (a.solid and place(b.points[0], a) >= 0) or (b.solid and place(a.points[0], b) >= 0)


def _pieces(edge: tuple[Point, Point], other: Shape) -> list[Point]:
    """Middles of the parts into which other's edges cut an edge."""
    (ax, ay), (bx, by) = edge
    cuts = {0.0, 1.0}
    for (cx, cy), (dx, dy) in _edges(other):
        base = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
        if base:
            t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / base
            if 0 < t < 1:
                cuts.add(t)
    order = sorted(cuts)
    return [(ax + (bx - ax) * (s + t) / 2, ay + (by - ay) * (s + t) / 2) for s, t in zip(order, order[1:], strict=False)]


def contains(a: Shape, b: Shape) -> bool:
    """Whether no point of b is outside a and some point is inside."""
    if _apart(a, b):
        return False
    if b.kind == "Point":
        p = b.points[0]
        if a.solid:
            return place(p, a) > 0
        if a.kind == "Point":
            return p == a.points[0]
        return any(_on(p, *e) for e in _edges(a)) and p not in (a.points[0], a.points[-1])
    if a.kind == "Point":
        return False
    if a.kind == "LineString":
        return b.kind == "LineString" and all(any(_on(m, *e) for e in _edges(a)) for f in _edges(b) for m in (*f, *_pieces(f, a)))
    places = [place(m, a) for f in _edges(b) for m in (*f, *_pieces(f, a))]
    if any(x < 0 for x in places):
        return False
    if b.solid:  # a hole of a must not lie inside b
        return not any(place(m, b) > 0 and place(m, a) == 0 for r in a.rings[1:] for m in r)
    return any(x > 0 for x in places)


def _to_segment(p: Point, a: Point, b: Point) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    base = dx * dx + dy * dy
    t = 0.0 if base == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / base))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def exact_distance(a: Shape, b: Shape) -> float:
    if intersects(a, b):
        return 0.0
    return min(min(_to_segment(e[0], *f), _to_segment(e[1], *f), _to_segment(f[0], *e), _to_segment(f[1], *e)) for e in _edges(a) for f in _edges(b))


def box_distance(a: Shape, b: Shape) -> float:
    p, q = a.box, b.box
    return math.hypot(max(p[0] - q[2], q[0] - p[2], 0.0), max(p[1] - q[3], q[1] - p[3], 0.0))


def area(s: Shape) -> float:
    """Of a polygon, the area of all its coordinates taken as one ring."""
    if not s.solid:
        return 0.0
    p = s.points
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, [*p[1:], p[0]], strict=True))) / 2


def length(s: Shape) -> float:
    return 0.0 if s.kind == "Point" else sum(math.dist(a, b) for a, b in zip(s.points, s.points[1:], strict=False))


def number(x: float) -> float | int:
    return int(x) if x == int(x) and abs(x) < 1e15 else x


def point_json(x: float, y: float) -> str:
    return json.dumps({"type": "Point", "coordinates": [number(x), number(y)]}, separators=(",", ":"))


def box_json(a: float, b: float, c: float, d: float) -> str:
    return json.dumps({"type": "BBox", "minx": number(a), "miny": number(b), "maxx": number(c), "maxy": number(d)}, separators=(",", ":"))


def centroid(s: Shape) -> str:
    a, b, c, d = s.box
    return point_json((a + c) / 2, (b + d) / 2)


def coordinate(i: int):
    def of(s: Shape) -> float:
        if s.kind != "Point":
            raise type_error("a Point is expected")
        return s.points[0][i]

    return of


def make_point(lon: float, lat: float) -> str:
    if not (math.isfinite(lon) and math.isfinite(lat)):
        raise type_error("st_point() expects finite numbers")
    return point_json(lon, lat)


def make_box(a: float, b: float, c: float, d: float) -> str:
    if not all(map(math.isfinite, (a, b, c, d))) or a > c or b > d:
        raise type_error("st_bbox() expects finite ordered bounds")
    return box_json(a, b, c, d)


def batched(of, kind: str, shapes: int, numbers: int = 0):
    """A Column function of `shapes` geometries followed by `numbers` numbers; null if any is null."""

    def column(*args) -> Column:
        for a in args[:shapes]:
            if a.kind not in ("string", "binary", "null"):
                raise type_error("a geometry is expected")
        for a in args[shapes:]:
            if a.kind not in ("number", "null"):
                raise type_error("a number is expected")

        def run(frame: pd.DataFrame) -> pd.Series:
            seen: dict = {}

            def shape(v):
                if (s := seen.get(v)) is None:
                    if len(seen) > 10_000:
                        seen.clear()
                    s = seen[v] = parse(v)
                return s

            out = []
            for row in zip(*[frame[c] for c in frame.columns], strict=True):
                null = any(v is None or (isinstance(v, float) and math.isnan(v)) for v in row)
                out.append(None if null else of(*[shape(v) for v in row[:shapes]], *row[shapes:]))
            return pd.Series(out, dtype=object if kind in ("string", "boolean") else float)

        cols = [a.column for a in args[:shapes]] + [a.column.cast("double") for a in args[shapes:]]
        run.__annotations__ = {"frame": pd.DataFrame, "return": pd.Series}  # not as text
        return F.pandas_udf(run, kind)(F.struct(*[c.alias(f"a{i}") for i, c in enumerate(cols)]))

    return column


_NUMBER = r"(-?[0-9][0-9.eE+-]*)"
_PAIR = rf"\[\s*{_NUMBER}\s*,\s*{_NUMBER}"
_POINT_TEXT = r"(?i)^\s*POINT\s*\(\s*([^\s)]+)\s+([^\s)]+)\s*\)\s*$"


def _known(t):
    """What is known of a shape: ("Point", x, y) or ("BBox", minx, miny, maxx, maxy) as Columns."""
    if t.shape or not t.is_literal or not isinstance(t.literal, (str, bytes)):
        return t.shape
    s = parse(t.literal)
    if s.kind == "Point":
        return ("Point", *map(F.lit, s.points[0]))
    return ("BBox", *map(F.lit, s.box)) if s.kind == "BBox" else None


def _corners(shape: tuple) -> tuple:
    return shape[1:] if shape[0] == "BBox" else (*shape[1:], *shape[1:])


def _envelope(t) -> tuple | None:
    """The corners of a geometry's envelope as Columns, null where a text does not show them; None if there is no telling."""
    if shape := _known(t):
        return _corners(shape)
    if t.is_literal and isinstance(t.literal, (str, bytes)):
        return tuple(map(F.lit, parse(t.literal).box))
    if t.kind != "string":
        return None
    c = t.column
    ends = []
    for i, (low, high) in enumerate((("minx", "maxx"), ("miny", "maxy"))):
        places = F.transform(F.regexp_extract_all(c, F.lit(_PAIR), F.lit(i + 1)), lambda v: v.try_cast("double"))
        alone = F.regexp_extract(c, _POINT_TEXT, i + 1).try_cast("double")
        ends.append([F.coalesce(pick(places), F.get_json_object(c, f"$.{side}").try_cast("double"), alone) for pick, side in ((F.array_min, low), (F.array_max, high))])
    return ends[0][0], ends[1][0], ends[0][1], ends[1][1]


def _number_text(x: Column) -> Column:
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    plain = (F.abs(x) >= 1e-3) & (F.abs(x) < 1e7)
    spelled = F.regexp_replace(x.try_cast("decimal(38,18)").cast("string"), "\\.?0+$", "")
    return F.when(whole, x.cast("long").cast("string")).when(plain, x.cast("string")).otherwise(F.coalesce(spelled, x.cast("string")))


def _point_text(x: Column, y: Column) -> Column:
    return F.concat(F.lit('{"type":"Point","coordinates":['), _number_text(x), F.lit(","), _number_text(y), F.lit("]}"))


def _box_text(a: Column, b: Column, c: Column, d: Column) -> Column:
    pieces = [F.lit('{"type":"BBox"')]
    for name, v in (("minx", a), ("miny", b), ("maxx", c), ("maxy", d)):
        pieces += [F.lit(f',"{name}":'), _number_text(v)]
    return F.concat(*pieces, F.lit("}"))


def _numbers(args) -> list[Column]:
    for a in args:
        if a.kind not in ("number", "null"):
            raise type_error("a number is expected")
    return [a.column.cast("double") for a in args]


def _refused(bad: Column, value: Column, message: str) -> Column:
    return F.when(bad, F.raise_error(F.lit(f"TARN_TYPE_ERROR: {message}")).cast("double")).otherwise(value)


def _infinite(*values: Column) -> Column:
    return functools.reduce(lambda p, q: p | q, [F.isnan(v) | (F.abs(v) == float("inf")) for v in values])


def _shaped(shape: tuple, text: Column):
    from tarn.plans.compile import Typed

    return Typed(text, "string", shape=shape)


def point_column(*args):
    """Null if a coordinate is."""
    values = _numbers(args)
    x, y = (F.when(values[0].isNotNull() & values[1].isNotNull(), _refused(_infinite(*values), v, "st_point() expects finite numbers")) for v in values)
    return _shaped(("Point", x, y), _point_text(x, y))


def box_column(*args):
    v = _numbers(args)
    bad = _infinite(*v) | (v[0] > v[2]) | (v[1] > v[3])
    some = functools.reduce(lambda p, q: p & q, [c.isNotNull() for c in v])
    corners = [F.when(some, _refused(bad, c, "st_bbox() expects finite ordered bounds")) for c in v]
    return _shaped(("BBox", *corners), _box_text(*corners))


def coordinate_column(i: int):
    exact = batched(coordinate(i), "double", 1)

    def of(t) -> Column:
        if (shape := _known(t)) and shape[0] == "Point":
            return shape[1 + i]
        if t.kind != "string":
            return exact(t)
        c = t.column
        own = F.from_json(c, "struct<type:string,coordinates:array<double>>")
        place = F.when((own["type"] == "Point") & (F.size(own["coordinates"]) >= 2), F.get(own["coordinates"], i))
        alone = F.regexp_extract(c, _POINT_TEXT, i + 1).try_cast("double")
        wrong = F.raise_error(F.lit("TARN_TYPE_ERROR: a Point is expected")).cast("double")
        return F.when(c.isNotNull(), F.coalesce(place, alone, wrong))

    return of


def _overlap(p: tuple, q: tuple, by: Column | None = None) -> Column:
    far = [p[0] - q[2], q[0] - p[2], p[1] - q[3], q[1] - p[3]]
    return functools.reduce(lambda a, b: a & b, [d <= (F.lit(0.0) if by is None else by) for d in far])


def _gap(p: tuple, q: tuple) -> Column:
    none = F.lit(0.0)
    value = F.hypot(F.greatest(p[0] - q[2], q[0] - p[2], none), F.greatest(p[1] - q[3], q[1] - p[3], none))
    # greatest() passes over nulls, a missing geometry has no distance.
    return F.when(functools.reduce(lambda a, b: a & b, [c.isNotNull() for c in (*p, *q)]), value)


def _box_contains(a: tuple, b: tuple) -> Column:
    p, q = _corners(a), _corners(b)
    if a[0] == "Point":
        both = (a[1] == q[0]) & (a[2] == q[1])
        return both if b[0] == "Point" else F.when(both.isNotNull(), F.lit(False))
    if b[0] == "Point":
        return (q[0] > p[0]) & (q[0] < p[2]) & (q[1] > p[1]) & (q[1] < p[3])
    return (q[0] >= p[0]) & (q[2] <= p[2]) & (q[1] >= p[1]) & (q[3] <= p[3])


def predicate(exact_of, of_known, needs_overlap: bool = True):
    """of_known on points and boxes; on other shapes exact_of, behind a comparison of envelopes if it needs them to meet."""
    exact = batched(exact_of, "boolean", 2)

    def of(a, b) -> Column:
        known = _known(a), _known(b)
        if all(known):
            return of_known(*known)
        found = exact(a, b)
        ends = _envelope(a), _envelope(b)
        return F.coalesce(_overlap(*ends), F.lit(True)) & found if needs_overlap and all(ends) else found

    return of


def dwithin_column(a, b, d) -> Column:
    exact = batched(lambda p, q, by: not _apart(p, q, by) and exact_distance(p, q) <= by, "boolean", 2, 1)
    known, by = (_known(a), _known(b)), _numbers([d])[0]
    if all(known):
        return _gap(*map(_corners, known)) <= by
    found, ends = exact(a, b, d), (_envelope(a), _envelope(b))
    return F.coalesce(_overlap(*ends, by), F.lit(True)) & found if all(ends) else found


def measured(of_shape, kind: str, of_known):
    """A function of one geometry: of_known on a point or a box, of_shape on others."""
    exact = batched(of_shape, kind, 1)

    def of(t):
        known = _known(t)
        return of_known(known) if known else exact(t)

    return of


def distance_column(a, b) -> Column:
    known = _known(a), _known(b)
    return _gap(*map(_corners, known)) if all(known) else batched(box_distance, "double", 2)(a, b)


def _sides(shape: tuple) -> tuple[Column, Column]:
    a, b, c, d = _corners(shape)
    return c - a, d - b


def _centre(shape: tuple):
    a, b, c, d = _corners(shape)
    x, y = (a + c) / 2, (b + d) / 2
    return _shaped(("Point", x, y), _point_text(x, y))


def _round_about(shape: tuple) -> Column:
    w, h = _sides(shape)
    return w + h + w + h


FUNCTIONS = [
    ("st_point", 2, point_column, "string"),
    ("st_bbox", 4, box_column, "string"),
    ("st_x", 1, coordinate_column(0), "number"),
    ("st_y", 1, coordinate_column(1), "number"),
    ("st_intersects", 2, predicate(intersects, lambda a, b: _overlap(_corners(a), _corners(b))), "boolean"),
    ("st_disjoint", 2, predicate(lambda a, b: not intersects(a, b), lambda a, b: ~_overlap(_corners(a), _corners(b)), False), "boolean"),
    ("st_contains", 2, predicate(contains, _box_contains), "boolean"),
    ("st_within", 2, predicate(lambda a, b: contains(b, a), lambda a, b: _box_contains(b, a)), "boolean"),
    ("st_dwithin", 3, dwithin_column, "boolean"),
    ("st_distance", 2, distance_column, "number"),
    ("st_area", 1, measured(area, "double", lambda s: _sides(s)[0] * _sides(s)[1]), "number"),
    ("st_length", 1, measured(length, "double", _round_about), "number"),
    ("st_centroid", 1, measured(centroid, "string", _centre), "string"),
    ("st_envelope", 1, measured(lambda s: box_json(*s.box), "string", lambda s: _shaped(("BBox", *_corners(s)), _box_text(*_corners(s)))), "string"),
]
