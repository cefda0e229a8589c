"""Scalar functions by lower-case name, on typed Columns."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.errors import EngineError, type_error
from tarn.functions import geo, h3
from tarn.plans.compile import Typed, as_time

REGISTRY: dict[str, tuple[int, int, object]] = {}


def register(name: str, least: int, most: int | None = None):
    """A function of `least` to `most` arguments."""

    def keep(f):
        REGISTRY[name] = (least, least if most is None else most, f)
        return f

    return keep


def call(name: str, args: list[Typed]) -> Typed:
    found = REGISTRY.get(name.lower())
    if not found:
        raise EngineError("UNSUPPORTED_PUSHDOWN", f"no function {name}", function=name)
    least, most, f = found
    if not least <= len(args) <= most:
        raise type_error(f"{name} takes {least} to {most} arguments, not {len(args)}")
    return f(*args)


def want(t: Typed, kind: str) -> Column:
    if t.kind not in (kind, "null"):
        raise type_error(f"{kind} expected, not {t.kind}")
    return t.column


def constant(t: Typed, kind: type, what: str):
    if not t.is_literal or not isinstance(t.literal, kind):
        raise type_error(f"{what} must be a literal {kind.__name__}")
    return t.literal


def text(f):
    return lambda t: Typed(f(want(t, "string")), "string")


SPACE = r"[\s\p{Z}\x{FEFF}]+"
register("lower", 1)(text(F.lower))
register("upper", 1)(text(F.upper))
register("trim", 1)(text(lambda c: F.regexp_replace(c, f"^{SPACE}|{SPACE}$", "")))


@register("substr", 3)
def substr(s: Typed, start: Typed, size: Typed) -> Typed:
    """The characters from start (0-based; from the end if negative) up to start + size."""
    c, n = want(s, "string"), F.length(want(s, "string")).cast("long")
    a = want(start, "number").cast("long")
    end = a + want(size, "number").cast("long")

    def place(x):
        return F.when(x < 0, F.greatest(n + x, F.lit(0))).otherwise(F.least(x, n))

    return Typed(F.substring(c, (place(a) + 1).cast("int"), F.greatest(place(end) - place(a), F.lit(0)).cast("int")), "string")


@register("replace", 3)
def replace(s: Typed, search: Typed, by: Typed) -> Typed:
    """All literal occurrences; an empty search string changes nothing."""
    return Typed(F.replace(want(s, "string"), want(search, "string"), want(by, "string")), "string")


def regex_flags(options: str) -> tuple[str, bool, bool]:
    """(inline flags, all matches, literal pattern) of the option letters."""
    flags, everywhere, plain = set(), False, False
    for o in options:
        if o == "i":
            flags.add("i")
        elif o == "c":
            flags.discard("i")
        elif o == "g":
            everywhere = True
        elif o == "l":
            plain = True
        elif o in "mnp":
            flags.add("m")
        elif o == "s":
            flags.add("s")
        else:
            raise type_error(f"no regular expression option {o}")
    return f"(?{''.join(sorted(flags))})" if flags else "", everywhere, plain


def pattern_of(pattern: Typed, options: Typed | None) -> tuple[str, bool]:
    body = constant(pattern, str, "a pattern")
    flags, everywhere, plain = regex_flags(constant(options, str, "options") if options else "")
    return flags + (r"\Q" + body.replace(r"\E", r"\E\\E\Q") + r"\E" if plain else body), everywhere


@register("regexp_matches", 2, 3)
def regexp_matches(s: Typed, pattern: Typed, options: Typed | None = None) -> Typed:
    return Typed(want(s, "string").rlike(pattern_of(pattern, options)[0]), "boolean")


@register("regexp_replace", 3, 4)
def regexp_replace(s: Typed, pattern: Typed, by: Typed, options: Typed | None = None) -> Typed:
    r"""The first match, or all with option g; \1 to \9 in the replacement are groups.

    The first match is replaced by one pattern that also eats the rest of the
    text, so that lookaround, anchors and \b keep their surroundings.
    """
    body, everywhere = pattern_of(pattern, options)
    wanted = constant(by, str, "a replacement")
    c = want(s, "string")
    java = re.sub(r"\\([1-9])", "\x00\\1", wanted.replace("$", "\\$")).replace("\x00", "$")
    if everywhere:
        return Typed(F.regexp_replace(c, body, java), "string")
    flags = re.match(r"\(\?[ims]+\)", body)
    inner = body[flags.end() :] if flags else body
    # Not again at the end of the text, where the match before it ended: a pattern may match nothing.
    once = f"{flags.group() if flags else ''}(?!\\G(?<=[\\s\\S]))(?:{inner})(?<tarnrest>[\\s\\S]*)\\z"
    return Typed(F.regexp_replace(c, once, java + "${tarnrest}"), "string")


@register("coalesce", 1, 99)
def coalesce(*args: Typed) -> Typed:
    return Typed(F.coalesce(*[a.column for a in args]), one_kind(args))


@register("nullif", 2)
def nullif(a: Typed, b: Typed) -> Typed:
    one_kind((a, b))
    return Typed(F.nullif(a.column, b.column), a.kind)


def one_kind(args) -> str:
    kinds = {a.kind for a in args} - {"null"}
    if len(kinds) > 1:
        raise type_error(f"arguments of different kinds: {sorted(kinds)}")
    return next(iter(kinds), "null")


def extreme(f):
    """Null if any argument is."""

    def of(*args: Typed) -> Typed:
        kind = one_kind(args)
        if len(args) == 1:
            return args[0]
        any_null = functools.reduce(lambda a, b: a | b, [a.column.isNull() for a in args])
        return Typed(F.when(~any_null, f(*[a.column for a in args])), kind)

    return of


register("least", 1, 99)(extreme(F.least))
register("greatest", 1, 99)(extreme(F.greatest))


@register("cast", 2)
def cast(v: Typed, target: Typed) -> Typed:
    to = constant(target, str, "the target of a cast")
    c = v.column
    if to == "string":
        if v.kind == "number":
            d = c.cast("double")
            whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
            c = F.when(F.isnan(d), F.lit("NaN")).when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))
        return Typed(c.cast("string"), "string")
    if to in ("float64", "number"):
        if v.kind == "string":
            trimmed = F.trim(c)
            c = F.when(trimmed == "", F.lit(0.0)).otherwise(trimmed.try_cast("double"))
        elif v.kind == "time":
            c = F.unix_millis(c.cast("timestamp")).cast("double")
        else:
            c = c.cast("double")
        return Typed(F.when(~F.isnan(c), c), "number")
    if to == "boolean":
        if v.kind == "string":
            return Typed(F.length(c) > 0, "boolean")
        if v.kind == "number":
            return Typed((c != 0) & ~F.isnan(c.cast("double")), "boolean")
        return Typed(c if v.kind in ("boolean", "null") else c.isNotNull(), "boolean")
    raise type_error(f"no cast to {to}")


def date_part(f):
    return lambda t: Typed(f(as_time(t).column).cast("int"), "number")


for _name, _f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour)):
    register(_name, 1)(date_part(_f))


@register("date_trunc", 2)
def date_trunc(part: Typed, t: Typed) -> Typed:
    """The start of the year, month, day or hour as an ISO string in UTC."""
    unit = constant(part, str, "a date part")
    if unit not in ("year", "month", "day", "hour"):
        raise type_error(f"no date part {unit}")
    return Typed(F.date_format(F.date_trunc(unit, as_time(t).column.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "string")


@register("round", 1, 2)
def round_(x: Typed, places: Typed | None = None) -> Typed:
    """Halves go towards positive infinity."""
    scale = 10.0 ** constant(places, int, "places") if places else 1.0
    return Typed(F.floor(want(x, "number").cast("double") * scale + 0.5).cast("double") / scale, "number")


register("floor", 1)(lambda x: Typed(F.floor(want(x, "number").cast("double")).cast("double"), "number"))
register("ceil", 1)(lambda x: Typed(F.ceil(want(x, "number").cast("double")).cast("double"), "number"))
register("abs", 1)(lambda x: Typed(F.abs(want(x, "number").cast("double")), "number"))


def spatial(name: str, least: int, of, kind: str):
    def made(*args: Typed) -> Typed:
        found = of(*args)
        return found if isinstance(found, Typed) else Typed(found, kind)

    register(name, least)(made)


for _n, _k, _f, _kind in geo.FUNCTIONS:
    spatial(_n, _k, _f, _kind)
for _n, _k, _f, _kind in h3.FUNCTIONS:
    spatial(_n, _k, _f, _kind)
