"""CSV and JSON: the shape is found from all rows, then Spark's readers do the work."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.errors import EngineError

DELIMITERS = (",", "\t", ";", "|")


def _first_records(spark: SparkSession, path: str, n: int = 65_536) -> str:
    """The first characters of a file, for detection of its delimiter and header."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise EngineError("OBJECT_NOT_FOUND", f"nothing at {path}", path=path)
    return "\n".join(r.value for r in spark.read.text(path).limit(200).collect())[:n]


def split_line(text: str, delimiter: str) -> list[list[str]]:
    """Records of RFC 4180 text."""
    rows, row, cell, at, quoted = [], [], [], 0, False
    while at < len(text):
        c = text[at]
        if quoted:
            if c == '"' and text[at + 1 : at + 2] == '"':
                cell.append('"')
                at += 1
            elif c == '"':
                quoted = False
            else:
                cell.append(c)
        elif c == '"' and not cell:
            quoted = True
        elif c == delimiter:
            row.append("".join(cell))
            cell = []
        elif c == "\n":
            rows.append([*row, "".join(cell).removesuffix("\r")])
            row, cell = [], []
        else:
            cell.append(c)
        at += 1
    if cell or row:
        rows.append([*row, "".join(cell)])
    return [r for r in rows if r != [""]]


def detect_delimiter(text: str) -> str:
    """The most frequent candidate outside quotes on the first line that has text."""
    line = next((x for x in text.split("\n") if x.strip()), "")
    counts, quoted = dict.fromkeys(DELIMITERS, 0), False
    for c in line:
        quoted ^= c == '"'
        if not quoted and c in counts:
            counts[c] += 1
    return max(DELIMITERS, key=lambda d: counts[d])


def _kind(cell: str) -> str:
    if cell.lower() in ("true", "false"):
        return "boolean"
    try:
        float(cell)
    except ValueError:
        return "string"
    return "number"


def has_header(rows: list[list[str]]) -> bool:
    """Whether the first of two or more rows holds distinct identifiers above a cell that is no string."""
    first = rows[0] if rows else []
    names = len(rows) > 1 and all(c.strip().isidentifier() for c in first) and len(set(first)) == len(first)
    return names and any(_kind(c) != "string" for r in rows[1:] for c in r if c)


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, header: bool | str = "auto", null: str = "", multi_line: bool | None = None, max_rows: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Typed columns: boolean or number if every value of all rows is one, else string.

    A ragged row or an open quote raises when rows are read. Large files are split among
    tasks unless their values hold line ends (multi_line), which is found out if not said.
    """
    check_bytes(spark, path, max_bytes)
    if multi_line is None:  # a line that opens a quote and does not close it
        line = F.col("value")
        multi_line = not spark.read.text(path).where((F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1).isEmpty()
    head = _first_records(spark, path)
    delimiter = delimiter or detect_delimiter(head)
    rows = split_line(head, delimiter)
    if not rows:
        raise EngineError("PARSE_ERROR", "the file is empty")
    first = has_header(rows) if header == "auto" else bool(header)
    names = [c.strip() for c in rows[0]] if first else [f"column{i + 1}" for i in range(len(rows[0]))]
    if "" in names or len(set(names)) < len(names):
        raise EngineError("VALIDATION_ERROR", "the header has empty or repeated names")
    raw = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.schema(raw).option("sep", delimiter).option("quote", '"').option("escape", '"').option("header", first).option("mode", "FAILFAST").option("multiLine", multi_line).option("nullValue", null).option("emptyValue", null or "").option("enforceSchema", True)
    df = reader.csv(path)
    quoted = ["`" + n.replace("`", "``") + "`" for n in names]
    tests = [F.count(F.lit(1)).alias("rows")]
    for i, q in enumerate(quoted):
        c = F.col(q)
        there = c.isNotNull()
        tests += [F.count_if(there).alias(f"n{i}"), F.count_if(there & F.lower(c).isin("true", "false")).alias(f"b{i}"), F.count_if(there & c.try_cast("double").isNotNull()).alias(f"d{i}")]
    try:
        found = df.agg(*tests).first()
    except Exception as e:
        raise EngineError("VALIDATION_ERROR", "a row is ragged or a quote stays open") from e
    check_rows(found["rows"], max_rows)
    cols = []
    for i, (n, q) in enumerate(zip(names, quoted, strict=True)):
        kind = "string" if not found[f"n{i}"] else "boolean" if found[f"b{i}"] == found[f"n{i}"] else "double" if found[f"d{i}"] == found[f"n{i}"] else "string"
        cols.append((F.col(q) if kind == "string" else F.col(q).cast(kind)).alias(n))
    return df.select(*cols)


def check_bytes(spark: SparkSession, path: str, most: int | None) -> None:
    from tarn.sources.files import list_files

    if most is not None and (size := sum(f.size for f in list_files(spark, path))) > most:
        raise EngineError("BUDGET_EXCEEDED", f"max_bytes: {size} is more than {most}", limit=most, found=size)


def check_rows(found: int, most: int | None) -> None:
    if most is not None and found > most:
        raise EngineError("BUDGET_EXCEEDED", f"max_rows: {found} is more than {most}", limit=most, found=found)


def read_json(spark: SparkSession, path: str, format: str = "auto", max_rows: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Objects of a JSON array, one object, or a line each. auto tells by the first character."""
    check_bytes(spark, path, max_bytes)
    head = _first_records(spark, path, 1 << 16).lstrip()
    if format not in ("auto", "json", "ndjson"):
        raise EngineError("VALIDATION_ERROR", f"no format {format}")
    whole = format == "json"
    if format == "auto" and head[:1] in ("[", "{"):
        whole = head[0] == "[" or not _is_object(head.split("\n", 1)[0])
    if not whole:
        lines = spark.read.text(path).where(F.trim("value") != "")
        wrong = lines.where(~F.trim("value").startswith("{")).limit(1).collect()
        if wrong:
            code = "VALIDATION_ERROR" if _is_json(wrong[0].value) else "PARSE_ERROR"
            raise EngineError(code, "a line is no object")
    try:
        df = spark.read.option("mode", "FAILFAST").option("multiLine", whole).json(path)
        if max_rows is not None:
            check_rows(df.limit(max_rows + 1).count(), max_rows)
    except EngineError:
        raise
    except Exception as e:
        raise EngineError("PARSE_ERROR", "the file is no valid JSON") from e
    return df


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def _is_object(text: str) -> bool:
    return _is_json(text) and text.strip().startswith("{")
