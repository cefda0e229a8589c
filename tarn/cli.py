"""Command line: query, explain, inspect, schema, write and compact Parquet files."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from tarn import sinks
from tarn.errors import EngineError
from tarn.lake import Lake
from tarn.plans import explain
from tarn.sources import files


def table_arguments(pairs: list[str]) -> dict[str, str]:
    """name=path arguments; a bare path is the table `input`."""
    return {(name if path else "input"): located(path or name) for name, _, path in (p.partition("=") for p in pairs)}


def located(path: str) -> str:
    """A path with a scheme as it is, others from here."""
    return path if "://" in path else os.path.abspath(path)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    parser = argparse.ArgumentParser(prog="tarn")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("query", "explain", "write"):
        p = sub.add_parser(name)
        p.add_argument("sql")
        p.add_argument("--table", action="append", default=[], help="name=path")
        p.add_argument("--param", action="append", default=[], help="JSON value of $1, $2, …")
        if name == "query":
            p.add_argument("--format", choices=("json", "ndjson", "csv"), default="json")
        if name == "write":
            p.add_argument("--output", required=True)
            p.add_argument("--partition-by", default="")
            p.add_argument("--manifest")
    for name in ("inspect", "schema"):
        sub.add_parser(name).add_argument("path")
    p = sub.add_parser("compact")
    p.add_argument("--path", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--max-rows-per-file", type=int, default=1_000_000)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    try:
        return run(args, spark, out)
    except EngineError as e:
        print(str(e), file=sys.stderr)
        return 1


def run(args, spark: SparkSession, out) -> int:
    lake = Lake(spark)
    if args.command in ("query", "explain", "write"):
        text = args.sql
        tables = table_arguments(args.table)
        if " from " not in f" {text.lower()} " and "input" in tables:
            text += " FROM input"
        if args.command == "explain":
            from tarn.sql.run import spec_of

            spec = spec_of(text, tuple(map(json.loads, args.param)))
            found = lake.path(tables[spec.source])
            found.spec = spec.with_(source=tables[spec.source])
            print(json.dumps(found.explain(), indent=2), file=out)
            return 0
        df = lake.sql(text, tuple(map(json.loads, args.param)), tables)
        if args.command == "query":
            for part in {"json": sinks.json_array, "ndjson": sinks.ndjson, "csv": sinks.csv}[args.format](df):
                out.write(part)
            if args.format == "json":
                out.write("\n")
            return 0
        made = sinks.create_table_as(df, located(args.output), partition_by=[c for c in args.partition_by.split(",") if c])
        if args.manifest:
            sinks.write_manifest(made["manifest"], args.manifest)
        print(json.dumps({"rows": made["rows"], "files": len(made["files"])}), file=out)
    elif args.command == "inspect":
        for f in files.list_files(spark, located(args.path)):
            print(json.dumps({"path": f.path, "bytes": f.size, **explain.row_groups(f.path, None)}), file=out)
    elif args.command == "schema":
        df = files.read_parquet(spark, files.list_files(spark, located(args.path)), ordinal=False)
        print(json.dumps({f.name: f.dataType.simpleString() for f in df.schema.fields}), file=out)
    else:
        sinks.compact(spark, located(args.path), located(args.output), args.max_rows_per_file)
    return 0


if __name__ == "__main__":
    sys.exit(main())
