"""Semantics of expressions, operators and errors on tiny tables."""

import dataclasses
import datetime
import hashlib
import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn import expr as x
from tarn import sinks
from tarn.errors import EngineError
from tarn.lake import Lake
from tarn.operators.joins import join, lookup_join
from tarn.plans import jsonapi, resume, tasks
from tarn.plans.explain import classify, may_match
from tarn.plans.spec import Aggregate, Budget, Order, Policy, QuerySpec, fingerprint
from tarn.sources import avro, files, iceberg, memory, sidecar, text
from tarn.sql.format import format_sql
from tarn.sql.parser import parse


def code(f, *args, **more):
    with pytest.raises(EngineError) as e:
        f(*args, **more)
    return e.value.code.removeprefix("TARN_")


@pytest.fixture(scope="module")
def lake(spark):
    rows = [(1, 2.5, "abc", True, None), (2, 0.0, "a\nc", False, "x"), (3, -2.5, None, None, "x"), (4, None, " Abc ", True, "y")]
    df = spark.createDataFrame(rows, "id int, d double, s string, b boolean, g string").withColumn("raw", F.encode("s", "utf-8"))
    return Lake(spark, tables={"t": df})


def value(lake, e, row=1):
    return lake.table("t").project(v=e).where(x.eq(x.col("id"), row)).first()["v"]


def test_three_valued_logic(lake):
    null, t, f = x.eq(x.col("g"), "zz"), x.lit(True), x.lit(False)
    assert value(lake, x.and_(null, f)) is False and value(lake, x.or_(null, t)) is True
    assert value(lake, x.and_(null, t)) is None and value(lake, x.not_(null)) is None
    assert value(lake, x.is_in(x.col("id"), [1, None])) is True and value(lake, x.not_in(x.col("id"), [2, None])) is None
    assert value(lake, x.is_null(x.col("g"))) is True and value(lake, x.between(x.col("id"), 0, 1)) is True


def test_arithmetic_is_floating(lake):
    assert value(lake, x.div(7, 2)) == 3.5 and value(lake, x.div(1, 0)) == math.inf and value(lake, x.div(-1, 0)) == -math.inf
    assert math.isnan(value(lake, x.div(0, 0))) and math.isnan(value(lake, x.mod(5, 0)))
    assert value(lake, x.mod(-7, 3)) == -1 and value(lake, x.add(x.col("d"), None), 4) is None


def test_types_do_not_mix(lake):
    for e in (x.eq(x.col("id"), "1"), x.add(x.col("s"), 1), x.not_(x.col("id")), x.like(x.col("id"), "1%"), x.fn("lower", x.col("id")), x.case((x.col("b"), 1), otherwise="a"), x.eq(x.col("raw"), b"abc")):
        assert code(value, lake, e) == "TYPE_ERROR"
    assert code(value, lake, x.col("no")) == "UNKNOWN_COLUMN"
    assert code(value, lake, x.fn("nope", 1)) == "UNSUPPORTED_PUSHDOWN"
    assert value(lake, x.lt(x.lit(datetime.datetime(2024, 1, 1)), "2024-01-02T00:00:00Z")) is True


def test_like_has_no_escape_and_stops_at_line_ends(lake):
    assert value(lake, x.like(x.col("s"), "a%c")) is True and value(lake, x.like(x.col("s"), "a%c"), 2) is False
    assert value(lake, x.like(x.lit("a_b"), "a\\_b")) is False and value(lake, x.ilike(x.lit("ABC"), "a_c")) is True
    assert value(lake, x.like(x.lit("a.c\n"), "a.c")) is False


def test_scalar_functions(lake):
    f = x.fn
    for e, want in (
        (f("trim", x.lit(" \t a b﻿")), "a b"),
        (f("substr", "hello", 1, 3), "ell"), (f("substr", "hello", -3, 2), "ll"), (f("substr", "hello", 3, 99), "lo"), (f("substr", "hello", 9, 2), ""),
        (f("replace", "a.b.c", ".", "-"), "a-b-c"),
        (f("regexp_replace", "aXbXc", "X", "-"), "a-bXc"), (f("regexp_replace", "aXbXc", "x", "-", "gi"), "a-b-c"), (f("regexp_replace", "ab12", "([a-z])([0-9])", "\\2\\1"), "a1b2"),
        (f("regexp_replace", "foo bar", "\\bbar$", "$1"), "foo $1"), (f("regexp_matches", "a.c", "a.c", "l"), True), (f("regexp_matches", "abc", "a.c", "l"), False),
        (f("nullif", 1, 1), None), (f("least", 3, 1, 2), 1), (f("greatest", 3, None), None), (f("coalesce", None, 5), 5),
        (f("cast", 1.0, "string"), "1"), (f("cast", 1.5, "string"), "1.5"), (f("cast", "", "number"), 0.0), (f("cast", "zz", "number"), None), (f("cast", "false", "boolean"), True), (f("cast", 0, "boolean"), False),
        (f("round", -2.5), -2.0), (f("round", 2.5), 3.0), (f("round", 1.25, 1), 1.3), (f("floor", -1.5), -2.0), (f("ceil", 1.2), 2.0), (f("abs", -3), 3.0),
        (f("year", "2024-05-06T07:08:09Z"), 2024), (f("hour", 3_600_000), 1), (f("date_trunc", "hour", "2024-05-06T07:08:09.123Z"), "2024-05-06T07:00:00.000Z"),
        (f("h3_parent", "8829a1d757fffff", 7), "8729a1d75ffffff"), (f("h3_in", "aa", '["aa","bb"]'), True), (f("h3_within", "aa", "aa", 0), True),
    ):
        assert value(lake, e) == want, e
    assert code(value, lake, f("h3_cell", 1.0, 2.0, 5)) == "GEO_BACKEND_MISSING"
    assert code(value, lake, f("cast", 1, "blob")) == code(value, lake, f("date_trunc", "week", "2024-01-01")) == "TYPE_ERROR"


def test_geometry(lake):
    import struct

    square = '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[1,3],[3,3],[3,1],[1,1]]]}'
    edge, hole, inside = ('{"type":"Point","coordinates":[%s]}' % c for c in ("0,2", "2,2", "0.5,0.5"))
    f = x.fn
    assert value(lake, f("st_intersects", square, edge)) is True and value(lake, f("st_contains", square, edge)) is False
    assert value(lake, f("st_intersects", square, hole)) is False and value(lake, f("st_contains", square, inside)) is True
    assert value(lake, f("st_within", inside, square)) is True and value(lake, f("st_disjoint", square, "POINT(9 9)")) is True
    line = '{"type":"LineString","coordinates":[[5,0],[5,9]]}'
    assert value(lake, f("st_dwithin", square, line, 1)) is True and value(lake, f("st_dwithin", square, line, 0.9)) is False
    assert value(lake, f("st_distance", square, line)) == 1.0 and value(lake, f("st_length", line)) == 9.0
    triangles = '{"type":"Polygon","coordinates":[[[0,0],[4,0],[0,4],[0,0]]]}', '{"type":"Polygon","coordinates":[[[4,4],[4,3],[3,4],[4,4]]]}'
    assert value(lake, f("st_intersects", *triangles)) is False  # boxes overlap, shapes do not
    for order, mark in (("<", 1), (">", 0)):
        ewkb = struct.pack(f"{order}BIIddd", mark, 0x20000000 | 0x80000000 | 1, 4326, 2.0, 3.0, 9.0)
        assert value(lake, f("st_y", x.lit(ewkb))) == 3.0
    assert value(lake, f("st_x", x.lit(None))) is None


def test_aggregates_of_nothing_nulls_and_ties(spark, lake):
    grouped = lake.table("t").group_by("g").aggregate({"n": "count", "s": ("sum", "d"), "m": ("median", "s"), "v": ("var_samp", "d")}, order_by=(Order("g"),))
    assert [tuple(r) for r in grouped.collect()] == [("x", 2, -2.5, "a\nc", 3.125), ("y", 1, 0.0, " Abc ", None), (None, 1, 2.5, "abc", None)]
    none = lake.table("t").where(x.gt(x.col("id"), 99)).group_by()
    assert none.aggregate({"n": "count", "s": ("sum", "d")}).count() == 0
    assert lake.table("t").group_by().aggregate({"q": ("quantile", "d", 0.25)}).first()["q"] == -1.25
    assert code(lake.table("t").group_by("g").aggregate, {"n": "count"}, max_groups=2) == "GROUP_LIMIT_EXCEEDED"
    for bad in ({"a": ("sum", "s")}, {"a": ("quantile", "d", 2)}, {"a": ("max", "raw")}):
        assert code(lake.table("t").group_by("g").aggregate, bad) == "TYPE_ERROR"
    assert code(lake.table("t").group_by().aggregate, {"a": Aggregate("nope", "d")}) == "VALIDATION_ERROR"


def test_order_dependent_aggregates_follow_the_files(spark, tmp_path):
    path = str(tmp_path / "o")
    spark.createDataFrame([("a", 5), ("a", None), ("a", 7), ("a", 5), ("a", 7), ("b", None)], "k string, v int").coalesce(1).write.parquet(path)
    got = Lake(spark).path(path).group_by("k").aggregate({"f": ("first", "v"), "l": ("last", "v"), "m": ("mode", "v"), "c": ("count", "v")}, order_by=("k",)).collect()
    assert [tuple(r) for r in got] == [("a", 5, 7, 5, 4), ("b", None, None, None, 0)]
    total = Lake(spark).path(path).group_by().aggregate({"m": ("mode", "v"), "n": "count"}).first()
    assert tuple(total) == (5, 6)


def test_order_distinct_and_slices(lake):
    ids = lambda q: [r["id"] for r in q.collect()]
    q = lake.table("t").select("id")
    assert ids(q.order_by("d")) == [3, 2, 1, 4] and ids(q.order_by("-d")) == [4, 1, 2, 3]
    assert ids(q.order_by(Order("d", True, False)).offset(1).limit(2)) == [2, 3]
    assert [r["g"] for r in lake.table("t").select("g").distinct().order_by("-id").collect()] == ["y", "x", None]
    assert code(lake.table("t").order_by("raw").frame) == "TYPE_ERROR" and code(q.limit, -1) == "TYPE_ERROR"
    assert lake.table("t").distinct().select("g").count() == 3 and q.where(x.eq(x.col("id"), 9)).first() is None


def test_joins_match_nulls_and_rename(spark):
    a = spark.createDataFrame([(1, "p"), (None, "q"), (3, "r")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(join(a, b, ["k"])) == [(1, "p", "x"), (1, "p", "y"), (None, "q", "z")]
    assert join(a, b, ["k"]).columns == ["k", "v", "right.v"]
    assert rows(join(a, b, ["k"], how="left", max_right_rows=10))[1:] == [(1, "p", "y"), (3, "r", None), (None, "q", "z")]
    assert rows(join(a, b, ["k"], how="semi")) == [(1, "p"), (None, "q")] and rows(join(a, b, ["k"], how="anti")) == [(3, "r")]
    assert code(join, a, b, ["k"], max_right_rows=2) == "BUDGET_EXCEEDED" and code(join, a, b, ["zz"]) == "UNKNOWN_COLUMN"
    found = lookup_join(a, lambda keys: [{"k": k, "n": 10 * k} for (k,) in keys if k], ["k"], schema="k int, n int", how="left")
    assert rows(found) == [(1, "p", 10), (3, "r", 30), (None, "q", None)]


REFUSED = """INSERT INTO t VALUES (1)|SELECT id FROM t; SELECT id FROM t|WITH a AS (SELECT id FROM t), b AS (SELECT id FROM a) SELECT id FROM b|WITH a AS (SELECT t.id FROM t JOIN u ON t.id = u.id) SELECT id FROM a|
WITH a AS (SELECT id FROM t) SELECT id FROM t|SELECT id FROM (SELECT id FROM t)|SELECT 1 AS a|SELECT t.id FROM t JOIN t u ON t.id = u.id JOIN t w ON t.id = w.id|SELECT t.id FROM t RIGHT JOIN u ON t.id = u.id|
SELECT t.id FROM t CROSS JOIN u|SELECT t.id FROM t JOIN u ON t.id > u.id|SELECT t.id FROM t JOIN u ON id = u.id|SELECT t.id FROM t JOIN u ON t.id = t.id|SELECT DISTINCT ON (id) id FROM t|SELECT id + 1 FROM t|SELECT * AS a FROM t|
SELECT sum(d) OVER () AS a FROM t|SELECT CASE id WHEN 1 THEN 2 END AS a FROM t|SELECT id FROM t WHERE id IN (SELECT id FROM t GROUP BY id)|SELECT id FROM t WHERE id IN (SELECT id FROM t) OR id = 1|
SELECT id FROM t WHERE id IN (SELECT id FROM t) AND id IN (SELECT id FROM t)|SELECT id FROM t WHERE (id, d) IN (SELECT id FROM t)|SELECT id FROM t WHERE id = (SELECT id, d FROM t LIMIT 1)|SELECT id FROM t WHERE id = (SELECT id FROM t)|
SELECT id FROM t GROUP BY id + 1|SELECT id FROM t ORDER BY 1|SELECT sum(DISTINCT id) AS a FROM t|SELECT count(DISTINCT *) AS a FROM t|SELECT id FROM t WHERE s LIKE g|SELECT id ^ 2 AS a FROM t|SELECT +id AS a FROM t|SELECT id FROM t WHERE id = $1|
SELECT count(*) AS n FROM t WHERE id IN (SELECT id FROM t)|SELECT d, count(*) AS n FROM t GROUP BY g|SELECT id FROM t UNION SELECT id FROM t|SELECT id FROM t, u|SELECT id::text AS a FROM t|SELECT sum(d) FILTER (WHERE id > 1) AS a FROM t"""


@pytest.mark.parametrize("text", [t.strip() for t in REFUSED.replace("\n", "").split("|")])
def test_sql_refuses(lake, text):
    assert code(lake.sql, text) == "SQL_UNSUPPORTED"


def test_sql_errors_of_other_kinds(lake):
    assert code(lake.sql, "SELECT id FROM t LIMIT -1") == code(lake.sql, "SELECT quantile(d, 2) AS q FROM t") == code(lake.sql, "SELECT id FROM t LIMIT $1", (1.5,)) == "TYPE_ERROR"
    for bad in ("SELECT id FROM", "SELEC id", "SELECT id FROM t WHERE (id = 1", "SELECT 'a FROM t", "SELECT id FROM t WHERE " + "(" * 200 + "id" + ")" * 200, "SELECT id FROM t --" + "x" * 130_000):
        assert code(lake.sql, bad) == "PARSE_ERROR"
    assert code(lake.sql, "SELECT id FROM nowhere") == "UNKNOWN_TABLE" and code(lake.sql, "SELECT nope FROM t") == "UNKNOWN_COLUMN"


def test_sql_subqueries_and_describe(lake):
    got = lambda q, *p: [tuple(r) for r in lake.sql(q, p).collect()]
    assert got("SELECT id FROM t WHERE d = (SELECT max(d) FROM t)") == [(1,)]
    assert got("SELECT id, (SELECT d FROM t WHERE id = 99 LIMIT 1) AS n FROM t WHERE id = 1") == [(1, None)]
    assert got("SELECT id FROM t WHERE g NOT IN (SELECT g FROM t WHERE id = 2) ORDER BY id") == [(1,), (4,)]
    assert got("WITH c AS (SELECT g, count(*) AS n FROM t GROUP BY g) SELECT g FROM c WHERE n = $1", 2) == [("x",)]
    assert got("SELECT g, sum(d) / count(*) AS a FROM t GROUP BY g HAVING count(*) > 1") == [("x", -1.25)]
    assert ("id", "int", True) in got("DESCRIBE t")


@pytest.mark.parametrize("text", ["SELECT id, d * -(2 + id) AS a FROM t WHERE NOT (s LIKE 'a''%' OR id IN (1, NULL)) AND b IS NOT NULL ORDER BY id DESC NULLS LAST LIMIT 3 OFFSET 1", "WITH c AS (SELECT g, count(*) AS n FROM t GROUP BY g) SELECT n FROM c", "SELECT a.id FROM t AS a LEFT JOIN u AS b ON a.id = b.id WHERE a.id = (SELECT max(id) AS m FROM t)", 'SELECT DISTINCT "odd name" FROM t WHERE (id, g) NOT IN (SELECT id, g FROM u)', "SELECT count(DISTINCT s) AS c, quantile(d, 0.5) AS q, CASE WHEN b THEN 1 ELSE 2.5 END AS k FROM t GROUP BY b HAVING c > 1", "DESCRIBE t", "SELECT id FROM t JOIN u USING (id)"])
def test_formatting_round_trips(text):
    tree = parse(text)
    assert parse(format_sql(tree)) == tree


def test_json_queries():
    spec = jsonapi.parse({"version": 1, "from": "p", "where": {"not": {"between": ["a", 1, 2]}}, "orderBy": [{"column": "a", "nulls": "last"}], "limit": 3})
    assert spec.where == x.not_(x.between(x.col("a"), 1, 2)) and spec.order_by == (Order("a", False, False),)
    for bad in ({}, {"version": 2, "from": "p"}, {"version": 1, "from": "p", "where": {"eq": ["a", 1], "ne": ["a", 2]}}, {"version": 1, "from": "p", "project": {}}, {"version": 1, "from": "p", "where": {"and": [{"eq": ["a", 1]}]}}, {"version": 1, "from": "p", "where": {"matches": ["a", "b"]}}):
        assert code(jsonapi.parse, bad) == "PARSE_ERROR"


scalars = st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.text(max_size=3))
trees = st.recursive(st.one_of(scalars.map(x.lit), st.sampled_from("abc").map(x.col)), lambda e: st.one_of(st.tuples(e, e).map(lambda p: x.eq(*p)), st.lists(e, min_size=2, max_size=3).map(lambda p: x.Logical("and", tuple(p))), e.map(x.not_), st.tuples(e, st.lists(e, max_size=2)).map(lambda p: x.is_in(*p)), st.lists(st.tuples(e, e), min_size=1, max_size=2).map(lambda w: x.Case(tuple(w), None))), max_leaves=8)


@settings(max_examples=60, deadline=None)
@given(trees)
def test_expressions_survive_json(e):
    assert x.from_json(json.loads(json.dumps(e.to_json()))) == e


def test_bounds_prune_soundly():
    bounds = {"a": (3, 7)}
    for op, make in (("<", x.lt), ("<=", x.lte), (">", x.gt), (">=", x.gte), ("=", x.eq), ("!=", x.ne)):
        for v in range(0, 11):
            real = any(eval(f"{n} {op.replace('=', '==') if op == '=' else op} {v}") for n in range(3, 8))
            assert may_match(make(x.col("a"), v), bounds) == real
    assert may_match(x.not_(x.eq(x.col("a"), 1)), bounds) and not may_match(x.is_in(x.col("a"), [1, 9]), bounds) and may_match(x.eq(x.col("zz"), 1), bounds)
    classes = classify(x.and_(x.eq(x.col("p"), 1), x.gt(x.col("a"), 2), x.like(x.col("s"), "a%")), {"p"})
    assert [len(classes[k]) for k in ("partition", "row_group_stats", "residual")] == [1, 1, 1]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("parts"))
    spark.range(100).withColumn("k", F.col("id") % 7).repartitionByRange(5, "id").write.mode("overwrite").parquet(root)
    return root


def test_slices_join_to_the_whole(spark, parts):
    q = Lake(spark).path(parts).select("id").where(x.ne(x.col("k"), 3)).limit(60).offset(4)
    whole = q.collect()
    assert len(whole) == 60
    for every in (7, 60, 100):
        assert [r for rows, _ in q.resumable_batches(every) for r in rows] == whole
    _, mark = q.run_slice(10)
    assert Lake(spark).resume(mark).run_slice(10, mark)[0] == whole[10:20]
    token = resume.sign(resume.Bookmark.from_json(mark), b"k")
    assert resume.verify(token, b"k").row_offset == 10
    assert code(resume.verify, token, b"other") == code(resume.verify, "x", b"k") == code(q.run_slice, 5, {"version": 1}) == "BOOKMARK_INVALID"
    stale = json.loads(json.dumps(mark)) | {"plan": "0" * 16}
    assert code(q.run_slice, 5, stale) == "BOOKMARK_STALE"


def test_budgets_and_policy(spark, parts):
    for budget, n in ((Budget(max_files=2), None), (Budget(max_bytes=10), None), (Budget(max_output_rows=9), None), (Budget(max_rows_decoded=50), None)):
        assert code(Lake(spark, budget).path(parts).frame) == "BUDGET_EXCEEDED"
    assert len(Lake(spark, Budget(max_rows_decoded=50)).path(parts).where(x.lt(x.col("id"), 10)).collect()) == 10
    lake = Lake(spark, policy=Policy(("id",), 5, x.gt(x.col("k"), 3)))
    assert lake.path(parts).count() == 5 and lake.path(parts).frame().columns == ["id"]
    assert code(lake.path(parts).select("k").frame) == "VALIDATION_ERROR"
    assert lake.sql("SELECT id FROM p WHERE id < 5", (), {"p": parts}).count() == 1


def test_work_units_and_checkpoints(spark, parts):
    q = Lake(spark).path(parts).where(x.lt(x.col("id"), 45))
    manifest = q.task_manifest("j")
    assert manifest == q.task_manifest("j") and manifest["tasks"][0]["id"].startswith("j-task-000000-")
    units = [u for t in q.plan_tasks() for u in tasks.split(t, max_rows=8)]
    units = [tasks.Task.from_json(tasks.json_boundary(u.to_json())) for u in units]
    total = tasks.fan_in(units, lambda u: tasks.scan(spark, u).count(), lambda a, b: a + b, 0)
    assert total == 45
    store = tasks.CheckpointStore()
    for state in tasks.STATES:
        store.advance(tasks.Checkpoint("t", state, "k"))
    assert code(store.advance, tasks.Checkpoint("t", "running", "k")) == code(store.advance, tasks.Checkpoint("u", "running", "k")) == "VALIDATION_ERROR"
    store.advance(tasks.Checkpoint("s", "planned", "a"))
    store.advance(tasks.Checkpoint("s", "running", "a", 100))
    assert store.advance(tasks.Checkpoint("s", "running", "b", 500), stale_after_ms=300).idempotency_key == "b"
    assert fingerprint({"b": 1, "a": 2}) == fingerprint({"a": 2, "b": 1})


def test_globs_and_hive(spark, tmp_path):
    root = str(tmp_path / "h")
    spark.createDataFrame([(1, "007", "a b"), (2, "007", "c/d"), (3, "x", "a b")], "id int, p string, q string").write.partitionBy("p", "q").parquet(root)
    got = Lake(spark).hive(f"{root}/*.parquet").where(x.eq(x.col("p"), "007")).select("id", "p", "q").order_by("id")
    assert [tuple(r.values()) for r in got.collect()] == [(1, "007", "a b"), (2, "007", "c/d")]
    assert got.explain()["files_skipped"] == 1
    assert code(Lake(spark).path(f"{root}/none*").frame) == "OBJECT_NOT_FOUND"
    nested = str(tmp_path / "n")
    spark.range(1).select(F.struct(F.lit(1).alias("a")).alias("s"), F.col("id"), F.lit(1).cast("decimal(20,2)").alias("w")).write.parquet(nested)
    assert code(Lake(spark).path(nested).frame) == "UNSUPPORTED_PARQUET_FEATURE" and Lake(spark).path(nested).select("id").count() == 1
    assert Lake(spark, strict_types=False).path(nested).count() == 1


def test_sidecars_prune(spark, parts):
    paths = [f.path for f in files.list_files(spark, parts)]
    index = sidecar.build(spark, paths, ["id"], cells=["k"])
    assert len(index.prune(paths, x.eq(x.col("id"), 50))) == 1 and len(index.prune(paths, x.eq(x.col("k"), 3))) == len(paths)
    lake = Lake(spark)
    lake.use_sidecar(parts, index)
    q = lake.path(parts).where(x.lt(x.col("id"), 5))
    assert q.count() == 5 and q.stats()["files_planned"] == 1


def test_csv_and_json(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id;name;ok\n1;"a;""b""\nc";true\n2;;false\n')
    got = text.read_csv(spark, str(p))
    assert got.dtypes == [("id", "double"), ("name", "string"), ("ok", "boolean")]
    assert [tuple(r) for r in got.collect()] == [(1.0, 'a;"b"\nc', True), (2.0, None, False)]
    p.write_text("a,b\n1,2\n3\n")
    assert code(text.read_csv, spark, str(p)) == "VALIDATION_ERROR"
    p.write_text("x y,z\nq,w\n")
    assert text.read_csv(spark, str(p)).columns == ["column1", "column2"]
    j = tmp_path / "a.json"
    j.write_text('[{"a":1,"b":[1,2]},{"a":null}]')
    assert [r["a"] for r in text.read_json(spark, str(j)).collect()] == [1, None]
    j.write_text('{"a":1}\n\n{"a":2}\n')
    assert text.read_json(spark, str(j)).count() == 2
    j.write_text('{"a":1}\n5\n')
    assert code(text.read_json, spark, str(j)) == "VALIDATION_ERROR"


def test_sinks(spark, tmp_path):
    import pyarrow as pa

    df = spark.createDataFrame([(1, 'a,"b"', 2**60, datetime.datetime(2024, 1, 2, 3, 4, 5)), (2, None, 5, None)], "i int, s string, w long, t timestamp")
    assert "".join(sinks.csv(df)) == 'i,s,w,t\n1,"a,""b""",1152921504606846976,2024-01-02T03:04:05.000Z\n2,,5,\n'
    assert json.loads("".join(sinks.json_array(df)))[0]["w"] == str(2**60) and "".join(sinks.json_array(df.limit(0))) == "[]"
    assert len(list(sinks.ndjson(df))) == 2 and pa.ipc.open_stream(sinks.arrow_ipc(df)).read_all().num_rows == 2
    root = str(tmp_path / "w")
    made = sinks.write_partitioned(df.drop("t"), root, ["s"], job_id="j", idempotency_key="k")
    assert [f["partition"]["s"] for f in made] == ["__null__", 'a,"b"'] and made[1]["path"].endswith("s=a%2C%22b%22/part-j-k-00000.parquet")
    with open(made[0]["path"], "rb") as f:
        assert "sha256:" + hashlib.sha256(f.read()).hexdigest() == made[0]["sha256"]
    for v in (sinks.Validation(required=("s",)), sinks.Validation(ranges={"i": (2, None)}), sinks.Validation(enums={"i": [1]}), sinks.Validation(unique=(("s",),))):
        twice = df.union(df)
        assert code(v.check, twice) == "VALIDATION_ERROR"
    store = tasks.CheckpointStore()
    once = sinks.write_task(store, df.drop("t"), str(tmp_path / "t"), "t1", "k1")
    assert sinks.write_task(store, df.drop("t"), str(tmp_path / "t"), "t1", "k1") == once and tasks.output_manifest("j", once)["rows"] == 2
    assert tasks.manifest_from_checkpoints("j", store)["files"] == once
    assert code(sinks.write_partitioned, df.limit(0), root) == "VALIDATION_ERROR"


def test_in_memory_tables(spark):
    import pyarrow as pa

    lake = memory.in_memory_lake(spark, {"t": [{"a": 1, "b": "x"}, {"a": None}]})
    assert lake.table("t").where(x.is_null(x.col("b"))).count() == 1 and code(lake.table, "u") == "UNKNOWN_TABLE"
    assert code(memory.from_rows, spark, [{"a": 1}, {"a": 2}], None, 1) == "BUDGET_EXCEEDED" and code(memory.from_rows, spark, [{"a": 1}, {"a": "x"}]) == "VALIDATION_ERROR"
    assert memory.from_arrow(spark, pa.table({"z": [1, 2]})).count() == 2


def long(n):
    n, out = (n << 1) ^ (n >> 63), b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def test_avro():
    import zlib

    schema = {"type": "record", "name": "r", "fields": [{"name": "n", "type": "long"}, {"name": "s", "type": ["null", "string"]}, {"name": "m", "type": {"type": "map", "values": "int"}}, {"name": "a", "type": {"type": "array", "items": "boolean"}}]}
    row = long(-3) + long(1) + long(2) + b"hi" + long(1) + long(1) + b"k" + long(7) + long(0) + long(2) + b"\x01\x00" + long(0)
    pack = zlib.compressobj(9, zlib.DEFLATED, -15)
    block = pack.compress(row) + pack.flush()
    head = json.dumps(schema).encode()
    meta = long(2) + long(11) + b"avro.schema" + long(len(head)) + head + long(10) + b"avro.codec" + long(7) + b"deflate" + long(0)
    data = b"Obj\x01" + meta + b"s" * 16 + long(1) + long(len(block)) + block + b"s" * 16
    assert avro.records(data) == [{"n": -3, "s": "hi", "m": {"k": 7}, "a": [True, False]}]
    assert code(avro.records, data[:-3]) == code(avro.records, b"nope") == "CATALOG_ERROR"


def test_iceberg_refusals_and_commits(spark, sf):
    from tarn.surfaces import make_table

    root = make_table(spark, f"{sf}/nation.parquet")
    table = iceberg.load_location(spark, root)
    assert code(table.snapshot, 77) == code(table.snapshot, ref="no") == code(table.resolve, "wh/nations/../x") == code(table.resolve, "/etc/passwd") == "CATALOG_ERROR"
    plan = table.plan(x.eq(x.col("region"), "1"))
    assert len(plan.files) == 1 and plan.skipped == 2 and len(table.plan(mode="ignore-deletes").deletes) == 0
    assert table.read(mode="ignore-deletes").count() == 15
    entry = [{"path": f"{root}/data/x.parquet", "rows": 1, "bytes": 1, "partition": {}}]
    table.append(entry)
    assert code(table.append, entry) == "ICEBERG_COMMIT_CONFLICT" and code(iceberg.load_catalog, "glue") == "CATALOG_ERROR"
    good = dict(table.metadata)
    for change in ({"format-version": 3}, {"sort-orders": [{"fields": [1]}]}, {"partition-specs": [{"fields": [{"transform": "bucket[4]"}]}]}):
        table.metadata = good | change
        assert code(table.validate) == "UNSUPPORTED_ICEBERG_FEATURE"


def test_windowed_stream(spark, tmp_path):
    from tarn.streaming import queries as stream

    rows = [(datetime.datetime(2024, 1, 1, 0, m), m % 2, float(m)) for m in range(60)]
    spark.createDataFrame(rows, "ts timestamp, k int, v double").write.parquet(str(tmp_path / "in"))
    source = stream.read_stream(spark, str(tmp_path / "in"), "ts timestamp, k int, v double")
    made = stream.windowed(source, "ts", "30 minutes", "1 hour", ["k"], {"n": Aggregate("count"), "s": Aggregate("sum", "v")})
    made.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["window_start"].minute, r["k"], r["n"], r["s"]) for r in spark.table("windows").collect()) == [(0, 0, 15, 210.0), (0, 1, 15, 225.0), (30, 0, 15, 660.0), (30, 1, 15, 675.0)]
    assert code(stream.apply, source, QuerySpec("", limit=1)) == "SQL_UNSUPPORTED"


class Catalog:
    """A REST catalog of one table, spoken to over HTTP on this machine."""

    def __init__(self, metadata):
        import http.server
        import threading

        catalog = self
        self.metadata, self.asked, self.conflict = metadata, [], False

        class Handler(http.server.BaseHTTPRequestHandler):
            def answer(self, code, body):
                self.send_response(code)
                self.end_headers()
                self.wfile.write(body if isinstance(body, bytes) else json.dumps(body).encode())

            def do_GET(self):
                catalog.asked.append((self.path, self.headers.get("Authorization")))
                if self.path.startswith("/v1/config"):
                    self.answer(200, {"defaults": {"prefix": "no"}, "overrides": {"prefix": "w/1"}})
                elif self.path == "/v1/w/1/namespaces/a%1Fb/tables":
                    self.answer(200, {"identifiers": [{"namespace": ["a", "b"], "name": "one"}], "next-page-token": "p2"})
                elif self.path == "/v1/w/1/namespaces/a%1Fb/tables?pageToken=p2":
                    self.answer(200, {"identifiers": [{"namespace": ["a", "b"], "name": "nations"}]})
                elif self.path.endswith("/nations"):
                    self.answer(200, {"metadata-location": "x/v1.metadata.json", "metadata": catalog.metadata, "config": {}})
                elif self.path.endswith("/broken"):
                    self.answer(200, b"<html>")
                else:
                    self.answer(404, {})

            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                (need,) = body["requirements"]
                if catalog.conflict or need["snapshot-id"] != catalog.metadata["current-snapshot-id"]:
                    return self.answer(409, {})
                new = body["updates"][0]["snapshot"]
                catalog.metadata = catalog.metadata | {"snapshots": [*catalog.metadata["snapshots"], new], "current-snapshot-id": new["snapshot-id"]}
                self.answer(200, {})

            def log_message(self, *args):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.uri = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


def test_rest_catalog(spark, sf):
    from tarn.surfaces import make_table

    root = make_table(spark, f"{sf}/nation.parquet")
    moved = json.loads(json.dumps(iceberg.load_location(spark, root).metadata).replace('"wh/nations', f'"{root}')) | {"current-snapshot-id": 1}
    for kind in ("one", "two", "deletes"):
        text_ = json.dumps(sinks.read_manifest(f"{root}/metadata/{kind}.json")).replace('"wh/nations', f'"{root}')
        sinks.write_manifest(json.loads(text_), f"{root}/metadata/{kind}.json")
    server = Catalog(moved)
    found = iceberg.load_catalog("rest", uri=server.uri, namespace=("a", "b"), warehouse="wh 1", token="t")
    assert found.tables() == ["one", "nations"] and server.asked[0] == ("/v1/config?warehouse=wh+1", "Bearer t")
    table = found.load(spark, "nations")
    assert table.read().count() == 10
    rows = spark.read.parquet(f"{sf}/nation.parquet").where("n_regionkey = 4").withColumn("region", F.col("n_regionkey"))
    made = sinks.write_partitioned(rows, f"{root}/data", ["region"], job_id="rest")
    assert found.append(spark, "nations", made).read(columns=["n_nationkey"]).count() == 15
    server.conflict = True
    assert code(found.append, spark, "nations", made) == "ICEBERG_COMMIT_CONFLICT"
    assert code(found.load, spark, "broken") == code(found.load, spark, "missing") == "CATALOG_ERROR"
    assert code(iceberg.load_catalog, "rest", uri=server.uri, namespace=()) == "VALIDATION_ERROR"
    server.server.shutdown()
    server.server.server_close()
    assert code(found.load, spark, "nations") == "CATALOG_ERROR"


def test_http_store(spark, tmp_path):
    import functools
    import http.server
    import threading

    from tarn.sources.http import HttpStore

    class Quiet(http.server.SimpleHTTPRequestHandler):
        def log_message(self, *args):
            pass

    (tmp_path / "a.txt").write_bytes(bytes(range(100)))
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Quiet, directory=str(tmp_path))) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        url, store = f"http://127.0.0.1:{server.server_port}/a.txt", HttpStore()
        assert store.head(url)[0] == 100 and store.read(url, 10, 5) == bytes(range(10, 15)) and store.read(url, 95, 50) == bytes(range(95, 100))
        path = store.fetch(spark, url)
        with open(path, "rb") as f:
            assert f.read() == bytes(range(100)) and store.fetch(spark, url) == path
        (tmp_path / "a.txt").write_bytes(b"changed")
        assert store.fetch(spark, url) != path
        assert code(store.fetch, spark, url + "x") == "OBJECT_NOT_FOUND" and code(HttpStore(max_bytes=3).fetch, spark, url) == "BUDGET_EXCEEDED"
        server.shutdown()
    assert code(store.head, url) == "PARQUET_READ_ERROR"


def test_budgets_in_time(spark, sf):
    import threading
    import time

    slow = Lake(spark, Budget(max_elapsed_ms=300), tables={"t": spark.range(1 << 40).withColumn("x", F.sin(F.col("id").cast("double")))})
    began = time.monotonic()
    assert code(slow.table("t").where(x.gt(x.col("x"), 2)).collect) == "ABORTED" and time.monotonic() - began < 20
    signal = threading.Event()
    told = Lake(spark, Budget(signal=signal), tables=slow.tables)
    threading.Timer(0.3, signal.set).start()
    assert code(told.table("t").where(x.gt(x.col("x"), 2)).count) == "ABORTED"
    assert code(told.table("t").limit(1).collect) == "ABORTED"  # it is still set
    few = Lake(spark, Budget(max_concurrent_reads=1)).path(f"{sf}/orders.parquet").frame()
    assert few.select("o_orderkey").repartition(2).count() == 1500


def test_runtime_hooks(spark, sf):
    from tarn.runtime import Metrics, Runtime

    seen, marks, ticks = [], [], iter(range(0, 10**9, 5))
    run = Runtime(now=lambda: next(ticks), new_id=lambda p: f"{p}1", metrics=Metrics(lambda *m: seen.append(m)), queue=marks.append)
    lake = Lake(spark, Budget(max_output_rows=20), runtime=run)
    found = lake.path(f"{sf}/region.parquet").order_by("r_regionkey")
    found.collect()
    assert found.last_stats["query_id"] == "q_1" and found.last_stats["rows_returned"] == 5 and run.metrics.times["query.collect"]
    assert code(lake.path(f"{sf}/nation.parquet").collect) == "BUDGET_EXCEEDED" and run.metrics.counts["query.refused"] == 1 and seen[-1][2] == {"code": "TARN_BUDGET_EXCEEDED"}
    _, mark = found.run_slice(2)
    assert marks == [mark]
    with run.lock("a"), run.lock("a"), run.lock("b"):
        pass


def test_listings_are_kept_as_long_as_asked(spark, tmp_path):
    from tarn.runtime import Runtime

    now, root = [0], str(tmp_path / "l")
    spark.range(3).coalesce(1).write.parquet(root)
    kept, fresh = Lake(spark, runtime=Runtime(now=lambda: now[0]), listing_ms=1000), Lake(spark)
    assert kept.path(root).count() == fresh.path(root).count() == 3
    spark.range(4).coalesce(1).write.mode("append").parquet(root)
    assert kept.path(root).count() == 3 and fresh.path(root).count() == 7
    now[0] = 1000
    assert kept.path(root).count() == 7


def test_footers_are_remembered(spark, sf, tmp_path):
    from tarn.plans.explain import FOOTERS, Footers, row_groups

    path = f"{sf}/orders.parquet"
    row_groups(path, None)
    hits, misses = FOOTERS.hits, FOOTERS.misses
    assert row_groups(path, None)["rows"] == 1500 and (FOOTERS.hits, FOOTERS.misses) == (hits + 1, misses)
    held = row_groups(path, None, {"o_orderkey"})["row_groups"]
    assert all(g["chunks"] == 1 and 0 < g["chunk_bytes"] < g["bytes"] for g in held)
    few = Footers(1)
    for p in (path, f"{sf}/region.parquet", path):
        few.of(spark, p)
    assert few.misses == 3 and len(few.held) == 1
    (tmp_path / "no.parquet").write_bytes(b"not a parquet file")
    assert code(few.of, spark, str(tmp_path / "no.parquet")) == "PARQUET_READ_ERROR"


def test_fan_in_is_bounded_and_ordered():
    import threading
    import time

    lock, running, most, taken = threading.Lock(), [0], [0], [0]

    def inputs():
        for i in range(20):
            taken[0] = i + 1
            yield i

    def run(i):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.02 if i % 3 else 0.005)
        with lock:
            running[0] -= 1
        return i

    seen = []

    def reduce(state, i):
        assert taken[0] <= i + 5  # none is taken that could not wait
        seen.append(i)
        return state + [i]

    assert tasks.fan_in(inputs(), run, reduce, [], max_concurrent=3, max_buffered=5) == list(range(20)) and most[0] <= 3
    assert code(tasks.fan_in, [], run, reduce, [], 0) == "VALIDATION_ERROR"
    with pytest.raises(ZeroDivisionError):
        tasks.fan_in(range(5), lambda i: 1 // (i - 2), lambda s, i: s, None)


def test_ranks_with_null_groups_and_values(spark, monkeypatch):
    from tarn.operators import aggregate

    rows = [("a", 1.0, "p"), ("a", 3.0, "q"), ("a", None, "q"), (None, 5.0, None), (None, 5.0, "z"), ("b", None, None)] + [("c", float(i), f"s{i:03d}") for i in range(101)]
    lake = Lake(spark, tables={"t": spark.createDataFrame(rows, "k string, v double, s string").repartition(3)})
    spec = {"m": ("median", "v"), "q": Aggregate("quantile", "v", None, 0.25), "ms": ("median", "s")}
    want = {"a": (2.0, 1.5, "q"), None: (5.0, 5.0, "z"), "b": (None, None, None), "c": (50.0, 25.0, "s050")}
    for most in (aggregate.IN_MEMORY, 0):
        monkeypatch.setattr(aggregate, "IN_MEMORY", most)
        assert {r["k"]: (r["m"], r["q"], r["ms"]) for r in lake.table("t").group_by("k").aggregate(spec).collect()} == want
    out, state = lake.table("t").group_by("k").aggregate_with_state(spec)
    assert {r["k"]: (r["m"], r["q"], r["ms"]) for r in out.collect()} == want
    # The same rows again: medians stay, counts double; an empty unit changes nothing.
    more = spec | {"n": "count", "d": ("count_distinct", "v"), "sd": ("stddev", "v"), "f": ("first", "s"), "l": ("last", "s")}
    state = None
    for name in ("t", "t", "none"):
        own = Lake(spark, tables={"t": lake.tables["t"], "none": lake.tables["t"].limit(0)})
        out, state = own.table(name).group_by("k").aggregate_with_state(more, json.loads(json.dumps(state)))
    got = {r["k"]: r for r in out.collect()}
    assert {k: r["m"] for k, r in got.items()} == {k: v[0] for k, v in want.items()} and got["a"]["q"] == 1.0 and got["c"]["q"] == 25.0
    assert got["c"]["n"] == 202 and got["c"]["d"] == 101 and got["b"]["d"] == 0 and got["b"]["sd"] is None and got[None]["sd"] == 0
    assert abs(got["a"]["sd"] - (4 / 3) ** 0.5) < 1e-12
    assert code(own.table("t").group_by("k").aggregate_with_state, spec, state) == "BOOKMARK_INVALID"
    empty, _ = own.table("none").group_by().aggregate_with_state({"n": "count"})
    assert empty.count() == 0


def test_csv_finds_out_about_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"x\ny"\n2,"z"\n')
    (tmp_path / "b.csv").write_text('k,v\n1,"x, ""y"""\n2,z\n')
    assert [tuple(r) for r in text.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [(1.0, "x\ny"), (2.0, "z")]
    assert [tuple(r) for r in text.read_csv(spark, str(tmp_path / "b.csv")).collect()] == [(1.0, 'x, "y"'), (2.0, "z")]


def test_shapes_known_and_unknown_agree(lake, spark):
    """Points and boxes as Columns, against the exact functions on their texts and bytes."""
    from tarn.functions import geo

    shapes = ['{"type":"Point","coordinates":[1,2]}', "POINT(3 4)", '{"type":"BBox","minx":0,"miny":0,"maxx":3,"maxy":4}', '{"type":"BBox","minx":2,"miny":1,"maxx":2.5,"maxy":9}', '{"type":"LineString","coordinates":[[0,0],[4,4]]}', '{"type":"Polygon","coordinates":[[[0,0],[6,0],[0,6],[0,0]]]}', '{"type":"Point","coordinates":[-0.00012,12345678.9]}']
    table = Lake(spark, tables={"g": spark.createDataFrame([(i, s) for i, s in enumerate(shapes)] + [(99, None)], "i int, s string")})
    for other in shapes:
        b = geo.parse(other)
        for name, of in (("st_intersects", geo.intersects), ("st_disjoint", lambda p, q: not geo.intersects(p, q)), ("st_contains", geo.contains), ("st_within", lambda p, q: geo.contains(q, p)), ("st_distance", geo.box_distance)):
            got = {r["i"]: r["v"] for r in table.table("g").project(i=x.col("i"), v=x.fn(name, x.col("s"), other)).collect()}
            want = {i: of(geo.parse(s), b) for i, s in enumerate(shapes)} | {99: None}
            assert got == want, (name, other)
            literal = lake.table("t").limit(1).project(v=x.fn(name, shapes[0], other)).first()["v"]
            assert literal == of(geo.parse(shapes[0]), b), (name, other)
        near = {r["i"] for r in table.table("g").select("i").where(x.st_dwithin(x.col("s"), other, 1.5)).collect()}
        assert near == {i for i, s in enumerate(shapes) if geo.exact_distance(geo.parse(s), b) <= 1.5}
    assert value(lake, x.st_point(-0.00012, 12345678.9)) == shapes[-1] and value(lake, x.st_x("POINT(3 4)")) == 3
    assert value(lake, x.st_point(1, x.lit(None))) is None and value(lake, x.st_x(x.st_point(1, x.lit(None)))) is None
    with pytest.raises(Exception, match="ordered bounds"):
        value(lake, x.st_bbox(1, 0, 0, 0))
    with pytest.raises(Exception, match="finite"):
        value(lake, x.st_x(x.st_point(x.div(1, 0), 0)))


def test_command_line(spark, sf, tmp_path, capsys):
    import io

    from tarn.cli import main

    out = io.StringIO()
    assert main(["query", "SELECT r_name FROM region WHERE r_regionkey = $1", "--table", f"region={sf}/region.parquet", "--param", "1", "--format", "csv"], spark, out) == 0
    assert out.getvalue().startswith("r_name\n")
    assert main(["query", "SELECT nope", "--table", f"{sf}/region.parquet"], spark, out) == 1
    for args in (["schema", f"{sf}/region.parquet"], ["inspect", f"{sf}/region.parquet"], ["explain", "SELECT r_name FROM region", "--table", f"region={sf}/region.parquet"], ["write", "SELECT * FROM input", "--table", f"{sf}/region.parquet", "--output", str(tmp_path / "o"), "--manifest", str(tmp_path / "m.json")], ["compact", "--path", f"{sf}/region.parquet", "--output", str(tmp_path / "c")]):
        assert main(args, spark, out) == 0
    assert sinks.read_manifest(str(tmp_path / "m.json"))["rows"] == 5


def test_entry_runs(spark):
    import __spark_entry__ as repo

    assert repo.entry(spark).count() > 0
    assert set(repo.oracle_sql()) <= set(repo.queries())


def test_compacted_files_has_as_many_files_as_its_rows_need(spark, tmp_path):
    from tarn import catalogue, surfaces  # noqa: F401

    ten, few = str(tmp_path / "ten"), str(tmp_path / "few")
    spark.range(10).write.parquet(ten)
    assert sinks.compact(spark, ten, few, 4) == 3 == len(files.list_files(spark, few))
    many = spark.range(1_000_001).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type"))
    many.write.parquet(str(tmp_path / "events.parquet"))
    assert catalogue.QUERIES["compacted_files"](spark, str(tmp_path)).agg(F.count("event_id"), F.sum("event_id")).first() == (1_000_001, 500_000_500_000)


def test_in_subquery_has_no_bound_on_its_keys(spark):
    keys = Lake(spark, tables={"t": spark.range(150_001)})
    assert keys.sql("SELECT id FROM t WHERE id IN (SELECT id FROM t WHERE id > 9) AND id < 20").count() == 10


def test_in_subquery_of_pairs_has_no_bound_on_its_keys(spark):
    pairs = Lake(spark, tables={"t": spark.range(150_001).withColumn("k", F.col("id") % 3)})
    assert pairs.sql("SELECT id FROM t WHERE (id, k) IN (SELECT id, k FROM t WHERE id > 9)").count() == 149_991


def test_not_in_subquery_has_no_bound_on_its_keys(spark):
    some = Lake(spark, tables={"t": spark.range(150_001).select(F.when(F.col("id") > 0, F.col("id")).alias("id"))})
    assert some.sql("SELECT id FROM t WHERE id NOT IN (SELECT id FROM t WHERE id > 9)").count() == 10  # the null too


def test_units_of_a_file_are_read_by_one_scan(spark, tmp_path):
    root = str(tmp_path / "t")
    spark.range(100).coalesce(1).write.parquet(root)
    unit = Lake(spark).path(root).where(x.ne(x.col("id"), 50)).plan_tasks()[0]
    of = lambda *ranges: dataclasses.replace(unit, ranges=ranges)
    held = lambda units: sorted(r["id"] for r in tasks.scan_units(spark, units).collect())
    units = tasks.split(unit, max_rows=3)
    assert len(units) == 34 and tasks.together(units) == [of((0, 100))]
    assert held(units) == [i for i in range(100) if i != 50]
    assert tasks.scan_units(spark, units)._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    # Gaps stay; what overlaps or goes back counts as often as units hold it.
    gaps = [of((2 * i, 2 * i + 1)) for i in range(30)]
    assert len(tasks.together(gaps)) == 1 and held(gaps) == list(range(0, 50, 2)) + [52, 54, 56, 58]
    assert held([of((0, 3)), of((2, 4)), of((1, 2), (0, 1), (0, 2))]) == [0, 0, 1, 1, 2, 2, 3]
    # In several files and without a range.
    spark.range(100, 110).repartition(3).write.mode("append").parquet(root)
    whole = Lake(spark).path(root).plan_tasks()
    assert held(whole) == list(range(110)) == held([u for t in whole for u in tasks.split(t, max_rows=7)])
    assert code(tasks.scan_units, spark, []) == "VALIDATION_ERROR"


def test_an_offset_without_a_limit_is_sorted_by_all_tasks(spark, tmp_path, monkeypatch):
    from tarn.operators import rows as row_ops

    values = [None, 2.0, math.nan, -1.0, math.inf, 2.0, None, 0.5, math.nan, -1.0]
    made = [(i, v, None if i % 4 == 1 else "ab"[i % 2]) for i, v in enumerate(values * 5)]
    root = str(tmp_path / "t")
    spark.createDataFrame(made, "id int, d double, s string").repartition(3).write.parquet(root)
    orders = ((), (Order("s", True, False), Order("d", False, True)), (Order("d", True), Order("s")), (Order("s", False, True), Order("id", True)))
    for skipped in (100_000, 0):  # by the first row left, and written
        monkeypatch.setattr(row_ops, "SKIPPED", skipped)
        for order in orders:
            q = Lake(spark).path(root).order_by(*order)
            ids = [r["id"] for r in q.limit(50).collect()]
            for n in (1, 17, 49, 50, 90):
                assert [r["id"] for r in q.offset(n).collect()] == ids[n:], (order, n)
        q = Lake(spark).path(root).select("d", "s").distinct().order_by("d", "-s")
        assert list(map(repr, q.offset(3).collect())) == list(map(repr, q.limit(100).collect()[3:]))
    plan = Lake(spark).path(root).order_by("d").offset(7).frame()._jdf.queryExecution().executedPlan().toString()
    assert "GlobalLimit" not in plan and "CollectLimit" not in plan
    # A table without places; groups; equal rows behind a state.
    named = Lake(spark, tables={"t": spark.range(40).select((F.col("id") % 4).alias("k"))})
    assert [r["k"] for r in named.table("t").order_by("k").offset(15).collect()] == [1] * 5 + [2] * 10 + [3] * 10
    assert named.table("t").offset(15).count() == 25 and named.table("t").limit(3).count() == 3 and named.table("t").distinct().limit(3).count() == 3
    assert [r["k"] for r in named.table("t").group_by("k").aggregate({"n": "count"}, order_by=("-k",), offset=1).collect()] == [2, 1, 0]
    monkeypatch.setattr(row_ops, "SKIPPED", 100_000)
    q, state = named.table("t").order_by("k").offset(15), None
    for _ in range(2):
        out, state = q.sort_with_state(state)
    assert [r["k"] for r in out.collect()] == [0] * 5 + [1] * 20 + [2] * 20 + [3] * 20


def test_work_units_are_aggregated_by_file_and_merged_by_level(spark, tmp_path, monkeypatch):
    from tarn.operators import state

    root = str(tmp_path / "t")
    rows = spark.range(90, numPartitions=9).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    rows.write.parquet(root)
    units = [u for t in Lake(spark).path(root).plan_tasks() for u in tasks.split(t, max_rows=2)]
    spec = {"n": Aggregate("count"), "a": Aggregate("first", "v"), "z": Aggregate("last", "v"), "m": Aggregate("median", "v"), "mo": Aggregate("mode", "v")}
    written = []
    monkeypatch.setattr(state, "_written", lambda parts, folder, unit, own=state._written: written.append((folder.rpartition("/")[2], unit)) or own(parts, folder, unit))
    out = tasks.aggregate(spark, units, ["k"], spec, max_concurrent=1, max_buffered=3).orderBy("k").collect()
    assert [tuple(r) for r in out] == [(0, 45, 0, 88, 44.0, 0), (1, 45, 1, 89, 45.0, 1)]
    # A scan for each of the 9 files, not for 45 units; no value is written more often than there are levels.
    merged = [w for w in written if w[0].startswith("merged")]
    assert len(written) - len(merged) == 9 and sorted(merged) == [("merged-1", 2), ("merged-1", 5), ("merged-1", 8), ("merged-2", 8)]


def test_geo_wkb_packs_its_points_once(spark, sf):
    from tarn import catalogue

    plan = catalogue.QUERIES["geo_wkb"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [wkb(") == 1
