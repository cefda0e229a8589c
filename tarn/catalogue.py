"""The query catalogue: one query for each operator, beside the SQL that says the same to DuckDB.

SQL entries run through the engine's own front end. Sums of doubles are rounded
on both sides, as the order of addition is free.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn import expr as x
from tarn.errors import EngineError
from tarn.lake import Lake
from tarn.plans import tasks
from tarn.plans.spec import Aggregate, Budget, Order, Policy
from tarn.plans.tasks import json_boundary

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Q = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Q] = {}
ORACLE: dict[str, str] = {}


def paths(sf_dir: str) -> dict[str, str]:
    return {t: f"{sf_dir}/{t}.parquet" for t in TABLES}


def add(name: str, run: Q, oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle:
        ORACLE[name] = oracle


def sql(name: str, own: str, oracle: str | None = None, parameters: tuple = ()) -> None:
    """A query in the engine's SQL; oracle only where DuckDB needs other words."""
    add(name, lambda spark, sf: Lake(spark).sql(own, parameters, paths(sf)), oracle or own)


def query(name: str, oracle: str | None = None):
    """A query that a function of (lake, {table: path}) makes."""

    def keep(f):
        add(name, lambda spark, sf: f(Lake(spark), paths(sf)), oracle)
        return f

    return keep


def r2(column: str) -> str:
    """DuckDB's words for the engine's round(x, 2)."""
    return f"floor(({column}) * 100.0 + 0.5) / 100.0"


# Scans and projections.
sql("scan_projection", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
sql("projection_computed", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
sql("projection_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS tier FROM orders")
sql("select_star_limit_ordered", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 25")

# Predicates.
sql("filter_eq", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
sql("filter_ne", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
sql("filter_lt_gt", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10 AND l_discount >= 0.05")
sql("filter_in", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
sql("filter_not_in_list", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
sql("filter_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
sql("filter_null_checks", "SELECT o_orderkey FROM orders WHERE nullif(o_orderpriority, '1-URGENT') IS NULL OR nullif(o_orderstatus, 'P') IS NULL")
sql("filter_and_or_not", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 50000) AND o_orderpriority <> '5-LOW'")
sql("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%l_ w%t' OR p_name LIKE 'sm%'")
sql("filter_ilike", "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%STEEL%' OR p_type ILIKE 'econ%'")
sql("filter_time_string", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1997-01-01T00:00:00Z'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'")

# Arithmetic.
sql("arith_add_sub_mul", "SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS a, l_quantity - l_tax AS b, -l_quantity * 2 AS c FROM lineitem")
sql(
    "arith_div_zero",
    "SELECT l_orderkey, l_linenumber, l_quantity / (l_linenumber - 1) AS q FROM lineitem",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN CAST('inf' AS DOUBLE) ELSE l_quantity / CAST(l_linenumber - 1 AS DOUBLE) END AS q FROM lineitem",
)
sql("arith_mod", "SELECT l_orderkey, l_linenumber, l_orderkey % 7 AS m FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(l_orderkey % 7 AS DOUBLE) AS m FROM lineitem")

# Aggregates.
sql("agg_count_star", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
sql("agg_count_col", "SELECT o_orderstatus, count(nullif(o_orderpriority, '1-URGENT')) AS n FROM orders GROUP BY o_orderstatus")
for _op, _duck in (("sum", "coalesce(sum(l_quantity), 0)"), ("avg", "avg(l_quantity)"), ("var_samp", "var_samp(l_quantity)"), ("var_pop", "var_pop(l_quantity)"), ("stddev_samp", "stddev_samp(l_quantity)"), ("stddev_pop", "stddev_pop(l_quantity)"), ("median", "median(l_quantity)")):
    sql(f"agg_{_op}", f"SELECT l_returnflag, l_linestatus, round({_op}(l_quantity), 2) AS v FROM lineitem GROUP BY l_returnflag, l_linestatus", f"SELECT l_returnflag, l_linestatus, {r2(_duck)} AS v FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("agg_min_max", "SELECT c_mktsegment, min(c_acctbal) AS lo, max(c_acctbal) AS hi, min(c_name) AS first_name FROM customer GROUP BY c_mktsegment")
sql("agg_quantile", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 2) AS p90 FROM lineitem GROUP BY l_returnflag", f"SELECT l_returnflag, {r2('quantile_cont(l_extendedprice, 0.9)')} AS p90 FROM lineitem GROUP BY l_returnflag")
sql("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_returnflag")
sql("agg_approx_count_distinct", "SELECT l_returnflag, approx_count_distinct(l_suppkey) AS n FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag")
sql(
    "agg_median_string",
    "SELECT o_orderstatus, median(o_orderpriority) AS m FROM orders GROUP BY o_orderstatus",
    """WITH r AS (SELECT o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS k,
       count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
       SELECT o_orderstatus, o_orderpriority AS m FROM r WHERE k = (n - 1) // 2 + 1""",
)
sql(
    "agg_mode",
    "SELECT event_type, mode(user_id) AS m FROM events GROUP BY event_type",
    """WITH c AS (SELECT event_type, user_id, count(*) AS n, min(event_id) AS o FROM events GROUP BY event_type, user_id),
       r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, o) AS k FROM c)
       SELECT event_type, user_id AS m FROM r WHERE k = 1""",
)
for _op, _duck in (("first", "arg_min(o_totalprice, rn)"), ("last", "arg_max(o_totalprice, rn)"), ("any", "arg_min(o_totalprice, rn)")):
    sql(f"agg_{_op}", f"SELECT o_orderstatus, {_op}(o_totalprice) AS v FROM orders GROUP BY o_orderstatus", f"WITH o AS (SELECT *, row_number() OVER () AS rn FROM orders) SELECT o_orderstatus, {_duck} AS v FROM o GROUP BY o_orderstatus")
sql("agg_expression", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag", f"SELECT l_returnflag, {r2('sum(l_extendedprice * (1 - l_discount))')} AS revenue FROM lineitem GROUP BY l_returnflag")
sql("agg_global", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q, max(l_shipdate) AS last_ship FROM lineitem", f"SELECT count(*) AS n, {r2('sum(l_quantity)')} AS q, max(l_shipdate) AS last_ship FROM lineitem")
sql("agg_global_empty", "SELECT count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_quantity < 0", "SELECT count(*) AS n, coalesce(sum(l_quantity), 0) AS q FROM lineitem WHERE l_quantity < 0 HAVING count(*) > 0")
sql("agg_multi_key", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber")
sql("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n >= 15", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15")
sql("agg_order_limit", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 10 OFFSET 2")
sql("agg_group_only", "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority")
sql("agg_sum_all_null", "SELECT o_orderstatus, sum(nullif(o_totalprice, o_totalprice)) AS s FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(0 AS DOUBLE) AS s FROM orders GROUP BY o_orderstatus")
sql(
    "pricing_summary",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net,"
    " round(avg(l_quantity), 2) AS avg_qty, round(avg(l_discount), 2) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= '2001-09-02T00:00:00Z' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
    f"SELECT l_returnflag, l_linestatus, {r2('sum(l_quantity)')} AS sum_qty, {r2('sum(l_extendedprice)')} AS sum_base, {r2('sum(l_extendedprice * (1 - l_discount))')} AS sum_net,"
    f" {r2('avg(l_quantity)')} AS avg_qty, {r2('avg(l_discount)')} AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
)


# Joins. The builder sets no bound on the right side unless it is given one.
@query("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(lake, p):
    return lake.path(p["orders"]).select("o_orderkey", "o_custkey").join(lake.path(p["customer"]).select("c_custkey", "c_name"), "o_custkey", "c_custkey").select("o_orderkey", "c_name")


@query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey")
def _(lake, p):
    right = lake.path(p["orders"]).select("o_custkey", "o_orderkey").where(x.gt(x.col("o_totalprice"), 300000))
    return lake.path(p["customer"]).select("c_custkey").join(right, "c_custkey", "o_custkey", "left").select("c_custkey", "o_orderkey")


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(lake, p):
    return lake.path(p["customer"]).select("c_custkey").join(lake.path(p["orders"]).where(x.gt(x.col("o_totalprice"), 300000)), "c_custkey", "o_custkey", "semi")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(lake, p):
    return lake.path(p["customer"]).select("c_custkey").join(lake.path(p["orders"]).where(x.gt(x.col("o_totalprice"), 300000)), "c_custkey", "o_custkey", "anti")


# Whole tables, where one null key holds a good part of the rows; the right side has a row a key, or is only looked up.
@query("join_null_keys", "WITH a AS (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS k FROM orders), b AS (SELECT nullif(l_linestatus, 'F') AS k, count(*) AS n, max(l_tax) AS top FROM lineitem GROUP BY 1) SELECT a.o_orderkey, b.n, b.top FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def _(lake, p):
    a = lake.path(p["orders"]).project(o_orderkey=x.col("o_orderkey"), k=x.fn("nullif", x.col("o_orderstatus"), "F"))
    b = lake.path(p["lineitem"]).project(k=x.fn("nullif", x.col("l_linestatus"), "F"), l_tax=x.col("l_tax")).frame()
    b = Lake(lake.spark, tables={"b": b}).table("b").group_by("k").aggregate({"n": "count", "top": ("max", "l_tax")})
    return a.join(b, "k").select("o_orderkey", "n", "top")


@query("join_null_keys_semi", "WITH a AS (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS k FROM orders), b AS (SELECT nullif(l_linestatus, 'F') AS k FROM lineitem) SELECT a.o_orderkey FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.k IS NOT DISTINCT FROM b.k)")
def _(lake, p):
    a = lake.path(p["orders"]).project(o_orderkey=x.col("o_orderkey"), k=x.fn("nullif", x.col("o_orderstatus"), "F"))
    b = lake.path(p["lineitem"]).project(k=x.fn("nullif", x.col("l_linestatus"), "F"))
    return a.join(b, "k", "k", "semi").select("o_orderkey")


@query("join_multi_key", "SELECT a.l_orderkey, a.l_linenumber, b.l_tax AS tax FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE b.l_quantity > 45")
def _(lake, p):
    right = lake.path(p["lineitem"]).project(l_orderkey=x.col("l_orderkey"), l_linenumber=x.col("l_linenumber"), tax=x.col("l_tax")).where(x.gt(x.col("l_quantity"), 45))
    return lake.path(p["lineitem"]).select("l_orderkey", "l_linenumber").join(right, ["l_orderkey", "l_linenumber"])


@query("join_prefix_columns", 'SELECT a.n_nationkey, a.n_name, b.n_name AS "right.n_name" FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey')
def _(lake, p):
    return lake.path(p["nation"]).select("n_nationkey", "n_name").join(lake.path(p["nation"]).select("n_nationkey", "n_name"), "n_nationkey", max_right_rows=100)


@query("join_lookup", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(lake, p):
    regions = {r["r_regionkey"]: r["r_name"] for r in lake.path(p["region"]).collect()}  # five rows
    found = lake.path(p["nation"]).lookup(lambda keys: [{"r_regionkey": k, "r_name": regions[k]} for (k,) in keys], ["n_regionkey"], ["r_regionkey"], schema="r_regionkey int, r_name string")
    return found.select("n_name", "r_name")


sql("join_sql_inner", "SELECT s.s_name, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE s.s_acctbal > 0")
sql("join_sql_left", "SELECT c.c_custkey, n.n_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey ORDER BY c.c_custkey LIMIT 50")
sql("join_residual_filter", "SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal > 5000 OR n.n_name LIKE 'N%_1%'")
add("join_using", lambda spark, sf: Lake(spark, tables={"a": spark.read.parquet(f"{sf}/nation.parquet"), "b": spark.read.parquet(f"{sf}/region.parquet").withColumnRenamed("r_regionkey", "n_regionkey")}).sql("SELECT n_name, r_name FROM a JOIN b USING (n_regionkey)"), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")

# Subqueries and CTEs.
sql("subquery_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND c_acctbal > 0")
sql("subquery_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
sql("subquery_in_tuple", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 49)")
sql("subquery_scalar_where", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
sql("subquery_scalar_projection", "SELECT n_name, (SELECT count(*) FROM region) AS regions FROM nation")
sql("cte_filter", "WITH big AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 250000) SELECT o_orderkey FROM big WHERE o_orderstatus <> 'F'")
sql("cte_aggregate", "WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n, count(*) AS customers FROM t GROUP BY n")

# Order, limit, distinct.
sql("order_asc", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 100")
sql("order_multi", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey LIMIT 60")
sql("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC NULLS FIRST, l_orderkey, l_linenumber LIMIT 10")
sql("limit_offset", "SELECT event_id FROM events ORDER BY event_id LIMIT 15 OFFSET 40")
sql("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_nulls = "WITH t AS (SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS p FROM orders) SELECT o_orderkey, p FROM t ORDER BY {} LIMIT 40"
sql("order_desc_nulls", _nulls.format("p DESC, o_orderkey"), _nulls.format("p DESC NULLS FIRST, o_orderkey"))
sql("order_nulls_first", _nulls.format("p NULLS FIRST, o_orderkey DESC"))
sql(
    "distinct_order_hidden",
    "SELECT DISTINCT o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 3",
    "SELECT o_orderpriority FROM (SELECT o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY o_orderpriority) ORDER BY k LIMIT 3",
)

# Functions.
sql("fn_lower_upper", "SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up FROM customer")
add("fn_trim", lambda spark, sf: Lake(spark, tables={"t": spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.concat(F.lit(" \t"), "c_name", F.lit("  ")).alias("v"))}).sql("SELECT c_custkey, trim(v) AS v FROM t"), "SELECT c_custkey, c_name AS v FROM customer")
sql("fn_substr", "SELECT p_partkey, substr(p_name, 0, 4) AS head, substr(p_name, -3, 2) AS tail FROM part", "SELECT p_partkey, substr(p_name, 1, 4) AS head, substr(p_name, greatest(length(p_name) - 2, 1), 2) AS tail FROM part")
sql("fn_replace", "SELECT p_partkey, replace(p_name, 'a', '_') AS v FROM part")
sql("fn_regexp_matches", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '[0-9]*7[0-9]$')")
sql("fn_regexp_replace_first", "SELECT c_custkey, regexp_replace(c_name, '([0-9])0', '<\\1>') AS v FROM customer")
sql("fn_regexp_replace_global", "SELECT c_custkey, regexp_replace(c_name, '[aeiou]', '.', 'g') AS v FROM customer")
sql("fn_coalesce", "SELECT o_orderkey, coalesce(nullif(o_orderpriority, '1-URGENT'), 'none') AS v FROM orders")
sql("fn_nullif", "SELECT o_orderkey, nullif(o_orderstatus, 'O') AS v FROM orders")
add(
    "fn_cast_string",
    lambda spark, sf: Lake(spark).path(f"{sf}/lineitem.parquet").project(l_orderkey=x.col("l_orderkey"), l_linenumber=x.col("l_linenumber"), v=x.fn("cast", x.col("l_quantity"), "string")).frame(),
    "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS v FROM lineitem",
)
sql("fn_cast_number", "SELECT o_orderkey, cast(substr(o_orderpriority, 0, 1), 'number') AS v FROM orders", "SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS v FROM orders")
sql("fn_cast_boolean", "SELECT l_orderkey, l_linenumber, cast(l_linenumber - 1, 'boolean') AS v FROM lineitem", "SELECT l_orderkey, l_linenumber, l_linenumber <> 1 AS v FROM lineitem")
sql(
    "fn_least_greatest",
    "SELECT l_orderkey, l_linenumber, least(l_discount, l_tax) AS lo, greatest(l_quantity, nullif(l_tax, 0)) AS hi FROM lineitem",
    "SELECT l_orderkey, l_linenumber, least(l_discount, l_tax) AS lo, CASE WHEN l_tax = 0 THEN NULL ELSE greatest(l_quantity, l_tax) END AS hi FROM lineitem",
)
sql("fn_year_month_day_hour", "SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h FROM events", "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h FROM events")
for _part in ("year", "month", "day", "hour"):
    sql(f"fn_date_trunc_{_part}", f"SELECT event_id, date_trunc('{_part}', ts) AS t FROM events", f"SELECT event_id, strftime(date_trunc('{_part}', ts), '%Y-%m-%dT%H:%M:%S.000Z') AS t FROM events")
sql("fn_round", "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 1) AS a, round(-l_quantity / 2) AS b FROM lineitem", "SELECT l_orderkey, l_linenumber, floor(l_extendedprice * 10.0 + 0.5) / 10.0 AS a, floor(-l_quantity / 2 + 0.5) AS b FROM lineitem")
sql("fn_floor_ceil_abs", "SELECT c_custkey, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, abs(c_acctbal) AS a FROM customer")

# Geometry: points made from event ids on a grid of half units.
_LON, _LAT = "(event_id % 40) / 2 - 10", "(event_id % 24) / 2 - 6"
_DLON, _DLAT = "(event_id % 40) / 2.0 - 10", "(event_id % 24) / 2.0 - 6"
_BOX = '{"type":"BBox","minx":-5,"miny":-3,"maxx":5,"maxy":3}'
sql("geo_bbox_intersects", f"SELECT event_id FROM events WHERE st_intersects(st_point({_LON}, {_LAT}), '{_BOX}')", f"SELECT event_id FROM events WHERE {_DLON} BETWEEN -5 AND 5 AND {_DLAT} BETWEEN -3 AND 3")
sql("geo_disjoint", f"SELECT event_id FROM events WHERE st_disjoint(st_point({_LON}, {_LAT}), '{_BOX}')", f"SELECT event_id FROM events WHERE NOT ({_DLON} BETWEEN -5 AND 5 AND {_DLAT} BETWEEN -3 AND 3)")
sql("geo_contains_within", f"SELECT event_id, st_within(st_point({_LON}, {_LAT}), '{_BOX}') AS w FROM events WHERE st_contains('{_BOX}', st_point({_LON}, {_LAT}))", f"SELECT event_id, true AS w FROM events WHERE {_DLON} > -5 AND {_DLON} < 5 AND {_DLAT} > -3 AND {_DLAT} < 3")
sql("geo_dwithin", f"SELECT event_id FROM events WHERE st_dwithin(st_point({_LON}, {_LAT}), 'POINT(0 0)', 2.75)", f"SELECT event_id FROM events WHERE sqrt(({_DLON}) * ({_DLON}) + ({_DLAT}) * ({_DLAT})) <= 2.75")
sql("geo_distance_area_length", f"SELECT event_id, st_distance(st_point({_LON}, 0), '{_BOX}') AS d, st_area('{_BOX}') AS a, st_length('{_BOX}') AS l FROM events", f"SELECT event_id, greatest(-5 - ({_DLON}), ({_DLON}) - 5, 0.0) AS d, CAST(60 AS DOUBLE) AS a, CAST(32 AS DOUBLE) AS l FROM events")
sql("geo_point_xy", f"SELECT event_id, st_x(st_point({_LON}, {_LAT})) AS lon, st_y(st_point({_LON}, {_LAT})) AS lat FROM events", f"SELECT event_id, CAST({_DLON} AS DOUBLE) AS lon, CAST({_DLAT} AS DOUBLE) AS lat FROM events")
sql("geo_centroid_envelope", f"SELECT event_id, st_centroid('{_BOX}') AS c, st_envelope('{_BOX}') AS e FROM events", """SELECT event_id, '{"type":"Point","coordinates":[0,0]}' AS c, '{"type":"BBox","minx":-5,"miny":-3,"maxx":5,"maxy":3}' AS e FROM events""")
_CELL = "CASE WHEN event_id % 2 = 0 THEN '8829a1d757fffff' ELSE '8829a1d755fffff' END"
sql("h3_in", f"SELECT event_id FROM events WHERE h3_in({_CELL}, '[\"8829a1d757fffff\"]')", "SELECT event_id FROM events WHERE event_id % 2 = 0")
sql("h3_parent", f"SELECT event_id, h3_parent({_CELL}, 7) AS p FROM events", "SELECT event_id, '8729a1d75ffffff' AS p FROM events")


# Surfaces.
@query("json_query", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 100000 AND (o_orderstatus IN ('F', 'O') OR o_orderpriority IS NULL) ORDER BY o_orderstatus DESC, o_orderpriority LIMIT 7")
def _(lake, p):
    return lake.query(
        {
            "version": 1,
            "from": p["orders"],
            "select": ["o_orderstatus", "o_orderpriority"],
            "distinct": True,
            "where": {"and": [{"gt": ["o_totalprice", 100000]}, {"or": [{"in": ["o_orderstatus", ["F", "O"]]}, {"isNull": "o_orderpriority"}]}]},
            "orderBy": [{"column": "o_orderstatus", "direction": "desc"}, {"column": "o_orderpriority"}],
            "limit": 7,
        }
    ).frame()


sql("sql_parameters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = $1 AND o_totalprice > $2 ORDER BY o_orderkey LIMIT $3", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 ORDER BY o_orderkey LIMIT 20", ("F", 200000, 20))


@query("builder_aggregate", "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_totalprice < 150000 GROUP BY o_orderstatus HAVING count(*) > 5 ORDER BY n DESC, o_orderstatus LIMIT 2")
def _(lake, p):
    grouped = lake.path(p["orders"]).where(x.lt(x.col("o_totalprice"), 150000)).group_by("o_orderstatus")
    return grouped.aggregate({"n": "count", "top": ("max", "o_totalprice")}, having=x.gt(x.col("n"), 5), order_by=(Order("n", True), Order("o_orderstatus")), limit=2, max_groups=100)


# Policies and budgets hold on every path.
_RULED = ("o_orderkey", "o_orderstatus", "o_totalprice")


def ruled(spark: SparkSession, sf_dir: str, most: int | None = None, **more) -> Lake:
    policy = Policy(_RULED, most, lambda c: x.lt(x.col("o_totalprice"), c["most"]), {"most": 200000})
    return Lake(spark, policy=policy, **more)


add(
    "policy_row_filter",
    lambda spark, sf: ruled(spark, sf, 30).path(f"{sf}/orders.parquet").order_by("o_orderkey").frame(),
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice < 200000 ORDER BY o_orderkey LIMIT 30",
)
add(
    "policy_group_by",
    lambda spark, sf: ruled(spark, sf, 2).path(f"{sf}/orders.parquet").group_by("o_orderstatus").aggregate({"n": "count", "top": ("max", "o_totalprice")}, order_by=("o_orderstatus",)),
    "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_totalprice < 200000 GROUP BY o_orderstatus ORDER BY o_orderstatus LIMIT 2",
)
add(
    "policy_sql",
    lambda spark, sf: ruled(spark, sf, 25).sql("SELECT * FROM orders ORDER BY o_orderkey LIMIT 50", (), paths(sf)),
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice < 200000 ORDER BY o_orderkey LIMIT 25",
)
add(
    "policy_sql_named_table",
    lambda spark, sf: ruled(spark, sf, tables={"t": spark.read.parquet(f"{sf}/orders.parquet")}).sql("SELECT o_orderstatus, count(*) AS n FROM t GROUP BY o_orderstatus"),
    "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice < 200000 GROUP BY o_orderstatus",
)


def refusals(spark: SparkSession, cases: dict[str, Callable[[], object]]) -> DataFrame:
    """The code with which each case is refused; none if it is not."""
    found = []
    for name, run in cases.items():
        try:
            out = run()
            if isinstance(out, DataFrame):
                out.collect()
            found.append((name, None))
        except EngineError as e:
            found.append((name, e.code.removeprefix("TARN_")))
    return spark.createDataFrame(found, "refused string, code string")


def refused(name: str, cases: Callable[[SparkSession, str], dict[str, Callable[[], object]]], codes: dict[str, str]) -> None:
    values = ", ".join("('{}', {})".format(c.replace("'", "''"), f"'{code}'" if code else "NULL") for c, code in codes.items())
    add(name, lambda spark, sf: refusals(spark, cases(spark, sf)), f"SELECT * FROM (VALUES {values}) AS v(refused, code)")


def _ruled_cases(spark: SparkSession, sf: str):
    lake, orders, t = ruled(spark, sf), f"{sf}/orders.parquet", paths(sf)
    few = Lake(spark, Budget(max_output_rows=3))
    return {
        "select": lambda: lake.path(orders).select("o_custkey").frame(),
        "where": lambda: lake.path(orders).where(x.gt(x.col("o_custkey"), 1)).frame(),
        "group key": lambda: lake.path(orders).group_by("o_custkey").aggregate({"n": "count"}),
        "aggregate input": lambda: lake.path(orders).group_by("o_orderstatus").aggregate({"n": ("max", "o_custkey")}),
        "sql column": lambda: lake.sql("SELECT o_custkey FROM orders", (), t),
        "sql condition": lambda: lake.sql("SELECT o_orderkey FROM orders WHERE o_custkey = 1", (), t),
        "sql group key": lambda: lake.sql("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey", (), t),
        "output rows": lambda: few.path(orders).frame(),
        "output rows, sql": lambda: few.sql("SELECT o_orderkey FROM orders", (), t),
        "output rows, groups": lambda: few.path(orders).group_by("o_orderpriority").aggregate({"n": "count"}),
        "files": lambda: Lake(spark, Budget(max_files=0)).path(orders).frame(),
        "bytes, sql": lambda: Lake(spark, Budget(max_bytes=10)).sql("SELECT count(*) AS n FROM orders", (), t),
        "rows decoded": lambda: Lake(spark, Budget(max_rows_decoded=10)).path(orders).frame(),
        "range requests": lambda: Lake(spark, Budget(max_range_requests=1)).path(orders).frame(),
        "buffered rows": lambda: Lake(spark, Budget(max_buffered_rows=10)).path(orders).order_by("o_orderkey").frame(),
        "memory": lambda: Lake(spark, Budget(max_memory_bytes=100)).path(orders).order_by("o_orderkey").limit(5).frame(),
        "buffered rows, few": lambda: Lake(spark, Budget(max_buffered_rows=10)).path(orders).order_by("o_orderkey").limit(5).frame(),
        "groups": lambda: Lake(spark).path(orders).group_by("o_custkey").aggregate({"n": "count"}, max_groups=2),
        "join rows": lambda: Lake(spark).path(orders).join(Lake(spark).path(orders), "o_orderkey", max_right_rows=5),
    }


_V, _B = "VALIDATION_ERROR", "BUDGET_EXCEEDED"
refused(
    "budget_and_policy_refusals",
    _ruled_cases,
    {**dict.fromkeys(("select", "where", "group key", "aggregate input", "sql column", "sql condition", "sql group key"), _V), **dict.fromkeys(("output rows", "output rows, sql", "output rows, groups", "files", "bytes, sql", "rows decoded", "range requests", "buffered rows", "memory"), _B), "buffered rows, few": None, "groups": "GROUP_LIMIT_EXCEEDED", "join rows": _B},
)

#: Statements outside the SQL that the engine speaks, and the codes they are refused with.
REFUSED_SQL = {
    "SELECT 1 AS a; SELECT 2 AS a": "SQL_UNSUPPORTED",
    "DELETE FROM orders": "SQL_UNSUPPORTED",
    "CREATE TABLE t (a int)": "SQL_UNSUPPORTED",
    "WITH a AS (SELECT o_orderkey FROM orders), b AS (SELECT o_orderkey FROM orders) SELECT o_orderkey FROM a": "SQL_UNSUPPORTED",
    "WITH a AS (SELECT o_orderkey FROM orders) SELECT o_orderkey FROM orders": "SQL_UNSUPPORTED",
    "SELECT a FROM (SELECT o_orderkey AS a FROM orders) t": "SQL_UNSUPPORTED",
    "SELECT o_orderkey FROM orders, customer": "SQL_UNSUPPORTED",
    "SELECT 1 AS a": "SQL_UNSUPPORTED",
    "SELECT o.o_orderkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey": "SQL_UNSUPPORTED",
    "SELECT o.o_orderkey FROM orders o FULL JOIN customer c ON o.o_custkey = c.c_custkey": "SQL_UNSUPPORTED",
    "SELECT o.o_orderkey FROM orders o CROSS JOIN customer c": "SQL_UNSUPPORTED",
    "SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey > c.c_custkey": "SQL_UNSUPPORTED",
    "SELECT o.o_orderkey FROM orders o JOIN customer c ON o_custkey = c_custkey": "SQL_UNSUPPORTED",
    "SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = o.o_orderkey": "SQL_UNSUPPORTED",
    "SELECT DISTINCT ON (o_custkey) o_orderkey FROM orders": "SQL_UNSUPPORTED",
    "SELECT o_orderkey + 1 FROM orders": "SQL_UNSUPPORTED",
    "SELECT * AS a FROM orders": "SQL_UNSUPPORTED",
    "SELECT row_number() OVER (ORDER BY o_orderkey) AS r FROM orders": "SQL_UNSUPPORTED",
    "SELECT CASE o_orderstatus WHEN 'F' THEN 1 END AS a FROM orders": "SQL_UNSUPPORTED",
    "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer LIMIT 3)": "SQL_UNSUPPORTED",
    "SELECT o_orderkey FROM orders WHERE o_orderkey = 1 OR o_custkey IN (SELECT c_custkey FROM customer)": "SQL_UNSUPPORTED",
    "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT o_totalprice FROM orders)": "SQL_UNSUPPORTED",
    "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders)": "SQL_UNSUPPORTED",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey + 1": "SQL_UNSUPPORTED",
    "SELECT o_orderkey FROM orders ORDER BY 1": "SQL_UNSUPPORTED",
    "SELECT sum(DISTINCT o_totalprice) AS s FROM orders": "SQL_UNSUPPORTED",
    "SELECT count(DISTINCT *) AS s FROM orders": "SQL_UNSUPPORTED",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus LIKE o_orderpriority": "SQL_UNSUPPORTED",
    "SELECT o_orderkey ^ 2 AS a FROM orders": "SQL_UNSUPPORTED",
    "SELECT +o_orderkey AS a FROM orders": "SQL_UNSUPPORTED",
    "SELECT o_orderkey FROM orders WHERE o_orderkey = $1": "SQL_UNSUPPORTED",
    "SELECT o_orderkey FROM orders LIMIT -1": "TYPE_ERROR",
    "SELECT o_orderkey FROM orders LIMIT 1.5": "TYPE_ERROR",
    "SELECT quantile_cont(o_totalprice, 2) AS q FROM orders": "TYPE_ERROR",
    "SELECT count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey": "SQL_UNSUPPORTED",
    "SELECT o_custkey, count(*) AS n FROM orders": "SQL_UNSUPPORTED",
    "SELECT o_orderkey FROM nowhere": "UNKNOWN_TABLE",
    "SELECT nothing FROM orders": "UNKNOWN_COLUMN",
    "SELECT o_orderkey FROM orders WHERE o_orderkey = 'x'": "TYPE_ERROR",
    "SELECT lower(o_orderkey) AS a FROM orders": "TYPE_ERROR",
    "SELECT nosuch(o_orderkey) AS a FROM orders": "UNSUPPORTED_PUSHDOWN",
    "SELECT o_orderkey FROM": "PARSE_ERROR",
    "SELECT (o_orderkey, o_custkey) AS a FROM orders": "SQL_UNSUPPORTED",
}
refused("sql_refusals", lambda spark, sf: {text: (lambda text=text: Lake(spark).sql(text, (), paths(sf))) for text in REFUSED_SQL}, REFUSED_SQL)

# Forms that once went wrong.
sql("sql_nested_parentheses", "SELECT o_orderkey FROM orders WHERE " + "(" * 60 + "o_orderstatus = 'F'" + ")" * 60 + " AND ((o_totalprice) * (2)) > ((100000))")
sql(
    "fn_regexp_replace_empty_match",
    "SELECT c_custkey, regexp_replace(c_mktsegment, 'X*', '-') AS a, regexp_replace(c_name, '[0-9]*$', '<\\0>') AS b, regexp_replace('', 'x*', '-') AS c FROM customer".replace("\\0", ""),
    "SELECT c_custkey, '-' || c_mktsegment AS a, regexp_replace(c_name, '[0-9]+$', '') || '<>' AS b, '-' AS c FROM customer",
)
sql(
    "filter_time_offset",
    "SELECT event_id FROM events WHERE ts >= '2024-01-05T02:30:00+02:00' AND ts < '2024-01-20T00:00:00-05:30'",
    "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:30:00' AND ts < TIMESTAMP '2024-01-20 05:30:00'",
)


# Medians and quantiles by rank, as beyond the size that is held in memory; groups, a null one too, and none at all.
def _by_rank(spark: SparkSession, sf: str, text: str) -> DataFrame:
    from tarn.operators import aggregate

    before, aggregate.IN_MEMORY = aggregate.IN_MEMORY, 0
    try:
        return Lake(spark).sql(text, (), paths(sf))
    finally:
        aggregate.IN_MEMORY = before


for _name, _keys, _group in (("agg_median_by_rank", "l_returnflag, l_linestatus, ", " GROUP BY l_returnflag, l_linestatus"), ("agg_quantile_by_rank_global", "", "")):
    add(
        _name,
        lambda spark, sf, k=_keys, g=_group: _by_rank(spark, sf, f"SELECT {k}round(median(l_extendedprice), 2) AS m, round(quantile_cont(l_quantity, 0.37), 2) AS q FROM lineitem{g}"),
        f"SELECT {_keys}{r2('median(l_extendedprice)')} AS m, {r2('quantile_cont(l_quantity, 0.37)')} AS q FROM lineitem{_group}",
    )


# Operator state: one half of a table, then the other half with the state of the first.
def _halves(lake: Lake, p: dict[str, str]):
    return [lake.path(p["orders"]).where(c(x.col("o_totalprice"), 150000)) for c in (x.lt, x.gte)]


@query("top_k_with_state", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 5")
def _(lake, p):
    state = None
    for half in _halves(lake, p):
        out, state = half.select("o_orderkey", "o_totalprice").order_by("o_orderpriority", "-o_totalprice", "o_orderkey").offset(5).limit(40).top_k_with_state(json_boundary(state))
    return out


@query("sort_with_state", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderpriority, o_orderkey OFFSET 7")
def _(lake, p):
    state = None
    for half in _halves(lake, p):
        out, state = half.select("o_orderkey", "o_orderstatus").order_by("o_orderpriority", "o_orderkey").offset(7).sort_with_state(json_boundary(state))
    return out


_STATEFUL = {
    "n": "count", "s": ("sum", "o_totalprice"), "a": ("avg", "o_totalprice"), "sd": ("stddev", "o_totalprice"), "vp": ("var_pop", "o_totalprice"), "lo": ("min", "o_totalprice"), "hi": ("max", "o_orderdate"),
    "d": ("count_distinct", "o_custkey"), "md": ("median", "o_totalprice"), "q": Aggregate("quantile", "o_totalprice", None, 0.8), "mo": ("mode", "o_orderpriority"), "ms": ("median", "o_orderpriority"),
}
_STATEFUL_SQL = """WITH r AS (SELECT o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders),
    m AS (SELECT o_orderstatus, o_orderpriority AS ms FROM r WHERE k = (n - 1) // 2 + 1)
    SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 0) AS s, round(avg(o_totalprice), 2) AS a, round(stddev(o_totalprice), 2) AS sd, round(var_pop(o_totalprice) / 1e6, 2) AS vp, min(o_totalprice) AS lo,
    max(o_orderdate) AS hi, count(DISTINCT o_custkey) AS d, round(median(o_totalprice), 2) AS md, round(quantile_cont(o_totalprice, 0.8), 2) AS q, any_value(ms) AS ms FROM orders JOIN m USING (o_orderstatus) GROUP BY o_orderstatus"""


def _rounded(out: DataFrame) -> DataFrame:
    """Without the mode, whose ties the order of files decides."""
    digits = {"s": 0, "a": 2, "sd": 2, "md": 2, "q": 2}
    out = out.withColumn("vp", F.round(F.col("vp") / 1e6, 2))
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()}).drop("mo")


@query("aggregate_with_state", _STATEFUL_SQL)
def _(lake, p):
    state = None
    for half in _halves(lake, p):
        out, state = half.group_by("o_orderstatus").aggregate_with_state(_STATEFUL, json_boundary(state))
    return _rounded(out)


@query("aggregate_work_units", _STATEFUL_SQL)
def _(lake, p):
    units = [u for t in lake.path(p["orders"]).plan_tasks() for u in tasks.split(t, max_rows=200_000)]
    made = {k: v if isinstance(v, Aggregate) else Aggregate(v) if isinstance(v, str) else Aggregate(*v) for k, v in _STATEFUL.items()}
    return _rounded(tasks.aggregate(lake.spark, units, ["o_orderstatus"], made, max_concurrent=2, max_buffered=3))


# Work units, row ranges, statistics.
@query("row_range_units", "SELECT p_partkey, p_size FROM part WHERE p_size > 10")
def _(lake, p):
    found = lake.path(p["part"]).select("p_partkey", "p_size").where(x.gt(x.col("p_size"), 10)).plan_tasks()
    units = [tasks.Task.from_json(tasks.json_boundary(u.to_json())) for t in found for u in tasks.split(t, max_rows=700)]
    return tasks.scan_units(lake.spark, units)


@query("query_stats", "SELECT count(*) AS rows_decoded, count(*) FILTER (WHERE o_totalprice > 100000) AS rows_matched, CAST(12 AS BIGINT) AS rows_returned, CAST(1 AS BIGINT) AS files_read, 'o_orderkey,o_totalprice' AS columns_read FROM orders")
def _(lake, p):
    stats = lake.path(p["orders"]).select("o_orderkey").where(x.gt(x.col("o_totalprice"), 100000)).order_by("-o_totalprice").limit(12).stats()
    row = {k: stats[k] for k in ("rows_decoded", "rows_matched", "rows_returned", "files_read")} | {"columns_read": ",".join(stats["columns_read"])}
    return lake.spark.createDataFrame([row], "rows_decoded long, rows_matched long, rows_returned long, files_read long, columns_read string")


@query("describe_table", "SELECT * FROM (VALUES ('r_regionkey', 'int', true), ('r_name', 'string', true)) AS v(\"column\", \"type\", nullable)")
def _(lake, p):
    return lake.sql("DESCRIBE region", (), p)


@query("sql_format_round_trip", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND NOT c_name LIKE '%7' GROUP BY c_mktsegment HAVING count(*) > 3 ORDER BY n DESC, c_mktsegment LIMIT 4")
def _(lake, p):
    from tarn.sql.format import format_sql
    from tarn.sql.parser import parse

    text = "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND NOT c_name LIKE '%7' GROUP BY c_mktsegment HAVING n > 3 ORDER BY n DESC, c_mktsegment LIMIT 4"
    return lake.sql(format_sql(parse(text)), (), p)


# Shapes beyond boxes, and other ways to write them: a polygon with a hole, a line, WKB, texts in columns.
_HOLED = '{"type":"Polygon","coordinates":[[[-6,-4],[6,-4],[6,4],[-6,4],[-6,-4]],[[-2,-2],[2,-2],[2,2],[-2,2],[-2,-2]]]}'
_INSIDE = f"{_DLON} BETWEEN -6 AND 6 AND {_DLAT} BETWEEN -4 AND 4 AND NOT ({_DLON} > -2 AND {_DLON} < 2 AND {_DLAT} > -2 AND {_DLAT} < 2)"
sql("geo_polygon_with_hole", f"SELECT event_id FROM events WHERE st_intersects(st_point({_LON}, {_LAT}), '{_HOLED}')", f"SELECT event_id FROM events WHERE {_INSIDE}")
sql(
    "geo_polygon_contains",
    f"SELECT event_id FROM events WHERE st_contains('{_HOLED}', st_point({_LON}, {_LAT}))",
    f"SELECT event_id FROM events WHERE {_DLON} > -6 AND {_DLON} < 6 AND {_DLAT} > -4 AND {_DLAT} < 4 AND NOT ({_DLON} BETWEEN -2 AND 2 AND {_DLAT} BETWEEN -2 AND 2)",
)
_LINE = '{"type":"LineString","coordinates":[[-10,-1],[10,-1]]}'
sql("geo_line_distance", f"SELECT event_id FROM events WHERE st_dwithin(st_point({_LON}, {_LAT}), '{_LINE}', 1.5)", f"SELECT event_id FROM events WHERE abs({_DLAT} + 1) <= 1.5")
sql("geo_box_columns", f"SELECT event_id, st_area(st_bbox({_LON}, -1, 30, 3)) AS a, st_envelope(st_bbox(0, 0, 1, event_id % 3)) AS e FROM events", f"""SELECT event_id, (30 - ({_DLON})) * 4.0 AS a, '{{"type":"BBox","minx":0,"miny":0,"maxx":1,"maxy":' || (event_id % 3) || '}}' AS e FROM events""")


def _shapes(spark: SparkSession, sf: str) -> Lake:
    """Events as small triangles and as points, in text and in WKB."""
    lon, lat = F.expr("(event_id % 40) / 2 - 10").cast("double"), F.expr("(event_id % 24) / 2 - 6").cast("double")
    corner = lambda dx, dy: F.concat(F.lit("["), (lon + dx).cast("string"), F.lit(","), (lat + dy).cast("string"), F.lit("]"))
    triangle = F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.concat_ws(",", corner(0, 0), corner(1, 0), corner(0, 1), corner(0, 0)), F.lit("]]}"))
    words = F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))

    def wkb(xs, ys):
        import struct

        import pandas as pd

        return pd.Series([struct.pack("<BIdd", 1, 1, a, b) for a, b in zip(xs, ys, strict=True)])

    packed = F.pandas_udf(wkb, "binary", F.PandasUDFType.SCALAR).asNondeterministic()  # made once a row, not for each use
    df = spark.read.parquet(f"{sf}/events.parquet").select("event_id", triangle.alias("shape"), words.alias("words"), packed(lon, lat).alias("wkb"))
    return Lake(spark, tables={"shapes": df})


add("geo_polygon_column", lambda spark, sf: _shapes(spark, sf).sql(f"SELECT event_id, st_area(shape) AS a FROM shapes WHERE st_intersects(shape, '{_BOX}')"), f"SELECT event_id, CAST(0.5 AS DOUBLE) AS a FROM events WHERE {_DLON} BETWEEN -6 AND 5 AND {_DLAT} BETWEEN -4 AND 3 AND ({_DLON} >= -5 OR {_DLAT} >= -3 OR ({_DLON} + 5) + ({_DLAT} + 3) + 1 >= 0)")
add("geo_text_points", lambda spark, sf: _shapes(spark, sf).sql("SELECT event_id, st_x(words) AS lon, st_y(words) AS lat FROM shapes"), f"SELECT event_id, CAST({_DLON} AS DOUBLE) AS lon, CAST({_DLAT} AS DOUBLE) AS lat FROM events")
add("geo_wkb", lambda spark, sf: _shapes(spark, sf).sql(f"SELECT event_id, st_x(wkb) AS lon FROM shapes WHERE st_within(wkb, '{_BOX}')"), f"SELECT event_id, CAST({_DLON} AS DOUBLE) AS lon FROM events WHERE {_DLON} > -5 AND {_DLON} < 5 AND {_DLAT} > -3 AND {_DLAT} < 3")
add(
    "geo_builders",
    lambda spark, sf: Lake(spark).path(f"{sf}/events.parquet").project(event_id=x.col("event_id"), d=x.st_distance(x.st_point(x.mod(x.col("event_id"), 10), 0), x.st_geojson({"type": "Point", "coordinates": [3, 4]}))).where(x.st_intersects(x.st_point(x.mod(x.col("event_id"), 10), 0), x.st_bbox(2, -1, 6, 1))).frame(),
    "SELECT event_id, sqrt(power(event_id % 10 - 3, 2) + 16) AS d FROM events WHERE event_id % 10 BETWEEN 2 AND 6",
)
