"""The session object and the fluent queries."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tarn.errors import EngineError, type_error
from tarn.expr import Expr, and_
from tarn.operators import aggregate as agg
from tarn.operators import rows as row_ops
from tarn.operators import state as op_state
from tarn.operators.joins import join as join_frames
from tarn.operators.joins import lookup_join
from tarn.plans import explain, jsonapi, resume, tasks
from tarn.plans.compile import Compiler, quoted
from tarn.plans.spec import Aggregate, Budget, Order, Policy, QuerySpec
from tarn.runtime import Runtime
from tarn.sources import files as file_sources
from tarn.sources.http import HttpStore, is_http


class Lake:
    """Sources by path or name, under one budget and policy.

    tables: DataFrames by name; a query's source may be such a name. listing_ms: how long the
    files found for a path or pattern are taken to be all; 0 lists anew each time.
    """

    def __init__(self, spark: SparkSession, budget: Budget | None = None, policy: Policy | None = None, tables: dict[str, DataFrame] | None = None, strict_types: bool = True, runtime: Runtime | None = None, listing_ms: float = 0):
        self.spark, self.budget, self.policy, self.runtime = spark, budget or Budget(), policy, runtime or Runtime()
        self.tables, self.strict_types, self.sidecars = dict(tables or {}), strict_types, {}
        self.listing_ms, self.listings, self.http = listing_ms, {}, HttpStore(max_bytes=self.budget.max_bytes)
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def path(self, source: str) -> Query:
        return Query(self, QuerySpec(source))

    def hive(self, source: str) -> Query:
        return Query(self, QuerySpec(source, hive=True))

    def table(self, name: str) -> Query:
        if name not in self.tables:
            raise EngineError("UNKNOWN_TABLE", f"no table {name}", table=name)
        return Query(self, QuerySpec(name))

    def query(self, data: dict) -> Query:
        """A query in the JSON format."""
        return Query(self, jsonapi.parse(data))

    def resume(self, bookmark: dict | resume.Bookmark) -> Query:
        mark = bookmark if isinstance(bookmark, resume.Bookmark) else resume.Bookmark.from_json(bookmark)
        return Query(self, QuerySpec.from_json(mark.query))

    def sql(self, text: str, parameters: tuple = (), tables: dict[str, str] | None = None) -> DataFrame:
        from tarn.sql import run

        return run.execute(self, text, parameters, tables or {})

    def use_sidecar(self, source: str, index) -> None:
        """Prunes files of a source by an index of their bounds."""
        self.sidecars[source] = index

    def listed(self, source: str) -> list:
        """The files of a path or pattern."""
        at, found = self.listings.get(source, (0, None))
        now = self.runtime.now()
        if found is None or now - at >= self.listing_ms:
            found = file_sources.list_files(self.spark, self.http.fetch(self.spark, source) if is_http(source) else source)
            if self.listing_ms:
                self.listings[source] = now, found
        return found

    def files(self, spec: QuerySpec) -> tuple[list, list]:
        """(kept, skipped) files of a source."""
        found = self.listed(spec.source)
        kept, skipped = file_sources.prune_hive(found, spec.where) if spec.hive else (found, [])
        if index := self.sidecars.get(spec.source):
            live = index.prune([f.path for f in kept], spec.where)
            skipped = skipped + [f for f in kept if f.path not in live]
            kept = [f for f in kept if f.path in live]
        return kept, skipped

    def source(self, spec: QuerySpec, check: bool = True) -> DataFrame:
        """The unfiltered rows of a source, budgets on files, bytes and footers checked."""
        if spec.source in self.tables:
            return self.tables[spec.source]
        kept, skipped = self.files(spec)
        budget = self.budget
        if check:
            budget.check("max_files", len(kept))
            budget.check("max_bytes", sum(f.size for f in kept))
            if budget.max_rows_decoded is not None or budget.max_range_requests is not None:
                planned = explain.planned(self.spark, kept, spec)
                budget.check("max_rows_decoded", planned["rows_decoded"])
                budget.check("max_range_requests", planned["range_requests"])
        empty = not kept
        df = (file_sources.read_hive if spec.hive else file_sources.read_parquet)(self.spark, kept or skipped[:1])
        df = df.coalesce(budget.max_concurrent_reads) if budget.max_concurrent_reads else df
        return df.limit(0) if empty else df

    def relation(self, spec: QuerySpec) -> DataFrame:
        """A source's rows and columns that the policy lets through; spec.where may prune files but is not applied."""
        policy = self.policy or Policy()
        rule = policy.rule
        wheres = [e for e in (rule, spec.where) if e is not None]
        df = self.source(spec.with_(where=None if not wheres else wheres[0] if len(wheres) == 1 else and_(*wheres)))
        if rule is not None:
            df = df.where(Compiler(df.schema).boolean(rule))
        if policy.allowed_columns is not None:
            df = df.select(*[quoted(c) for c in df.columns if c in policy.allowed_columns or c == agg.ORDINAL])
        return df

    def finished(self, out: DataFrame) -> DataFrame:
        """A result whose types and number of rows are allowed."""
        if self.strict_types:
            file_sources.check_schema(out)
        most = self.budget.max_output_rows
        if most is not None and self.timed(lambda: out.limit(most + 1).count()) > most:
            raise EngineError("BUDGET_EXCEEDED", f"max_output_rows: more than {most} rows", limit=most)
        return out

    def buffered(self, df: DataFrame, spec: QuerySpec) -> None:
        """Checks the rows that an order has to hold: all, or the first of them."""
        budget = self.budget
        if not spec.order_by or (budget.max_buffered_rows is None and budget.max_memory_bytes is None):
            return
        rows = df if spec.where is None else df.where(Compiler(df.schema).boolean(spec.where))
        rows = rows.drop(agg.ORDINAL) if spec.limit is None else rows.drop(agg.ORDINAL).limit(spec.offset + spec.limit)
        sized = rows.select(F.octet_length(F.to_json(F.struct(*[F.col(quoted(c)) for c in rows.columns]))).alias("size"))
        n, size = self.timed(lambda: sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first())
        budget.check("max_buffered_rows", n)
        budget.check("max_memory_bytes", size)

    def timed(self, act):
        """act(), stopped when the time budget is spent or the signal is set."""
        budget = self.budget
        if budget.max_elapsed_ms is None and budget.signal is None:
            return act()
        tag, done, began = f"tarn-{uuid.uuid4().hex}", threading.Event(), time.monotonic()
        late = lambda: budget.max_elapsed_ms is not None and (time.monotonic() - began) * 1000 >= budget.max_elapsed_ms
        stopped = lambda: late() or (budget.signal is not None and budget.signal.is_set())

        def watch() -> None:
            while not done.wait(0.02):
                if stopped():
                    self.spark.sparkContext.cancelJobsWithTag(tag)

        if budget.signal is not None and budget.signal.is_set():
            raise EngineError("ABORTED", "stopped by its signal")
        self.spark.sparkContext.addJobTag(tag)
        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            return act()
        except EngineError:
            raise
        except Exception as e:
            if stopped():
                raise EngineError("ABORTED", f"stopped after {round((time.monotonic() - began) * 1000)} ms") from e
            raise
        finally:
            done.set()
            watcher.join()
            self.spark.sparkContext.removeJobTag(tag)


class Query:
    """An immutable query; each method returns another."""

    def __init__(self, lake: Lake, spec: QuerySpec):
        self.lake, self.spec = lake, spec
        self.last_stats: dict | None = None

    def _with(self, **changes) -> Query:
        return Query(self.lake, self.spec.with_(**changes))

    def select(self, *columns: str) -> Query:
        return self._with(select=tuple(columns))

    def project(self, **exprs: Expr) -> Query:
        return self._with(project=tuple(exprs.items()))

    def where(self, condition: Expr) -> Query:
        """Replaces the condition."""
        return self._with(where=condition)

    def distinct(self) -> Query:
        return self._with(distinct=True)

    def order_by(self, *terms: str | Order) -> Query:
        """Names, names with a leading minus for descending order, or Order values."""
        return self._with(order_by=tuple(t if isinstance(t, Order) else Order(t.lstrip("-"), t.startswith("-")) for t in terms))

    def limit(self, n: int) -> Query:
        return self._with(limit=n)

    def offset(self, n: int) -> Query:
        return self._with(offset=n)

    def group_by(self, *keys: str) -> Grouped:
        return Grouped(self, list(keys))

    @property
    def allowed(self) -> QuerySpec:
        return self.lake.policy.apply(self.spec) if self.lake.policy else self.spec

    def frame(self) -> DataFrame:
        """The query as a DataFrame."""
        spec = self.allowed
        df = self.lake.source(spec)
        self.lake.buffered(df, spec)
        return self.lake.finished(row_ops.run(df, spec))

    def join(self, right: Query | DataFrame, left_on, right_on=None, how="inner", max_right_rows=None, right_prefix="right.") -> DataFrame:
        other = right.frame() if isinstance(right, Query) else right
        on = [left_on] if isinstance(left_on, str) else list(left_on)
        return join_frames(self.frame(), other, on, [right_on] if isinstance(right_on, str) else right_on, how, max_right_rows, right_prefix)

    def lookup(self, lookup, left_on: list[str], right_on=None, **more) -> DataFrame:
        return lookup_join(self.frame(), lookup, left_on, right_on, **more)

    # Terminal actions. All but to_local() iterate over rows in partitions, never over a whole result.

    def collect(self) -> list[dict]:
        run = self.lake.runtime
        began = run.now()
        try:
            rows = [r.asDict() for r in self.lake.timed(lambda: self.frame().collect())]
        except EngineError as e:
            run.metrics.count("query.refused", 1, code=e.code)
            run.log.info("refused: %s", e)
            raise
        self.last_stats = {"query_id": run.new_id("q_"), "elapsed_ms": round(run.now() - began, 3), "rows_returned": len(rows)}
        run.metrics.timing("query.collect", self.last_stats["elapsed_ms"], source=self.spec.source)
        return rows

    def to_local(self) -> Iterator[dict]:
        """Rows, a partition at a time; the time budget counts while they are fetched, one by one."""
        rows = iter(self.frame().toLocalIterator())
        while (r := self.lake.timed(lambda: next(rows, None))) is not None:
            yield r.asDict()

    def batches(self, size: int = 4096) -> Iterator[list[dict]]:
        held: list[dict] = []
        for r in self.to_local():
            held.append(r)
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held

    def first(self) -> dict | None:
        found = self.lake.timed(lambda: self.frame().head(1))
        return found[0].asDict() if found else None

    def count(self) -> int:
        """Rows after distinct, offset and limit."""
        return self.lake.timed(lambda: self.frame().count())

    def to_arrow(self):
        return self.lake.timed(lambda: self.frame().toArrow())

    def arrow_batches(self) -> Iterator:
        """Record batches, a partition at a time: no whole result is held."""
        from tarn.sinks import arrow_batches

        return arrow_batches(self.frame())

    def stream_ndjson(self) -> Iterator[str]:
        from tarn.sinks import ndjson

        return ndjson(self.frame())

    def stream_json(self) -> Iterator[str]:
        from tarn.sinks import json_array

        return json_array(self.frame())

    def stream_csv(self, header: bool = True) -> Iterator[str]:
        from tarn.sinks import csv

        return csv(self.frame(), header)

    def stats(self) -> dict:
        """Runs the query for its numbers: what was planned, skipped, decoded, matched and returned."""
        lake, spec = self.lake, self.allowed
        matched, returned = Observation(), Observation()
        kept, skipped = ([], []) if spec.source in lake.tables else lake.files(spec)
        hits, misses = explain.FOOTERS.hits, explain.FOOTERS.misses
        planned = explain.planned(lake.spark, kept, spec)
        began = lake.runtime.now()
        df = lake.source(spec)
        rows = df if spec.where is None else df.where(Compiler(df.schema).boolean(spec.where))
        out = row_ops.run(rows.observe(matched, F.count(F.lit(1)).alias("rows")), spec.with_(where=None)).observe(returned, F.count(F.lit(1)).alias("rows"))
        lake.timed(lambda: out.write.format("noop").mode("overwrite").save())
        sliced = spec.limit is not None and not spec.order_by and not spec.distinct
        return {
            "query_id": lake.runtime.new_id("q_"),
            "elapsed_ms": lake.runtime.now() - began,
            "manifests_read": 0,
            "manifests_skipped": 0,
            "files_planned": len(kept),
            "files_read": len(kept),
            "files_skipped": len(skipped),
            **planned,
            "columns_read": sorted(spec.columns() - {"*"}) if spec.select != ("*",) and (spec.select or spec.project) else [c for c in df.columns if c != agg.ORDINAL],
            "rows_matched": None if sliced else matched.get["rows"],
            "rows_returned": returned.get["rows"],
            "cache_hits": explain.FOOTERS.hits - hits,
            "cache_misses": explain.FOOTERS.misses - misses,
            "bytes_planned": sum(f.size for f in kept),
        }

    # Operator state: what a query over more sources can go on from.

    def _stateful(self, name: str, limited: bool) -> QuerySpec:
        spec = self.allowed
        if not spec.order_by:
            raise type_error(f"{name} needs an order")
        if limited and spec.limit is None:
            raise type_error(f"{name} needs a limit")
        if spec.distinct:
            raise type_error(f"{name} does not take distinct queries")
        return spec.with_(where=self.spec.where)  # the policy's own condition is relation()'s

    def top_k_with_state(self, state: dict | None = None, folder: str | None = None) -> tuple[DataFrame, dict]:
        """The first rows of this query and of those behind the state, and the state to go on from."""
        spec = self._stateful("top_k_with_state", True)
        df = self.lake.relation(spec)
        self.lake.buffered(df, spec)
        return op_state.ordered(self.lake.spark, df, spec, "top-k", state, folder)

    def sort_with_state(self, state: dict | None = None, folder: str | None = None) -> tuple[DataFrame, dict]:
        """All rows of this query and of those behind the state in order, and the state to go on from."""
        spec = self._stateful("sort_with_state", False)
        df = self.lake.relation(spec)
        self.lake.buffered(df, spec.with_(limit=None, offset=0))
        return op_state.ordered(self.lake.spark, df, spec, "sort", state, folder)

    def explain(self) -> dict:
        spec = self.allowed
        if spec.source in self.lake.tables:
            kept, skipped, partitions = [], [], set()
        else:
            kept, skipped = self.lake.files(spec)
            partitions = set(file_sources.partition_values(kept[0].path)) if kept and spec.hive else set()
        read = {o.column for o in spec.order_by} | set(spec.select or ())
        for e in [spec.where, *[e for _, e in spec.project]]:
            read |= e.columns() if e is not None else set()
        df = self.frame()
        return {
            "files_planned": len(kept),
            "files_skipped": len(skipped),
            "columns": sorted(read),
            "predicates": explain.classify(spec.where, partitions, set(getattr(self.lake.sidecars.get(spec.source), "columns", ()))),
            "plan": df._jdf.queryExecution().explainString(self.lake.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")),
        }

    def plan_tasks(self) -> list[tasks.Task]:
        spec = self.allowed
        kept, _ = self.lake.files(spec)
        return tasks.plan(kept, spec.select, spec.where, file_sources.partition_values if spec.hive else lambda _: {})

    def task_manifest(self, job: str = "job") -> dict:
        return tasks.manifest(self.plan_tasks(), job)

    # Slices.

    def bookmark(self, row_offset: int = 0) -> resume.Bookmark:
        files = [] if self.spec.source in self.lake.tables else self.lake.files(self.allowed)[0]
        return resume.Bookmark(self.spec.to_json(), row_offset, resume.plan_fingerprint(files))

    def run_slice(self, max_rows: int, bookmark: dict | resume.Bookmark | None = None) -> tuple[list[dict], dict | None]:
        """The next max_rows rows, and a bookmark if there are more."""
        if max_rows < 1:
            raise EngineError("VALIDATION_ERROR", "a slice has one row at least")
        done = 0
        if bookmark is not None:
            mark = bookmark if isinstance(bookmark, resume.Bookmark) else resume.Bookmark.from_json(bookmark)
            if mark.query != json.loads(json.dumps(self.spec.to_json())) and mark.query != self.spec.to_json():
                raise EngineError("BOOKMARK_INVALID", "the bookmark is of another query")
            if self.spec.source not in self.lake.tables:
                resume.check_fresh(mark, self.lake.files(self.allowed)[0])
            done = mark.row_offset
        spec = self.spec
        left = None if spec.limit is None else max(0, spec.limit - done)
        take = max_rows + 1 if left is None else min(max_rows + 1, left)
        rows = Query(self.lake, spec.with_(offset=spec.offset + done, limit=take)).collect() if take else []
        more = len(rows) > max_rows
        rows = rows[:max_rows]
        mark = self.bookmark(done + len(rows)).to_json() if more else None
        if mark and self.lake.runtime.queue:
            self.lake.runtime.queue(mark)
        return rows, mark

    def resumable_batches(self, bookmark_every: int) -> Iterator[tuple[list[dict], dict | None]]:
        mark = None
        while True:
            rows, mark = self.run_slice(bookmark_every, mark)
            yield rows, mark
            if mark is None:
                return


class Grouped:
    """A query's groups; aggregate() makes the rows."""

    def __init__(self, query: Query, keys: list[str]):
        self.query, self.keys = query, keys

    def aggregate(self, spec: dict[str, Aggregate | tuple | str], having: Expr | None = None, order_by: tuple = (), limit=None, offset: int = 0, max_groups=None) -> DataFrame:
        """spec: {alias: Aggregate, (op, column), (op, expression) or "count"}."""
        df, made = self._input(spec)
        q = self.query.allowed
        orders = tuple(o if isinstance(o, Order) else Order(o.lstrip("-"), o.startswith("-")) for o in order_by)
        # A limit of the query itself is the policy's: the builder's own does not reach groups.
        limit = (self.query.lake.policy or Policy()).most(limit)
        out = self.query.lake.timed(lambda: agg.aggregate(df if q.where is None else df.where(Compiler(df.schema).boolean(q.where)), self.keys, made, having, orders, limit, offset, max_groups))
        return self.query.lake.finished(out)

    def aggregate_with_state(self, spec: dict, state: dict | None = None, folder: str | None = None) -> tuple[DataFrame, dict]:
        """The groups of this query and of those behind the state, and the state to go on from."""
        df, made = self._input(spec)
        q = self.query.allowed
        df = df if q.where is None else df.where(Compiler(df.schema).boolean(q.where))
        out, after = op_state.aggregated(self.query.lake.spark, df, self.keys, made, state, folder)
        return self.query.lake.finished(out), after

    def _input(self, spec: dict) -> tuple[DataFrame, dict[str, Aggregate]]:
        """The source and the aggregates, whose columns are all allowed and of supported types."""
        made = {}
        for alias, a in spec.items():
            if isinstance(a, str):
                a = Aggregate(a)
            elif isinstance(a, tuple):
                op, x, *rest = a
                a = Aggregate(op, None if isinstance(x, Expr) else x, x if isinstance(x, Expr) else None, *rest)
            made[alias] = a
        lake, used = self.query.lake, set(self.keys)
        for a in made.values():
            used |= {a.column} - {None} | (a.expr.columns() if a.expr is not None else set())
        if lake.policy:
            lake.policy.check(used)
        df = lake.source(self.query.allowed)
        if lake.strict_types:
            file_sources.check_schema(df, used)
        return df, made
