"""Portable work units: task manifests, their splitting, checkpoints and output manifests."""

from __future__ import annotations

import json
import threading
from collections import deque
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.errors import EngineError
from tarn.expr import Expr, from_json
from tarn.operators.aggregate import ORDINAL
from tarn.plans import explain
from tarn.plans.compile import Compiler, quoted
from tarn.plans.spec import fingerprint, stable_json


@dataclass(frozen=True)
class Task:
    """One file, or some of its rows, with what to read of it. Plain JSON."""

    path: str
    size: int
    modified: int
    ranges: tuple[tuple[int, int], ...] = ()
    columns: tuple[str, ...] | None = None
    where: dict | None = None
    partition: dict[str, str] = field(default_factory=dict)

    def to_json(self) -> dict:
        return json.loads(json.dumps(asdict(self)))

    @classmethod
    def from_json(cls, data: dict) -> Task:
        return cls(**data | {"ranges": tuple(tuple(r) for r in data["ranges"]), "columns": None if data["columns"] is None else tuple(data["columns"])})


def manifest(tasks: list[Task], job: str) -> dict:
    """A fingerprinted list of tasks with stable ids."""
    plain = [t.to_json() for t in tasks]
    snapshot = fingerprint([[t.path, t.modified, t.size] for t in tasks])
    ids = [f"{job}-task-{i:06d}-{fingerprint(p)[:8]}" for i, p in enumerate(plain)]
    return {"version": 1, "job": job, "snapshot": snapshot, "fingerprint": fingerprint([1, snapshot, plain]), "tasks": [{"id": n, **p} for n, p in zip(ids, plain, strict=True)]}


def plan(files, columns, where: Expr | None, partition_of: Callable[[str], dict]) -> list[Task]:
    return [Task(f.path, f.size, f.modified, (), None if columns is None else tuple(columns), None if where is None else where.to_json(), partition_of(f.path)) for f in files]


def split(task: Task, max_row_groups: int = 1, max_rows: int | None = None) -> list[Task]:
    """Units of a task by row groups that its filter keeps, or by rows inside them."""
    where = None if task.where is None else from_json(task.where)
    groups = explain.row_groups(task.path, where)["row_groups"]
    out = []
    for i in range(0, len(groups), max_row_groups):
        ranges = [(g["row_start"], g["row_end"]) for g in groups[i : i + max_row_groups]]
        if max_rows is None:
            out.append(replace(task, ranges=tuple(ranges)))
        else:
            out += [replace(task, ranges=((a, min(a + max_rows, end)),)) for start, end in ranges for a in range(start, end, max_rows)]
    return out


def joined_ranges(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same rows in ascending ranges that do not touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def together(units: Iterable[Task]) -> list[Task]:
    """The rows of units in as few: those that follow one another in a file become one.

    Spark reads a file as a whole to find a range of its rows, so many units of a file are
    read by one scan, which it splits itself. Units that overlap or go back stay apart.
    """
    held: list[tuple[Task, list[tuple[int, int]]]] = []
    for unit in units:
        own, whole = joined_ranges(unit.ranges), replace(unit, ranges=())
        last = held[-1] if held else None
        if last and own and last[1] and last[0] == whole and last[1][-1][1] <= own[0][0]:
            if last[1][-1][1] == own[0][0]:
                own[0] = (last[1].pop()[0], own[0][1])
            last[1].extend(own)
        else:
            held.append((whole, own))
    return [replace(task, ranges=tuple(ranges)) for task, ranges in held]


def _inside(row: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a row is in one of ascending ranges, by halves."""
    if len(ranges) == 1:
        return (row >= ranges[0][0]) & (row < ranges[0][1])
    middle = len(ranges) // 2
    return F.when(row < ranges[middle][0], _inside(row, ranges[:middle])).otherwise(_inside(row, ranges[middle:]))


def scan(spark: SparkSession, task: Task, ordinal: bool = False) -> DataFrame:
    """The rows of one unit, with their places if asked for."""
    df = spark.read.parquet(task.path)
    row = F.col("_metadata.row_index")
    place = [F.struct(F.col("_metadata.file_path").alias("path"), row.alias("row")).alias(ORDINAL)] if ordinal else []
    for k, v in task.partition.items():
        if k not in df.columns:
            df = df.withColumn(k, F.lit(v))
    if task.ranges:
        df = df.where(_inside(row, joined_ranges(task.ranges)))
    if task.where is not None:
        df = df.where(Compiler(df.schema).boolean(from_json(task.where)))
    return df.select(*[quoted(c) for c in (df.columns if task.columns is None else task.columns)], *place)


def scan_units(spark: SparkSession, units: Iterable[Task]) -> DataFrame:
    """The rows of many units; a file's units are read by one scan."""
    made = [scan(spark, u) for u in together(units)]
    if not made:
        raise EngineError("VALIDATION_ERROR", "there are no units")
    while len(made) > 1:  # by pairs, since a chain of unions is analysed anew with each
        made = [made[i].union(made[i + 1]) if i + 1 < len(made) else made[i] for i in range(0, len(made), 2)]
    return made[0]


def fan_in(inputs: Iterable, run: Callable, reduce: Callable, initial, max_concurrent: int = 4, boundary: Callable | None = None, max_buffered: int = 16):
    """run() for each input on some threads; results are reduced in the inputs' order.

    An input is taken only when fewer than max_buffered results are under way or wait for their turn.
    """
    if max_concurrent < 1 or max_buffered < 1:
        raise EngineError("VALIDATION_ERROR", "one unit at least runs, and one result at least is held")
    state, waiting, rest = initial, deque(), iter(inputs)
    with ThreadPoolExecutor(max_concurrent) as pool:
        try:
            while True:
                while len(waiting) < max_buffered and (x := next(rest, waiting)) is not waiting:
                    waiting.append(pool.submit(lambda x=x: run(boundary(x) if boundary else x)))
                if not waiting:
                    return state
                state = reduce(state, waiting.popleft().result())
        finally:
            for left in waiting:
                left.cancel()


def aggregate(spark: SparkSession, units: list[Task], keys: list[str], spec: dict, folder: str | None = None, **more) -> DataFrame:
    """Groups over work units, from partial aggregates of each file's; spec: {alias: Aggregate}."""
    from tarn.operators.state import aggregate_units

    return aggregate_units(spark, together(units), lambda unit: scan(spark, unit, ordinal=True), keys, spec, folder, **more)


def json_boundary(value):
    """A value as another process would receive it."""
    return json.loads(stable_json(value))


STATES = ("planned", "running", "output-written", "manifest-recorded", "complete")


@dataclass(frozen=True)
class Checkpoint:
    task_id: str
    state: str
    idempotency_key: str
    updated_ms: int = 0
    outputs: tuple = ()


def transition(old: Checkpoint | None, new: Checkpoint, stale_after_ms: int | None = None) -> Checkpoint:
    """One step forward; the same state and key again changes nothing; a stale task may start over."""
    if new.state not in STATES:
        raise EngineError("VALIDATION_ERROR", f"no state {new.state}")
    if old is None:
        if new.state != "planned":
            raise EngineError("VALIDATION_ERROR", "a task starts as planned")
        return new
    if old.state == new.state and old.idempotency_key == new.idempotency_key:
        return old
    if old.state == "complete":
        raise EngineError("VALIDATION_ERROR", "the task is complete")
    if stale_after_ms is not None and new.state == "running" and new.updated_ms - old.updated_ms >= stale_after_ms:
        return new
    if old.idempotency_key != new.idempotency_key or STATES.index(new.state) != STATES.index(old.state) + 1:
        raise EngineError("VALIDATION_ERROR", f"no way from {old.state} to {new.state}")
    return new


class CheckpointStore:
    """Checkpoints in memory, changed under a lock."""

    def __init__(self):
        self.items: dict[str, Checkpoint] = {}
        self.lock = threading.Lock()

    def get(self, task_id: str) -> Checkpoint | None:
        return self.items.get(task_id)

    def advance(self, new: Checkpoint, stale_after_ms: int | None = None) -> Checkpoint:
        with self.lock:
            self.items[new.task_id] = transition(self.items.get(new.task_id), new, stale_after_ms)
            return self.items[new.task_id]


def output_manifest(job: str, entries: list[dict]) -> dict:
    """The files that a job wrote, in a stable order."""
    files = sorted(entries, key=lambda e: e["path"])
    return {"version": 1, "job": job, "files": files, "rows": sum(e["rows"] for e in files), "fingerprint": fingerprint(files)}


def manifest_from_checkpoints(job: str, store: CheckpointStore) -> dict:
    done = [c for c in store.items.values() if STATES.index(c.state) >= STATES.index("output-written")]
    return output_manifest(job, [e for c in done for e in c.outputs])
