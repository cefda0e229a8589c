"""Best-fit packing of documents into sequences, improved by bin completion.

Documents become pieces of at most CAPACITY tokens. How many pieces there are of
each length is all that packing needs: at most CAPACITY numbers reach the driver
at any size of the input. There, best fit gives a first solution, and a lower
bound may prove it best. Otherwise a depth-first search completes one sequence
after another: it takes the largest piece left, enumerates undominated fillings
around it, applies one to as many equal sequences as the counts allow, and turns
back when the waste so far rules out an improvement; better solutions replace the
best-fit one. The search ends with a proof, or after NODES steps; around one piece it
grows GROWN partial fillings and follows the FILLINGS fullest, so without a proof by the
lower bound a better packing may exist. Every result carries the lower bound, so that
callers see what is proven. The plan is a list of patterns (lengths, times used), of a
size that depends on CAPACITY alone.

Pieces then find their place without meeting in one task: they are ranked among
those of their length in cells of bounded size, and the rank picks the pattern's
copy and the offset in it.

Defined results: null texts are empty and give the end token alone; repeated
rows are packed each; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.common import Workspace

CAPACITY = 1024
#: Search steps of the branch and bound; fillings it follows around one piece, and partial ones it grows for them.
NODES, FILLINGS, GROWN = 8_000, 12, 480
CELL_ROWS = 4_000

Pattern = tuple[int, list[tuple[int, int]]]  # times used, [(length, pieces of it in one sequence)]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: the best of the Martello-Toth bounds over all thresholds."""
    lengths = np.array(sorted(counts), dtype=object)
    if not len(lengths):
        return 0
    n = [counts[x] for x in lengths]
    best = -(-sum(x * c for x, c in zip(lengths, n, strict=True)) // capacity)
    for k in [x for x in lengths if 2 * x <= capacity]:
        big = sum(c for x, c in zip(lengths, n, strict=True) if x > capacity - k)
        mid = [(x, c) for x, c in zip(lengths, n, strict=True) if 2 * x > capacity and x <= capacity - k]
        small = sum(x * c for x, c in zip(lengths, n, strict=True) if k <= x and 2 * x <= capacity)
        many = sum(c for _, c in mid)
        room = many * capacity - sum(x * c for x, c in mid)
        best = max(best, big + many + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, longest first: equal sequences are filled together."""
    groups: dict[int, list[tuple[int, list]]] = {}  # room left -> (times, pieces)
    rooms: list[int] = []

    def put(room, times, pieces):
        if times:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append((times, pieces))

    for x in sorted((k for k, c in counts.items() if c), reverse=True):
        left = counts[x]
        while left:
            at = bisect.bisect_left(rooms, x)
            if at == len(rooms):
                times, pieces, room = -(-left // (capacity // x)), [], capacity
            else:
                room = rooms[at]
                times, pieces = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            each = room // x  # the room that is left behind a piece fits the next one tighter than any other
            full = min(times, left // each)
            put(room - each * x, full, [*pieces, (x, each)])
            left -= full * each
            rest = times - full
            if rest and left and left < each:
                put(room - left * x, 1, [*pieces, (x, left)])
                left, rest = 0, rest - 1
            if pieces:
                put(room, rest, pieces)
    return [g for room in rooms for g in groups[room]]


def fillings(counts: np.ndarray, lengths: list[int], room: int, width: int = FILLINGS, budget: int = GROWN) -> list[tuple[int, ...]]:
    """Undominated fillings of room, the fullest first.

    A filling that leaves room for another piece is dominated, as is one whose
    pieces can be swapped one by one for pieces at least as long.
    """
    found: list[tuple[int, tuple[int, ...]]] = []

    def grow(room: int, top: int, taken: tuple[int, ...]) -> None:
        nonlocal budget
        at = bisect.bisect_right(lengths, min(room, top)) - 1
        fits = bisect.bisect_right(lengths, room) - 1
        if budget <= 0:
            return
        budget -= 1
        open_ = any(counts[lengths[i]] > taken.count(lengths[i]) for i in range(fits + 1))
        if not open_:
            found.append((room, taken))
            return
        tried = 0
        while at >= 0 and tried < width and budget > 0:
            x = lengths[at]
            if counts[x] > taken.count(x):
                grow(room - x, x, (*taken, x))
                tried += 1
                if found and found[-1][0] == 0 and len(found) >= width:
                    return
            at -= 1

    grow(room, room, ())
    found = sorted(set(found), key=lambda f: (f[0], len(f[1])))
    kept: list[tuple[int, ...]] = []
    for _, f in found:
        if not any(len(g) == len(f) and all(a >= b for a, b in zip(g, f, strict=True)) for g in kept):
            kept.append(f)
    return kept[:width]


def complete(counts: dict[int, int], capacity: int, incumbent: list[Pattern], bound: int, nodes: int = NODES) -> list[Pattern]:
    """The best packing that the search finds, at least as good as the incumbent."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for x, c in counts.items():
        left[x] = c
    total = sum(x * c for x, c in counts.items())
    best, most = incumbent, sum(t for t, _ in incumbent)
    path: list[tuple[int, dict[int, int], int]] = []
    stack: list[Iterator] = []

    def children() -> Iterator:
        lengths = np.flatnonzero(left).tolist()
        big = lengths[-1]
        left[big] -= 1
        made = fillings(left, np.flatnonzero(left).tolist(), capacity - big)
        left[big] += 1
        for f in made:
            need: dict[int, int] = {}
            for x in (big, *f):
                need[x] = need.get(x, 0) + 1
            yield need, capacity - big - sum(f)

    used = waste = 0
    stack.append(children())
    while stack and nodes > 0:
        nodes -= 1
        spare = (most - 1) * capacity - total  # waste that a better packing may have
        step = next(stack[-1], None)
        if step is not None:
            need, lost = step
            times = min(int(left[x]) // k for x, k in need.items())
            if lost:
                times = min(times, (spare - waste) // lost)
            if times < 1:
                continue
            for x, k in need.items():
                left[x] -= times * k
            path.append((times, need, lost))
            used, waste = used + times, waste + times * lost
            if left.any():
                stack.append(children())
                continue
            if used < most:
                best, most = [(t, sorted(n.items(), reverse=True)) for t, n, _ in path], used
                if most <= bound:
                    return best
        else:
            stack.pop()
        if path:  # turn back
            times, need, lost = path.pop()
            for x, k in need.items():
                left[x] += times * k
            used, waste = used - times, waste - times * lost
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], int]:
    """Patterns that hold every piece, and the lower bound of their number of sequences."""
    counts = {int(k): int(v) for k, v in counts.items() if v}
    bound, first = lower_bound(counts, capacity), best_fit(counts, capacity)
    if sum(t for t, _ in first) <= bound:
        return first, bound
    return complete(counts, capacity, first, bound), bound


class Tokenizer:
    """Byte-level BPE; special strings in a text become their special tokens."""

    def __init__(self, ranks_file: str, spec_file: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        with open(spec_file, encoding="utf-8") as f:
            self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.encoding.encode(text, allowed_special="all")
        return self.encoding.encode_ordinary(text)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter."""
    first = n - (-(-n // capacity) - 1) * capacity
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def pieces(docs: DataFrame, ranks_file: str, spec_file: str, end: int = 2, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of docs (doc_id, text); ids too if asked for."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    id_type = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches):
        import pyarrow as pa

        tokenizer = Tokenizer(ranks_file, spec_file)
        for batch in batches:
            at, rows = [], {"piece": [], "start": [], "length": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*tokenizer.ids(text.as_py() or ""), end], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    at.append(i)
                    for name, x in (("piece", k), ("start", start), ("length", length), ("ids_crc32", zlib.crc32(own.tobytes())), ("ids", own.astype(np.int64))):
                        if name in rows:
                            rows[name].append(x)
            kinds = {"piece": pa.int32(), "ids": pa.list_(pa.int64())}
            arrays = [batch.column(0).take(pa.array(at, type=pa.int64())), *[pa.array(v, type=kinds.get(k, pa.int64())) for k, v in rows.items()]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *rows])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _literal(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def place(cut_pieces: DataFrame, capacity: int = CAPACITY, work: Workspace | None = None) -> DataFrame:
    """The pieces with sequence_id, offset and least_sequences, the lower bound of the number of sequences.

    cut_pieces should be a written table: it is read three times.
    """
    spark = cut_pieces.sparkSession
    counts = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns, bound = plan(counts, capacity)
    slots, base, rank = {}, 0, dict.fromkeys(counts, 0)
    for times, content in patterns:
        offset = 0
        for length, each in content:
            slots.setdefault(length, []).append({"lo": rank[length], "hi": rank[length] + times * each, "each": each, "base": base, "at": offset})
            rank[length] += times * each
            offset += length * each
        base += times
    # A list for each length; the patterns, and so the lists, are bounded by the capacity.
    where = _literal(
        spark,
        [{"length": x, "cells": -(-counts[x] // CELL_ROWS), "slots": s} for x, s in slots.items()],
        "length:bigint,cells:int,slots:array<struct<lo:bigint,hi:bigint,each:bigint,base:bigint,at:bigint>>",
    )
    dealt = cut_pieces.join(F.broadcast(where), "length").withColumn("_cell", F.pmod(F.xxhash64("doc_id", "piece"), F.col("cells")))
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "_cell").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    order = Window.partitionBy("length", "_cell").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.select(*cut_pieces.columns, "_cell").withColumn("_rank", F.row_number().over(order) - 1)
    ranked = ranked.join(offsets, ["length", "_cell"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    slot = F.filter("slots", lambda s: (s["lo"] <= F.col("_rank")) & (F.col("_rank") < s["hi"]))
    found = ranked.join(F.broadcast(where), "length").withColumn("_slot", F.get(slot, F.lit(0)))
    nth = F.col("_rank") - F.col("_slot.lo")
    placed = found.withColumns(
        {
            "sequence_id": (F.col("_slot.base") + F.floor(nth / F.col("_slot.each"))).cast("long"),
            "offset": (F.col("_slot.at") + (nth % F.col("_slot.each")) * F.col("length")).cast("long"),
        }
    )
    return placed.select(*cut_pieces.columns, "sequence_id", "offset", F.lit(bound).cast("long").alias("least_sequences"))


def pack_documents(docs: DataFrame, ranks_file: str, spec_file: str, end: int = 2, capacity: int = CAPACITY, work: Workspace | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece of docs with its place in the fewest sequences that the search finds."""
    work = work or Workspace(docs.sparkSession, "packing")
    return place(work.table(pieces(docs, ranks_file, spec_file, end, capacity, with_ids), "pieces"), capacity)
