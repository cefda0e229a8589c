"""Exact top-k inner products from an impact-ordered index, score at a time.

Components become integers, and vectors are dealt at random into blocks. A block's
index is built once and written: every dimension has posting segments, one for each
quantised level of the component, that list the vectors whose component lies in it.
For a query, a segment's impact is the size of the query's component times the
largest component in the segment. A query processes a block's segments by its own
descending impact and adds to accumulators. What is still unread bounds each score
from both sides: a vector is out once its upper bound is below the k-th best lower
bound. Processing stops only when few enough vectors are left, or nothing is unread,
and exactly these possible members are rescored from their full vectors. Block
results are merged by score. Nothing is dropped on an estimate, so results are exact.

The first block is processed before all others; the k-th best score it gives is a
query's floor from then on, and a block whose bounds stay below it is skipped.

Work is dealt by (block, group of queries), each of a bounded size and dealt at
random, so memory does not grow with the input and equal vectors spread. Each block
is sent to every group, and each query to every block: with queries a fixed share of
the rows, work grows by the square of the input, as all exact search over vectors
without structure does.

Arithmetic is in 64 bits where the block's and the query's components prove that no
sum can pass them, else in whole numbers of any length: no component is clamped.

Defined results: null vectors, vectors with null or non-finite components and rows
with a null id take no part; missing components of shorter vectors count as 0; every
row that asks is answered, also where rows repeat an id, and only its own row is no
candidate; with fewer than k candidates all are returned; equal scores are ranked by
id; a score beyond 64 bits is ranked exactly and reported as the nearest long.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import Workspace

SCALE = 256
#: Levels of a dimension in a block; components of a block; queries of a group.
LEVELS, BLOCK_CELLS, GROUP_QUERIES = 64, 1 << 20, 256
#: Shares of a block's postings that are read before the bounds are tested.
ROUNDS = (0.6, 0.7, 0.8, 0.9, 1.0)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Scores beyond 64 bits are ordered as bytes of this length, shifted to be positive.
KEY_BYTES = 300


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v, the components as doubles, of the rows that take part."""
    x = F.col(vector)
    fits = x.isNotNull() & F.col(vec_id).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(fits).select(F.col(vec_id).cast("long").alias("vec_id"), x.cast("array<double>").alias("v"))


def scaled(vectors: list, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of rows of doubles, as 64-bit integers where all of them fit, else as Python's."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    with np.errstate(over="ignore"):
        whole = np.floor(out * scale)
    if np.abs(whole).max(initial=0) < 1 << 62:
        return whole.astype(np.int64)
    exact = [[int(w) if np.isfinite(w) else int(x) * scale for w, x in zip(a, b, strict=True)] for a, b in zip(whole.tolist(), out.tolist(), strict=True)]
    return np.array(exact, dtype=object)


def _pack(a: np.ndarray) -> tuple[str, bytes]:
    """An array of integers in the narrowest form that holds it."""
    if a.dtype == object:
        return "text", ",".join(map(str, a.ravel())).encode()
    most = int(np.abs(a).max(initial=0))
    kind = next(k for k, bits in (("int16", 15), ("int32", 31), ("int64", 64)) if most < 1 << bits)
    return kind, a.astype(kind).tobytes()


def _unpack(kind: str, data: bytes) -> np.ndarray:
    if kind == "text":
        return np.array([int(x) for x in data.decode().split(",")], dtype=object)
    return np.frombuffer(data, dtype=kind).astype(np.int64)


class BlockIndex:
    """The impact-ordered segments of one block's vectors, and the vectors."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, postings: np.ndarray | None = None, starts: np.ndarray | None = None, dims: np.ndarray | None = None):
        self.rows, self.ids, self.vectors = rows, ids, vectors
        if postings is None:
            postings, starts, dims = self._build(vectors)
        self.postings, self.starts, self.dims = postings, starts, dims  # starts and dims: of each segment
        lengths = np.diff(np.append(starts, len(postings)))
        self.ends, self.lengths = starts + lengths, lengths
        self.values = vectors[postings, np.repeat(dims, lengths)] if len(postings) else vectors.ravel()
        # Exact least and greatest component of each segment, whose postings are sorted by it.
        self.low, self.high = (self.values[starts], self.values[self.ends - 1]) if len(starts) else (self.values, self.values)
        self.size = np.maximum(np.abs(self.low), np.abs(self.high))
        self.first = np.flatnonzero(np.concatenate([[True], dims[1:] != dims[:-1]])) if len(dims) else dims

    @staticmethod
    def _build(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, width = vectors.shape
        postings, starts, dims = [], [], []
        for d in range(width if n else 0):
            own = vectors[:, d]
            order = np.argsort(own, kind="stable")
            step = max(1, (int(own[order[-1]]) - int(own[order[0]])) // LEVELS)
            level = own[order] // step
            first = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1]]))
            postings.append(order)
            starts.append(first + d * n)
            dims.append(np.full(len(first), d))
        return tuple(np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (postings, starts, dims))

    def record(self) -> dict:
        kind, data = _pack(self.vectors)
        arrays = {"rows": self.rows, "ids": self.ids, "postings": self.postings.astype(np.int32), "starts": self.starts.astype(np.int32), "dims": self.dims.astype(np.int32)}
        return {"width": self.vectors.shape[1], "kind": kind, "vectors": data, **{k: v.tobytes() for k, v in arrays.items()}}

    @classmethod
    def of(cls, record: dict) -> BlockIndex:
        rows, ids = (np.frombuffer(record[k], dtype=np.int64) for k in ("rows", "ids"))
        postings, starts, dims = (np.frombuffer(record[k], dtype=np.int32).astype(np.intp) for k in ("postings", "starts", "dims"))
        return cls(rows, ids, _unpack(record["kind"], record["vectors"]).reshape(len(rows), record["width"]), postings, starts, dims)

    def top(self, query: np.ndarray, k: int, own_row: int = -1, floor: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """ids and scores of the k best candidates, less those below the floor, and how many segments were read."""
        n, width = self.vectors.shape
        whole = np.zeros(width, dtype=query.dtype)
        whole[: min(width, len(query))] = query[:width]
        reach = int(np.abs(self.size).max(initial=0)) * int(np.abs(whole).max(initial=0)) * max(1, width)
        wide = reach >= 1 << 61
        q, vectors, values, low, high, size = (x.astype(object) if wide else x for x in (whole, self.vectors, self.values, self.low, self.high, self.size))
        weight = q[self.dims]
        a, b = weight * low, weight * high
        most, least, impact = np.maximum(a, b), np.minimum(a, b), np.abs(weight) * size
        order = np.argsort(-impact, kind="stable")
        done = np.cumsum(self.lengths[order])
        cuts = [0, *np.searchsorted(done, [share * len(self.postings) for share in ROUNDS[:-1]]).tolist(), len(order)]
        acc, unread = np.zeros(n, dtype=q.dtype), np.ones(len(order), dtype=bool)
        candidates = self.rows != own_row
        alive, read, few = candidates, 0, max(k, n // 8)
        for until in [0, *cuts[1:]]:
            part = np.sort(order[read:until])
            if len(part):  # neighbouring segments of a dimension are one stretch of postings
                breaks = np.flatnonzero((part[1:] != part[:-1] + 1) | (self.dims[part[1:]] != self.dims[part[:-1]])) + 1
                for i, j in zip([0, *breaks.tolist()], [*breaks.tolist(), len(part)], strict=True):
                    at = slice(self.starts[part[i]], self.ends[part[j - 1]])
                    acc[self.postings[at]] += q[self.dims[part[i]]] * values[at]
                unread[part] = False
            read = max(read, until)
            # What a dimension can still add: nothing if a vector's own segment was read.
            up = np.maximum.reduceat(np.where(unread, most, 0), self.first).sum() if len(order) else 0
            down = np.minimum.reduceat(np.where(unread, least, 0), self.first).sum() if len(order) else 0
            bar = floor
            if int(candidates.sum()) > k and read:
                kth = np.sort(acc[candidates])[-k] + down if wide else np.partition(acc[candidates], -k)[-k] + down
                bar = kth if bar is None else max(bar, kth)
            if bar is not None:
                alive = candidates & (acc + up >= bar).astype(bool)
            if int(alive.sum()) <= few:
                break
        left = np.flatnonzero(alive)
        scores, ids = (vectors[left] * q).sum(axis=1) if wide else vectors[left] @ q, self.ids[left]
        best = sorted(range(len(left)), key=lambda i: (-scores[i], ids[i]))[:k] if wide else np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best], read


def _sized(df: DataFrame, block_rows: int | None) -> tuple[int, int]:
    """How many blocks and groups of queries the rows need."""
    n, asking, width = df.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("v"))).first()
    block_rows = block_rows or max(64, min(1 << 15, BLOCK_CELLS // max(1, width or 1)))
    return max(1, -(-n // block_rows)), max(1, -(-asking // GROUP_QUERIES))


RECORD = "block int, width int, kind string, vectors binary, rows binary, ids binary, postings binary, starts binary, dims binary"
FOUND = "row long, query_id long, vec_id long, score long, beyond binary"


def build(rows: DataFrame, blocks: int) -> DataFrame:
    """A record of the index for each block of rows (row, vec_id, v)."""

    def make(key, table):
        import pyarrow as pa

        vectors = scaled(table.column("v").to_pylist())
        made = BlockIndex(table.column("row").to_numpy(), table.column("vec_id").to_numpy(), vectors).record()
        kinds = {"block": pa.int32(), "width": pa.int32(), "kind": pa.string()}
        return pa.table({c: pa.array([v], type=kinds.get(c, pa.binary())) for c, v in ({"block": key[0].as_py()} | made).items()})

    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    return rows.select(block.alias("block"), "row", "vec_id", "v").groupBy("block").applyInArrow(make, RECORD)


def _answers(index: DataFrame, blocks: range, asked: DataFrame, groups: int, k: int) -> DataFrame:
    """FOUND of each asked row (row, vec_id, v, group, floor) in each of the blocks."""

    def answer(key, left, right):
        import pyarrow as pa

        out: dict[str, list] = {"row": [], "query_id": [], "vec_id": [], "score": [], "beyond": []}
        if left.num_rows and right.num_rows:
            block = BlockIndex.of(left.to_pylist()[0])
            own = right.select(["row", "vec_id", "v", "floor"]).to_pylist()
            for x in own:
                ids, scores, _ = block.top(scaled([x["v"]])[0], k, x["row"], x["floor"])
                for i, s in zip(ids.tolist(), scores.tolist(), strict=True):
                    held = min(MOST, max(LEAST, s))
                    beyond = (s + (1 << 8 * KEY_BYTES - 1)).to_bytes(KEY_BYTES, "big") if held in (LEAST, MOST) else None
                    for c, v in zip(out, (x["row"], x["vec_id"], i, held, beyond), strict=True):
                        out[c].append(v)
        return pa.table({c: pa.array(v, type=pa.binary() if c == "beyond" else pa.int64()) for c, v in out.items()})

    sent = index.where(F.col("block").between(blocks[0], blocks[-1])).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = asked.withColumn("block", F.explode(F.sequence(F.lit(blocks[0]), F.lit(blocks[-1]))))
    return sent.groupBy("block", "group").cogroup(met.groupBy("block", "group")).applyInArrow(answer, FOUND)


def top_k(df: DataFrame, asks: Column, k: int = 5, block_rows: int | None = None, work: Workspace | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that asks the k best rows of df but its own.

    df: of integer_vectors().
    """
    work = work or Workspace(df.sparkSession, "topk")
    rows = work.table(df.select("vec_id", "v", F.coalesce(asks, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row")), "vectors")
    blocks, groups = _sized(rows, block_rows)
    index = work.table(build(rows, blocks), "index")
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")
    asked = rows.where("asks").select("row", "vec_id", "v", group.alias("group"))
    found = work.table(_answers(index, range(1), asked.withColumn("floor", F.lit(None).cast("long")), groups, k), "first")
    if blocks > 1:
        # Scores at the ends of 64 bits may stand for others and give no floor.
        floors = found.groupBy("row").agg(F.when((F.count(F.lit(1)) >= k) & (F.count("beyond") == 0), F.min("score")).alias("floor"))
        found = found.union(_answers(index, range(1, blocks), asked.join(floors, "row", "left"), groups, k))
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
