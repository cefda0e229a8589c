"""Uniform sharding by a hypergeometric communication matrix.

Native DataFrame operations only. A uniform random placement of N rows with
exact shard sizes is drawn without ever sorting N rows in one place:

1. every task puts its rows in a random order and writes them once, each with
   its partition, its place in that order and a random number, so that retried
   tasks see the same draws; this permutes locally, without an exchange;
2. the driver draws how many rows of each partition go to each shard: a matrix
   whose margins are the partition sizes and the shard sizes (multivariate
   hypergeometric), partitions x shards numbers;
3. a row's place in its partition picks its shard, and the rows are exchanged;
4. inside its shard every row gets a random slot: rows fall into random bins of
   about `bin_rows`, are ranked inside the bin and shifted by the bin's offset.

Shard sizes differ by one row at most (law `rows`). Equal texts, a hot source or
repeated ids cannot skew any step: partitions and bins do not depend on values.

A hypergeometric number is drawn by rejection from the envelope that every
log-concave distribution lies under, p(m + k) <= p(m) min(1, exp(1 - q |k|)) with
m the mode and q <= p(m). Only ratios p(m + k) / p(m) are evaluated, as differences
of log-factorials that lose nothing to the size of the numbers, so one method
serves every size up to 2**53 rows.

Defined results: null texts have size 8 and the crc32 of an empty text; repeated
rows are placed one by one; an empty table gives an empty result; an input column
that shares a name with an output column, in whatever case, is replaced by it; no
other input column is touched, whatever its name.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.common import Workspace, packed, unpacked

_LOG_FACTORIAL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 256)))])


def _series(x: np.ndarray) -> np.ndarray:
    """What Stirling's formula for log(x!) leaves out, for x of 128 or more."""
    return 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def log_factorial_ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log(a! / b!) for counts from 0 on. Large terms cancel before they are rounded."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    x, y = np.maximum(a, 128.0), np.maximum(b, 128.0)
    far = (y + 0.5) * np.log1p((x - y) / y) + (x - y) * (np.log(x) - 1) + _series(x) - _series(y)

    def rest(n):  # log(n!) less log(max(n, 128)!)
        return _LOG_FACTORIAL[np.minimum(n, 128).astype(np.int64)] - _LOG_FACTORIAL[128]

    return far + rest(a) - rest(b)


def hypergeometric(rng: np.random.Generator, good: np.ndarray, total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each place, how many of n rows drawn from total without replacement are among the good ones."""
    good, total, n = (np.asarray(x, dtype=np.int64) for x in (good, total, n))
    bad = total - good
    # In whole numbers: the products pass 64 bits.
    mode = np.array([(x + 1) * (g + 1) // (t + 2) for x, g, t in zip(n.tolist(), good.tolist(), total.tolist(), strict=True)], dtype=np.int64)
    share = good / np.maximum(total, 1)
    variance = n * share * (1 - share) * ((total - n) / np.maximum(total - 1, 1))
    # No whole-numbered distribution of this variance has a lower peak.
    q = (1 - 1e-9) / np.sqrt(1 + 12 * variance)
    out, open_ = mode.copy(), np.flatnonzero((n > 0) & (good > 0) & (bad > 0) & (n < total))
    out[n >= total] = good[n >= total]
    while len(open_):
        g, b, x, m, p = good[open_], bad[open_], n[open_], mode[open_], q[open_]
        w = 1 + p / 2
        u, v, accept, side = rng.random((4, len(open_)))
        y = np.where(u <= w / (1 + w), v * w / p, (w - np.log1p(-v)) / p)
        k = m + np.where(side < 0.5, -1, 1) * np.rint(y).astype(np.int64)
        inside = (k >= 0) & (k <= g) & (k <= x) & (x - k <= b)
        k = np.where(inside, k, m)
        ratio = -log_factorial_ratio(k, m) - log_factorial_ratio(g - k, g - m) - log_factorial_ratio(x - k, x - m) - log_factorial_ratio(b - x + k, b - x + m)
        taken = inside & (np.log1p(-accept) + np.minimum(0.0, w - p * y) <= ratio)
        out[open_[taken]] = k[taken]
        open_ = open_[~taken]
    return out


def communication_matrix(rows_in: list[int], shard_sizes: list[int], seed: int) -> np.ndarray:
    """Counts with row sums rows_in and column sums shard_sizes, as a uniform shuffle would give.

    The rows are split in halves, and halves again; what falls to the first half of
    each is drawn shard by shard, for all stretches of one depth together.
    """
    rng, width = np.random.default_rng(seed), 1
    while width < len(rows_in):
        width *= 2
    sizes = np.zeros(width, dtype=np.int64)
    sizes[: len(rows_in)] = rows_in
    table = np.array([shard_sizes], dtype=np.int64)
    while len(table) < width:
        halves = sizes.reshape(2 * len(table), -1).sum(axis=1).reshape(-1, 2)
        need, left = halves[:, 0].copy(), halves.sum(axis=1)
        first = np.zeros_like(table)
        for j in range(table.shape[1]):
            first[:, j] = hypergeometric(rng, table[:, j], left, need)
            need -= first[:, j]
            left -= table[:, j]
        table = np.stack([first, table - first], axis=1).reshape(2 * len(table), -1)
    return table[: len(rows_in)]


def even_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (j < n % shards) for j in range(shards)]


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table from a literal, without an RDD."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def shard_rows(df: DataFrame, shards: int = 24, seed: int = 42, bin_rows: int = 20_000, work: Workspace | None = None) -> DataFrame:
    """df with law, shard (0 to shards - 1) and slot (gapless from 0 in each shard), placed uniformly at random."""
    spark = df.sparkSession
    work = work or Workspace(spark, "shard")
    rows = df.select(packed(df), F.rand(seed).alias("local")).sortWithinPartitions("local")
    # The number of a row holds its partition and, in the low 33 bits, its place there.
    numbered = rows.select("row", F.monotonically_increasing_id().alias("number"), F.rand(seed + 1).alias("slot_key"))
    where, place = F.shiftright("number", 33).cast("int"), F.col("number").bitwiseAND((1 << 33) - 1)
    fixed = work.table(numbered.select("row", where.alias("part"), place.alias("place"), "slot_key"), "rows")
    sizes = {r["part"]: r["n"] for r in fixed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts, total = sorted(sizes), sum(sizes.values())
    bins = max(1, -(-total // (shards * bin_rows)))
    cuts = np.cumsum(communication_matrix([sizes[p] for p in parts], even_sizes(total, shards), seed), axis=1).tolist()
    # A row for each task that wrote the table.
    dealing = _table(spark, [{"part": p, "cuts": c} for p, c in zip(parts, cuts, strict=True)], "part:int,cuts:array<bigint>")
    dealt = fixed.join(F.broadcast(dealing), "part").withColumns(
        {"shard": F.size(F.filter("cuts", lambda c: c <= F.col("place"))), "bin": F.least(F.floor(F.col("slot_key") * bins).cast("int"), F.lit(bins - 1))}
    )
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each bin_rows rows.
    offsets = dealt.groupBy("shard", "bin").count().select("shard", "bin", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("slot_key", "part", "place")).cast("long") - 1
    placed = dealt.select("row", "shard", "bin", rank.alias("rank")).join(offsets, ["shard", "bin"])
    return unpacked(placed, {"law": F.lit("rows"), "shard": F.col("shard"), "slot": F.col("rank") + F.col("offset")})
