"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum
and its maximum, so PERMUTATIONS evaluations make twice as many values. BANDS
bands of ROWS values bring documents together; a pair that shares 85 percent meets in
none of them with a probability below 1e-10 (at 80 percent, 5e-8). Every link is confirmed
on the full shingle sets, and nothing is linked that is not confirmed.

Documents with one shingle set form a class that takes part once, with one text,
however many rows it has. Within a bucket no pairs are listed: its members are compared
with one pivot, and connected components are found. Where the other members of a bucket
are still in several components, overlaps are counted: a pair can only be linked if
both hold a common shingle among their first few, in an order that puts shingles
of a single component first and rare ones next. Members without such a shingle drop
out, and those that share one form families. Inside a family every document outside
its largest component is searched against all members of other components: blocks of
such queries meet blocks of members in cells of a bounded size, where overlaps are
counted on full sets and one link for each component found is returned. Every pair of a
bucket is thus compared unless both are connected already or cannot be linked.
Pivots, members and shingles meet in joins by key that Spark may split; counts and
minima are aggregated before they are shuffled; components shrink to stars by large-star
and small-star steps, distributed at every size.

Defined results: documents without words have n_shingles 0 and link with
nothing; a null id takes no part and is kept; rows that repeat an id are one
document: their links are joined; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.common import Workspace, map_texts

WORDS = 5
#: What near-duplicates share at least, of all that they hold.
PERCENT = 80
PERMUTATIONS, ROWS, BANDS = 64, 4, 32
#: Queries and members of a family that meet in one cell, about.
BLOCK = 512

_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: WordHashes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    own = (text or "").encode().lower().split()
    n = len(own)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, own), dtype=np.uint64, count=n)
    k = min(size, n)
    out = np.full(n - k + 1, k, dtype=np.uint64)
    for j in range(k):
        out = out * _MIX + h[j : n - k + 1 + j]
    return np.unique(mixed(out))


def multipliers(n: int = PERMUTATIONS) -> np.ndarray:
    return np.random.default_rng(20240101).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    values = np.empty((len(sets), 2 * PERMUTATIONS), dtype=np.uint64)
    for i, a in enumerate(multipliers()):
        y = flat * a
        # A band draws on different permutations: the least values first, then the largest.
        values[:, i] = np.minimum.reduceat(y, starts)
        values[:, PERMUTATIONS + i] = np.maximum.reduceat(y, starts)
    keys = np.zeros((len(sets), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        keys = mixed(keys * _MIX + values[:, r::ROWS])
    return keys + np.arange(BANDS, dtype=np.uint64) * _MIX


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text but with n_shingles, set_key (null without words) and bands."""

    def make():
        words = WordHashes()

        def run(texts):
            sets = [shingles(t, words) for t in texts]
            some = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            if some:
                for i, row in zip(some, band_keys([sets[i] for i in some]).view(np.int64), strict=True):
                    bands[i] = row
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            return {"n_shingles": [len(s) for s in sets], "set_key": keys, "bands": bands}

        return run

    return map_texts(docs, make, {"n_shingles": "bigint", "set_key": "binary", "bands": "array<bigint>"}, text)


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b of the pairs whose shingle sets overlap enough. texts: set_key and text of every class in pairs."""
    own = texts.select(F.col("set_key").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(own, "b").join(texts.select(F.col("set_key").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches):
        import pyarrow as pa

        words, held, held_key = WordHashes(), None, None
        for batch in batches:
            good = []
            for i, key in enumerate(batch.column(0).to_pylist()):
                if key != held_key:  # rows of one pivot stand together
                    held, held_key = shingles(batch.column(3)[i].as_py(), words), key
                other = shingles(batch.column(2)[i].as_py(), words)
                common = len(np.intersect1d(held, other, assume_unique=True))
                if 100 * common >= percent * (len(held) + len(other) - common):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(good, type=pa.int64())) for i in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "text_b", "text_a").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """node, label (the smallest node it can reach) of every node of the edges u, v."""
    edges = work.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges-0")
    before, step = None, 0
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, step = state, step + 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        edges = work.table(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"edges-{step}")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def near_duplicates(spark: SparkSession, docs: DataFrame, work: Workspace | None = None, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (doc_id, text)."""
    work = work or Workspace(spark, "minmax")
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    signed = work.table(signatures(docs), "signatures")
    taking = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    picked = taking.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("pick"), F.max("n_shingles").alias("n"), F.any_value("bands").alias("bands"))
    classes = work.table(picked.select("set_key", F.col("pick.doc_id").alias("rep"), F.col("pick.text_key").alias("text_key"), "n", "bands"), "classes")
    reps = classes.select("set_key", "rep")
    # Classes that one id belongs to are one document.
    ids = taking.select("doc_id", "set_key").distinct().join(reps, "set_key")
    several = ids.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u <> v").select("doc_id", "u")
    same = work.table(several.join(ids, "doc_id").select("u", F.col("rep").alias("v")).distinct(), "same")
    banded = classes.select("set_key", "rep", "text_key", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket")
    members = work.table(banded.join(shared, "bucket"), "members")
    needed = members.select(F.col("rep").alias("doc_id"), "text_key", "set_key").distinct()
    once = docs.groupBy("doc_id", "text_key").agg(F.first("text").alias("text"))
    texts = work.table(once.join(needed, ["doc_id", "text_key"]).select("set_key", "text"), "texts")
    links = work.table(confirm(_star_pairs(members, percent), texts, percent), "links")
    edges = links.join(reps.toDF("a", "u"), "a").join(reps.toDF("b", "v"), "b").select("u", "v").union(same)
    label = components(edges, Workspace(spark, "minmax-stars"))
    open_ = work.table(_still_open(members, label), "open")
    if not open_.isEmpty():
        found = work.table(_within_families(open_, texts, percent), "found")
        if not found.isEmpty():
            label = components(edges.union(found), Workspace(spark, "minmax-all"))
    named = signed.join(reps, "set_key", "left").join(label.toDF("rep", "label"), "rep", "left")
    component = F.coalesce("label", "rep", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _star_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs a, b of a bucket's first member with the others, but for sizes that rule a link out."""
    pivots = members.groupBy("bucket").agg(F.min(F.struct("rep", "set_key", "n")).alias("p"))
    met = members.join(pivots, "bucket").where(F.col("p.set_key") != F.col("set_key"))
    small, large = F.least("p.n", "n"), F.greatest("p.n", "n")
    return met.where(100 * small >= percent * large).select(F.col("p.set_key").alias("a"), F.col("set_key").alias("b")).distinct()


def _still_open(members: DataFrame, label: DataFrame) -> DataFrame:
    """set_key, rep, label and n of the members of buckets that hold several components besides the pivot, which met all of them."""
    marked = members.join(label.toDF("rep", "label"), "rep", "left").select("bucket", "set_key", "rep", "n", F.coalesce("label", "rep").alias("label"))
    pivots = marked.groupBy("bucket").agg(F.min(F.struct("rep", "set_key")).alias("p"))
    rest = marked.join(pivots, "bucket").where(F.col("p.set_key") != F.col("set_key"))
    apart = rest.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    return rest.join(apart, "bucket", "left_semi").select("set_key", "rep", "label", "n").distinct()


def _prefixes(open_: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """shingle, set_key, rep and label for the shingles by which an open document may be linked with another component.

    Two sets that share the share asked for hold a common shingle among the first n - ceil(share * n) + 1 of each,
    whatever order all shingles are put in. Here those of one component alone come first: no link needs them.
    """

    def run(batches):
        import pyarrow as pa

        words = WordHashes()
        for batch in batches:
            for i, text in enumerate(batch.column(4)):
                own = shingles(text.as_py(), words)
                for at in range(0, len(own), 50_000):
                    part = own[at : at + 50_000].view(np.int64)
                    row = pa.array(np.full(len(part), i))
                    yield pa.RecordBatch.from_arrays([pa.array(part), *[batch.column(c).take(row) for c in range(4)]], names=["shingle", "set_key", "rep", "label", "n"])

    kinds = dict(open_.dtypes)
    schema = f"shingle long, set_key binary, rep {kinds['rep']}, label {kinds['label']}, n {kinds['n']}"
    listed = open_.join(texts, "set_key").select("set_key", "rep", "label", "n", "text").mapInArrow(run, schema)
    common = listed.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("shingle", "c")
    own = Window.partitionBy("set_key")
    ranked = listed.join(common, "shingle").withColumns({"nth": F.row_number().over(own.orderBy("c", "shingle")), "held": F.count(F.lit(1)).over(own)})
    most = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return ranked.where(F.col("nth") + F.col("n") - F.col("held") <= most).select("shingle", "set_key", "rep", "label")


def _within_families(open_: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links u, v between open documents of several components."""
    spark = open_.sparkSession
    own = Workspace(spark, "minmax-families")
    prefixes = own.table(_prefixes(open_, texts, percent), "prefixes")
    pivots = prefixes.groupBy("shingle").agg(F.min("rep").alias("pivot"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("shingle", "pivot")
    apart = own.table(prefixes.join(pivots, "shingle").select("set_key", "rep", "label", "pivot").distinct(), "apart")
    family = components(apart.select(F.col("rep").alias("u"), F.col("pivot").alias("v")), Workspace(spark, "minmax-families"))
    docs = apart.select("set_key", "rep", "label").distinct().join(family.toDF("rep", "family"), "rep", "left").withColumn("family", F.coalesce("family", "rep"))
    docs = own.table(docs, "docs")
    sizes = docs.groupBy("family", "label").agg(F.count(F.lit(1)).alias("k"))
    sizes = sizes.groupBy("family").agg(F.sum("k").alias("k"), F.max_by("label", F.struct("k", "label")).alias("main"), F.max("k").alias("most"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    sized = docs.join(sizes.select("family", "main", blocks(F.col("k")).alias("mb"), F.greatest(blocks(F.col("k") - F.col("most")), F.lit(1)).alias("qb")), "family")
    deal = lambda n: F.pmod(F.xxhash64("set_key"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    core = sized.select("family", "set_key", "rep", "label", F.lit(False).alias("asks"), deal(F.col("mb")).alias("i"), every(F.col("qb")).alias("j"))
    asks = sized.where("label <> main").select("family", "set_key", "rep", "label", F.lit(True).alias("asks"), every(F.col("mb")).alias("i"), deal(F.col("qb")).alias("j"))
    cells = core.unionByName(asks).join(texts, "set_key").select("family", "i", "j", "rep", "label", "asks", "text")

    def search(table):
        import pyarrow as pa

        words = WordHashes()
        asking, rep, component = (table.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "rep", "label"))
        sets = [shingles(t.as_py(), words) for t in table.column("text")]
        core, u, v = np.flatnonzero(~asking), [], []
        if len(core) and asking.any():
            size = np.array([len(sets[i]) for i in core])
            known, at = np.unique(np.concatenate([sets[i] for i in core]), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            held = np.zeros(len(known), dtype=bool)
            for q in np.flatnonzero(asking).tolist():
                place = np.minimum(np.searchsorted(known, sets[q]), len(known) - 1)
                place = place[known[place] == sets[q]]
                held[place] = True
                common = np.add.reduceat(held[at].astype(np.int64), starts)
                held[place] = False
                linked = core[(100 * common >= percent * (size + len(sets[q]) - common)) & (component[core] != component[q])]
                _, first = np.unique(component[linked], return_index=True)
                u += [rep[q]] * len(first)
                v += rep[linked[first]].tolist()
        return pa.table({"u": pa.array(u, type=pa.int64()), "v": pa.array(v, type=pa.int64())})

    return cells.groupBy("family", "i", "j").applyInArrow(search, "u long, v long")
