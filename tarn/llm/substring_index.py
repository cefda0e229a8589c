"""Removal of passages seen before: a log-structured index of window fingerprints.

A window is SIZE consecutive words. Of the hashes of the GRAM-word runs inside a
window the least is its fingerprint; neighbouring windows that share it form a
span, so equal windows always lie in spans of one fingerprint. The index has two
kinds of sorted immutable runs, each a table bucketed and sorted by its key:

* fingerprints, each once: the only span it has had so far with its first document
  and place, or that it has had several;
* 128-bit hashes of the windows of fingerprints that have had several spans.

Documents come in batches, in the order of their ids. The batch's entries are
exchanged and sorted by fingerprint and merge-joined with the historical runs, which
are read in place, neither exchanged nor sorted again:

* a span equal to the only earlier one is a repetition as a whole;
* where a fingerprint has several spans, these are verified window by window: only
  their windows' hashes are made, exchanged and merge-joined with the window runs;
  the first of each joins the index, the others are repeated;
* what is new is written as a run. Two runs of one level are merged into one of the
  next, by a merge join as well, so that few runs are ever open.

A manifest names the runs; an index is opened again by it, in any session. Merged runs
stay on disk, as results that are still to be read may need them, until the folder is
dropped.

A task sends one row for each fingerprint, or window, that it met, however often: what
repeats inside the task is decided there and travels under a key of its own, evenly
dealt. A passage that a third of all documents hold thus sends a row from each task.
Texts are exchanged once, to tables bucketed by document; reading them again to verify
and to apply decisions needs no further exchange.

Equality is that of 128 bits, made from 64-bit hashes of the words: a span's are its
fingerprint and its own hash, a window's two independent hashes. Two different windows
are taken for equal only if these agree.

Defined results: null and empty texts have no words; texts shorter than a window
lose nothing; rows that repeat an id are taken as documents one after another, in
the order of their texts' hashes; null ids come first; extra columns stay as they
are, input columns named like an output, in whatever case, are replaced.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import Workspace, settings

SIZE, GRAM = 20, 8
#: Batches that remove_repeated() adds one after another; the runs of the first two are merged already.
BATCHES = 2
#: Entries that a task puts together before it sends them on, and rows that it merges at a time.
TOGETHER, CHUNK = 400_000, 50_000

_R1, _R2, _R3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        own = (text or "").encode().split()
        return np.fromiter(map(self.__getitem__, own), dtype=np.uint64, count=len(own))


def rolled(h: np.ndarray, size: int, factor: np.uint64) -> np.ndarray:
    """A hash of every run of `size` hashes."""
    out = np.zeros(max(0, len(h) - size + 1), dtype=np.uint64)
    for j in range(size):
        out = out * factor + h[j : j + len(out)]
    return mixed(out)


class Powers:
    """Powers of an odd factor and of its inverse, for sums over stretches of any length."""

    def __init__(self, factor: np.uint64):
        self.factor, self.inverse = int(factor), pow(int(factor), -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def stretch(self, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of h[start:end] for each pair."""
        if len(self.up) < len(h) + 1:
            n = 2 * len(h) + 1
            ones = np.ones(n, dtype=np.uint64)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([ones[:1], ones * np.uint64(self.factor)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([ones[:1], ones * np.uint64(self.inverse)]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(h * self.up[: len(h)], dtype=np.uint64)])
        return mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def spans(h: np.ndarray, powers: Powers, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, hash and place (first window << 8 | windows) of each span of a text's word hashes."""
    if len(h) < size:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    grams = rolled(h, gram, _R1)
    wide = size - gram + 1
    least = np.arange(len(grams) - wide + 1) + np.lib.stride_tricks.sliding_window_view(grams, wide).argmin(axis=1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:], [len(least)]])
    return grams[least[first]], powers.stretch(h, first, last - 1 + size), first << 8 | (last - first)


#: What a row says: INDEX joins the index, REPEAT is repeated, VERIFY must be looked at window by window, HISTORY too,
#: without being judged again, and SEVERAL says that a task met several spans of a fingerprint.
INDEX, REPEAT, VERIFY, HISTORY, SEVERAL = range(5)
SPAN_ROW = "fp long, span long, doc long, place long, kind int"
SPAN_RUN = "fp long, span long, doc long, place long, several boolean, kind int"
WINDOW_ROW = "w long, check long, doc long, place long, kind int"
WINDOW_RUN = WINDOW_ROW


def _spread(doc: np.ndarray) -> np.ndarray:
    """Keys that deal decided rows evenly, those of a document together."""
    return mixed(doc.astype(np.uint64) * _R1 + _R3).view(np.int64)


def _record_batch(parts: list[tuple], schema: str):
    """Parts of columns, put together as the schema names them."""
    import pyarrow as pa

    names = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, type=kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def _entries(batches):
    """SPAN_ROWs of documents (doc, text)."""
    words, powers = WordHashes(), Powers(_R2)
    held: list[tuple] = []
    count = 0

    def together():
        fp, span, place, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((place, doc, span, fp))
        fp, span, place, doc = fp[order].view(np.int64), span[order].view(np.int64), place[order], doc[order]
        head = np.concatenate([[True], fp[1:] != fp[:-1]])
        first = head | np.concatenate([[True], span[1:] != span[:-1]])
        group = np.cumsum(head) - 1
        several = (np.bincount(group, weights=first) > 1)[group]
        parts = [(fp[m], span[m], doc[m], place[m], np.full(int(m.sum()), kind)) for kind, m in ((INDEX, first & ~several), (SEVERAL, head & several))]
        for kind, mask in ((VERIFY, first & several), (REPEAT, ~first)):  # in the documents' order, which packs well
            at = np.flatnonzero(mask)
            at = at[np.lexsort((place[at], doc[at]))]
            parts.append((_spread(doc[at]), np.zeros(len(at), dtype=np.int64), doc[at], place[at], np.full(len(at), kind)))
        return _record_batch(parts, SPAN_ROW)

    for batch in batches:
        docs = batch.column(0).to_numpy()
        for i, text in enumerate(batch.column(1)):
            fp, span, place = spans(words.of(text.as_py()), powers)
            if len(fp):
                held.append((fp, span, place, np.full(len(fp), docs[i], dtype=np.int64)))
                count += len(fp)
            if count >= TOGETHER:
                yield together()
                held, count = [], 0
    if held:
        yield together()


def _whole_keys(batches, keys: tuple[str, ...], order: tuple[str, ...]) -> Iterator:
    """The rows of batches sorted by the keys, in tables of about CHUNK rows that split no key, each sorted by keys and order.

    A merge join keeps the keys' order and not that of the rows of one key.
    """
    import pyarrow as pa

    def sorted_(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_numpy() for c in (*keys, *order)]
        return table.take(pa.array(np.lexsort(columns[::-1])))

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows < CHUNK:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        same = np.logical_and.reduce([(c := table.column(k).to_numpy()) == c[-1] for k in keys])
        done = int(np.flatnonzero(same)[0])  # the last key may go on
        if done:
            yield sorted_(table.slice(0, done))
        held = table.slice(done).to_batches()
        rows = table.num_rows - done
    if rows:
        yield sorted_(pa.Table.from_batches(held))


def _decide(batches):
    """SPAN_RUN rows from SPAN_ROWs sorted by fingerprint, each with what the index knows of its fingerprint."""
    for table in _whole_keys(batches, ("fp",), ("span", "doc", "place")):
        kind = table.column("kind").to_numpy()
        fp, span, doc, place = (table.column(c).to_numpy() for c in ("fp", "span", "doc", "place"))
        known = table.column("known").to_numpy(zero_copy_only=False)
        old_several = table.column("old_several").to_numpy(zero_copy_only=False)
        old_span, old_doc, old_place = (table.column(c).to_numpy() for c in ("old_span", "old_doc", "old_place"))
        own = np.flatnonzero((kind == INDEX) | (kind == SEVERAL))
        passed = np.flatnonzero((kind != INDEX) & (kind != SEVERAL))
        false = np.zeros(len(passed), dtype=bool)
        parts = [(fp[passed], span[passed], doc[passed], place[passed], false, kind[passed])]
        if len(own):
            starts = np.flatnonzero(np.concatenate([[True], fp[own][1:] != fp[own][:-1]]))
            group = np.zeros(len(own), dtype=np.int64)
            group[starts[1:]] = 1
            group = np.cumsum(group)
            heads, n = own[starts], len(starts)
            real = kind[own] == INDEX
            rows, of = own[real], group[real]
            first = np.concatenate([[True], (of[1:] != of[:-1]) | (span[rows][1:] != span[rows][:-1])])[: len(rows)]

            def any_of(which: np.ndarray, groups: np.ndarray, least: int = 1) -> np.ndarray:
                return np.bincount(groups, weights=which, minlength=n) >= least

            unclear = any_of(~real, group) | any_of(first, of, 2) | old_several[heads] | any_of(known[rows] & (span[rows] != old_span[rows]), of)
            alone = first & ~unclear[of] & ~known[rows]
            marked = unclear & ~old_several[heads]
            history = heads[marked & known[heads]]
            marked = heads[marked]
            for k, at, several in ((INDEX, rows[alone], False), (REPEAT, rows[~first | (~unclear[of] & ~alone)], False), (VERIFY, rows[first & unclear[of]], False), (INDEX, marked, True)):
                parts.append((fp[at], span[at], doc[at], place[at], np.full(len(at), several), np.full(len(at), k)))
            parts.append((fp[history], old_span[history], old_doc[history], old_place[history], np.zeros(len(history), dtype=bool), np.full(len(history), HISTORY)))
        yield _record_batch(parts, SPAN_RUN)


def _windows(after: int | None):
    """WINDOW_ROWs of every window in the places of documents (doc, text, places); those up to the document `after` are history."""

    def run(batches):
        words, held, count = WordHashes(), [], 0

        def together():
            w, check, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((start, doc, check, w))
            w, check, doc, place = w[order].view(np.int64), check[order].view(np.int64), doc[order], start[order] << 8 | 1
            first = np.concatenate([[True], (w[1:] != w[:-1]) | (check[1:] != check[:-1])])
            old = np.zeros(len(doc), dtype=bool) if after is None else doc <= after
            later = np.flatnonzero(~first & ~old)
            later = later[np.lexsort((place[later], doc[later]))]
            rows = (w[first], check[first], doc[first], place[first], np.where(old[first], HISTORY, INDEX))
            return _record_batch([rows, (_spread(doc[later]), np.zeros(len(later), dtype=np.int64), doc[later], place[later], np.full(len(later), REPEAT))], WINDOW_ROW)

        for batch in batches:
            docs = batch.column(0).to_numpy()
            for i in range(batch.num_rows):
                h = words.of(batch.column(1)[i].as_py())
                place = np.array(batch.column(2)[i].as_py(), dtype=np.int64)
                n = place & 255
                start = np.repeat(place >> 8, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.unique(start)
                held.append((rolled(h, SIZE, _R2)[start], rolled(h, SIZE, _R3)[start], np.full(len(start), docs[i], dtype=np.int64), start))
                count += len(start)
                if count >= TOGETHER:
                    yield together()
                    held, count = [], 0
        if held:
            yield together()

    return run


def _repeated(batches):
    """WINDOW_RUN rows from WINDOW_ROWs sorted by window, each with whether the index knows its window."""
    for table in _whole_keys(batches, ("w", "check"), ("doc", "place")):
        w, check, doc, place, kind = (table.column(c).to_numpy() for c in ("w", "check", "doc", "place", "kind"))
        known = table.column("known").to_numpy(zero_copy_only=False)
        passed = kind == REPEAT
        same = np.concatenate([[False], (w[1:] == w[:-1]) & (check[1:] == check[:-1])])
        new = ~passed & ~same & ~known
        again = passed | ((kind == INDEX) & (same | known))
        yield _record_batch([(w[m], check[m], doc[m], place[m], np.full(int(m.sum()), k)) for k, m in ((INDEX, new), (REPEAT, again))], WINDOW_RUN)


class SubstringIndex:
    """The runs of one index below a shared folder. A folder that holds a manifest is opened again.

    buckets: into how many parts every run is cut; the session's shuffle partitions, if not given.
    """

    #: Of each kind of run: its key and its columns.
    KINDS = {"spans": (["fp"], SPAN_RUN), "windows": (["w", "check"], WINDOW_RUN)}

    def __init__(self, spark: SparkSession, work: Workspace | None = None, buckets: int | None = None):
        self.spark, self.work = spark, work or Workspace(spark, "substring")
        self.session = f"tarn_{uuid.uuid4().hex}"
        found = self.work.names("manifest-")
        if found:
            held = json.loads(self.work.text(found[-1]))
            self.buckets, self.made, self.merged, self.runs, self.last = (held[k] for k in ("buckets", "made", "merged", "runs", "last"))
            for run in self.runs:
                for kind in self.KINDS:
                    self._declare(f"{kind}-{run['name']}", kind)
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self.made, self.merged, self.runs, self.last = 0, 0, [], None

    def _table(self, name: str) -> str:
        return f"{self.session}_{name.replace('-', '_')}"

    def _declare(self, name: str, kind: str) -> None:
        keys, columns = self.KINDS[kind]
        self.spark.sql(
            f"CREATE TABLE {self._table(name)} ({columns.replace('check ', '`check` ')}) USING parquet CLUSTERED BY ({keys[0]}) SORTED BY ({', '.join(f'`{k}`' for k in keys)}) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.work.path}/{name}'"
        )

    def _write(self, df: DataFrame, name: str, kind: str) -> DataFrame:
        """df, each of whose partitions holds one bucket, as a sorted run."""
        keys = self.KINDS[kind][0]
        df.write.bucketBy(self.buckets, keys[0]).sortBy(*keys).option("path", f"{self.work.path}/{name}").saveAsTable(self._table(name))
        return self.spark.table(self._table(name))

    def _run(self, run: dict, kind: str) -> DataFrame:
        return self.spark.table(self._table(f"{kind}-{run['name']}")).where(F.col("kind") == INDEX).drop("kind")

    def _keep(self) -> None:
        """Writes the next manifest; the last one counts."""
        held = {"buckets": self.buckets, "made": self.made, "merged": self.merged, "runs": self.runs, "last": self.last}
        self.work.keep_text(f"manifest-{self.made + self.merged:08d}", json.dumps(held))

    def _in_place(self):
        """Runs are read bucket by bucket in their order, and joined by it."""
        return settings(
            self.spark,
            {
                "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
                "spark.sql.requireAllClusterKeysForCoPartition": "false",
                "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
            },
        )

    def add(self, batch: DataFrame, archive: DataFrame, last: int | None = None) -> DataFrame:
        """Decides on a batch (doc, text), whose ids all follow those added before.

        archive: (doc, text) of all documents so far, the batch included. last: the greatest
        id of the batch, if known. Returns (doc, place) of repeated windows in the batch and
        adds the batch to the index.
        """
        with self._in_place():
            name = f"{self.made:05d}"
            rows = batch.select("doc", "text").mapInArrow(_entries, SPAN_ROW)
            rows = rows.repartition(self.buckets, "fp").sortWithinPartitions("fp")
            old = []
            for i, run in enumerate(reversed(self.runs)):  # the newest row of a fingerprint counts
                held = self._run(run, "spans")
                rows = rows.join(held.select("fp", F.struct("span", "doc", "place", "several").alias(f"h{i}")).hint("merge"), "fp", "left")
                old.append(f"h{i}")
            if not old:
                rows = rows.withColumn("h", F.lit(None).cast("struct<span:long,doc:long,place:long,several:boolean>"))
            h = F.coalesce(*old) if old else F.col("h")
            looked_up = rows.select("fp", "span", "doc", "place", "kind", h.alias("h"))
            known = [F.col("h").isNotNull().alias("known"), F.coalesce("h.several", F.lit(False)).alias("old_several")]
            known += [F.coalesce(f"h.{c}", F.lit(0)).alias(f"old_{c}") for c in ("span", "doc", "place")]
            decided = self._write(looked_up.select("fp", "span", "doc", "place", "kind", *known).mapInArrow(_decide, SPAN_RUN), f"spans-{name}", "spans")
            verify = decided.where(F.col("kind").isin(VERIFY, HISTORY)).groupBy("doc").agg(F.collect_list("place").alias("places"))
            texts = archive.join(verify.hint("shuffle_hash"), "doc").select("doc", "text", "places")
            windows = texts.mapInArrow(_windows(self.last), WINDOW_ROW).repartition(self.buckets, "w").sortWithinPartitions("w", "check")
            seen = []
            for i, run in enumerate(self.runs):
                windows = windows.join(self._run(run, "windows").select("w", "check", F.lit(True).alias(f"s{i}")).hint("merge"), ["w", "check"], "left")
                seen.append(F.col(f"s{i}"))
            known = F.coalesce(*seen, F.lit(False)).alias("known")
            repeated = self._write(windows.select("w", "check", "doc", "place", "kind", known).mapInArrow(_repeated, WINDOW_RUN), f"windows-{name}", "windows")
            self.runs.append({"name": name, "level": 0})
            self.made += 1
            self.last = batch.agg(F.max("doc")).first()[0] if last is None else last
            self._keep()
        return decided.where(F.col("kind") == REPEAT).select("doc", "place").union(repeated.where(F.col("kind") == REPEAT).select("doc", "place"))

    def compact(self) -> int:
        """Merges neighbouring runs of one level, newest first, into one of the next; returns how many merges that took."""
        merges = 0
        while len(self.runs) > 1 and self.runs[-1]["level"] >= self.runs[-2]["level"]:
            with self._in_place():
                older, newer = self.runs[-2:]
                name = f"m{self.merged:05d}"
                for kind, (keys, columns) in self.KINDS.items():
                    own = [c.split()[0] for c in columns.split(", ") if c.split()[0] not in (*keys, "kind")]
                    sides = [self._run(run, kind).select(*keys, F.struct(*own).alias(side)) for run, side in ((older, "a"), (newer, "b"))]
                    both = sides[0].join(sides[1].hint("merge"), keys, "full")
                    row = F.coalesce("b", "a")
                    order = [c.split()[0] for c in columns.split(", ")]
                    values = {c: F.col(c) for c in keys} | {c: row.getField(c).alias(c) for c in own} | {"kind": F.lit(INDEX).alias("kind")}
                    self._write(both.select(*[values[c] for c in order]), f"{kind}-{name}", kind)
                self.runs[-2:] = [{"name": name, "level": max(older["level"], newer["level"]) + 1}]
                self.merged += 1
                merges += 1
                self._keep()
        return merges


def _apply(with_text: bool):
    """Words, removed words and the hash of the kept ones, from (doc, text, places)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n_words, n_removed, hashes, texts = [], [], [], []
            for i in range(batch.num_rows):
                text, places = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                words = (text or "").encode().split()
                kept = words
                if places:
                    place = np.array(places, dtype=np.int64)
                    cover = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(cover, place >> 8, 1)
                    np.add.at(cover, (place >> 8) + (place & 255) - 1 + SIZE, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    if with_text:
                        text = kept_text(text, gone)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                hashes.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                texts.append(text)
            arrays = [batch.column(0), pa.array(n_words, type=pa.int64()), pa.array(n_removed, type=pa.int64()), pa.array(hashes, type=pa.string())]
            names = ["doc", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(texts, type=pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays([*arrays, *[batch.column(j) for j in range(3, batch.num_columns)]], names=[*names, *batch.schema.names[3:]])

    return run


def kept_text(text: str, gone: np.ndarray) -> str:
    """The runs of kept words as they stand in the text, joined by one space."""
    import re

    runs, open_ = [], None
    end = 0
    for m, g in zip(re.finditer(r"[^\x20\x09-\x0D]+", text), gone.tolist(), strict=True):
        if not g and open_ is None:
            open_ = m.start()
        if g and open_ is not None:
            runs.append(text[open_:end])
            open_ = None
        end = m.end()
    if open_ is not None:
        runs.append(text[open_:end])
    return " ".join(runs)


def remove_repeated(spark: SparkSession, docs: DataFrame, keep: list[str] | None = None, batches: int = BATCHES, with_text: bool = False, work: Workspace | None = None) -> DataFrame:
    """docs (doc_id, text and the columns in keep) with n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    batches: how many ranges of ids are added to the index one after another.
    """
    work = work or Workspace(spark, "substring")
    outputs = ("text", "n_words", "n_removed", "kept_sha256", "kept_text")
    keep = [c for c in (["doc_id"] if keep is None else keep) if c.lower() not in outputs]
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("m")).first()
    repeats = ids["n"] > ids["m"] or not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast("int").alias("_none")).alias("own"))
    if repeats:  # numbers in the order of ids then stand for the documents
        numbered = rows.orderBy(F.col("doc").asc_nulls_first(), F.xxhash64("text"), "text").withColumn("doc", F.monotonically_increasing_id())
        rows = work.table(numbered, "numbered")
    index = SubstringIndex(spark, work)
    cuts = rows.agg(F.percentile_approx("doc", [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    number = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.col("doc"))) if cuts else F.lit(0)
    name = f"{index.session}_documents"
    dealt = rows.withColumn("batch", number).repartition(index.buckets, "doc")
    dealt.write.partitionBy("batch").bucketBy(index.buckets, "doc").option("path", f"{work.path}/documents").saveAsTable(name)
    rows, done = spark.table(name), None
    for k in range(len(cuts) + 1):
        mine = rows.where(F.col("batch") == k)
        places = index.add(mine.select("doc", "text"), rows.where(F.col("batch") <= k).select("doc", "text"), cuts[k] if k < len(cuts) else None)
        index.compact()
        listed = places.groupBy("doc").agg(F.collect_list("place").alias("places"))
        part = mine.join(listed.hint("shuffle_hash"), "doc", "left").select("doc", "text", "places", "own")
        schema = T._parse_datatype_string("doc long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        part = part.mapInArrow(_apply(with_text), T.StructType([*schema.fields, part.schema["own"]]))
        done = part if done is None else done.union(part)
    return done.select(*[f.name for f in schema.fields[1:]], *[F.col("own").getField(c).alias(c) for c in keep])
