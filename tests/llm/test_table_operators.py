import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tarn.llm import impact_index, shard, warc


def test_shards_are_even_gapless_and_seeded(spark):
    made = [(i, f"t{i % 7}", i, "row") for i in range(1000)] + [(5, "same", 0, None)] * 300 + [(None, None, None, None)] * 5
    df = spark.createDataFrame(made, "doc_id long, Slot string, _p long, row string").repartition(7)
    out = shard.shard_rows(df, shards=24, bin_rows=10)
    assert out.columns == ["doc_id", "_p", "row", "law", "shard", "slot"]  # Slot is replaced, all else stays as it is
    rows = out.collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(slots) == 24 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r["doc_id"], r["_p"], r["row"]) for r in rows) == Counter((x[0], x[2], x[3]) for x in made)
    assert shard.shard_rows(df.limit(0)).count() == 0


def test_sharding_query_equals_its_definition(spark, sf):
    """Sizes and checksums of every document, and the law of its shards."""
    from tarn.llm.queries import QUERIES

    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op9_hypergeometric_shards"](spark, sf).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t) + 8, zlib.crc32(t)) for i, t in docs.items()}
    assert len(rows) == len(docs) and {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    held = Counter(r["shard"] for r in rows)
    assert sorted(held) == list(range(24)) and max(held.values()) - min(held.values()) <= 1
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows) and max(r["slot"] for r in rows) < max(held.values())


def test_communication_matrix_has_its_margins_and_mean():
    total = np.zeros((3, 4))
    for seed in range(300):
        m = shard.communication_matrix([5, 0, 20], shard.even_sizes(25, 4), seed)
        assert m.sum(axis=1).tolist() == [5, 0, 20] and m.sum(axis=0).tolist() == [7, 6, 6, 6]
        total += m
    assert np.abs(total[0] / 300 - np.array([7, 6, 6, 6]) * 5 / 25).max() < 0.25
    sizes = [3 * 10**9, 10**10, 7]
    m = shard.communication_matrix(sizes, shard.even_sizes(sum(sizes), 24), 3)
    assert m.sum(axis=1).tolist() == sizes and m.sum(axis=0).tolist() == shard.even_sizes(sum(sizes), 24) and (m >= 0).all()


def test_hypergeometric_draws_follow_their_law():
    rng, n = np.random.default_rng(4), 100_000
    for good, total, drawn in ((3, 10, 4), (50, 120, 60), (1, 10, 9), (5, 5, 3), (0, 9, 4), (4, 9, 9)):
        x = shard.hypergeometric(rng, np.full(n, good), np.full(n, total), np.full(n, drawn))
        low, high = max(0, drawn - (total - good)), min(drawn, good)
        want = [math.comb(good, k) * math.comb(total - good, drawn - k) / math.comb(total, drawn) for k in range(low, high + 1)]
        assert np.abs(np.bincount(x - low, minlength=high - low + 1) / n - want).max() < 0.006
    for good, total, drawn in ((5000, 60_000, 900), (3 * 10**10, 10**12, 5 * 10**10), (4 * 10**9, 10**11, 25_000_000), (10**14, 24 * 10**14, 10**9)):
        x = shard.hypergeometric(rng, np.full(n, good), np.full(n, total), np.full(n, drawn))
        mean, share = drawn * good / total, good / total
        variance = drawn * share * (1 - share) * (total - drawn) / (total - 1)
        z = (x - mean) / variance**0.5
        skew = (1 - 2 * share) * (total - 2 * drawn) / (total - 2) / variance**0.5
        assert abs(z.mean()) < 0.015 and abs(z.var() - 1) < 0.025 and abs((z**3).mean() - skew) < 0.05


def test_shard_and_slot_are_uniform(spark):
    """A row's place says nothing about where it came from."""
    df = spark.range(2000).repartition(5)
    rows = shard.shard_rows(df, shards=4, bin_rows=100).collect()
    ids = np.array([r["id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))])
    assert abs(np.corrcoef(ids, np.arange(len(ids)))[0, 1]) < 0.08


def brute(vectors, k, every=50):
    from fractions import Fraction

    ints = [(i, [math.floor(256 * Fraction(float(c))) for c in v]) for i, v in vectors if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = Counter()
    for at, (q, own) in enumerate(ints):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for other, (i, v) in enumerate(ints) if other != at)[:k]
            out.update((q, r + 1, i, -s) for r, (s, i) in enumerate(scored))
    return out


def found(spark, made, k, kind="float", every=50, **more):
    df = spark.createDataFrame([(i, v, "x") for i, v in made], f"vec_id long, embedding array<{kind}>, score string")
    got = impact_index.top_k(impact_index.integer_vectors(df), F.col("vec_id") % every == 0, k, **more)
    return Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect())


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    made = [(i, [float(np.float32(c)) for c in rng.normal(0, 0.15, 12)]) for i in range(400)]
    made += [(400 + i, made[50][1]) for i in range(30)]  # ties
    made += [(600, None), (601, [0.1, None]), (602, [float("nan")]), (603, [float("inf")]), (604, []), (650, [0.5]), (None, [0.1]), (700, [0.0] * 12)]
    made += [(100, made[7][1]), (100, made[8][1]), (100, made[8][1])]  # an id with several vectors, each of which asks
    for rows in (100, None):
        assert found(spark, made, 5, block_rows=rows) == brute(made, 5)
    assert found(spark, made[:3], 5) == brute(made[:3], 5) and len(brute(made[:3], 5)) == 2
    assert not found(spark, [(1, [0.1])], 5) and not found(spark, [(604, None)], 5)


def test_top_k_holds_no_component_back(spark):
    """Components far beyond 16 and 32 bits, whose scores pass 64 bits too, and ties among them."""
    rng = np.random.default_rng(6)
    made = [(i, [float(c) for c in rng.normal(0, 1, 4)]) for i in range(120)]
    made += [(200, [1e6, 1.0]), (201, [1e6, 0.0]), (202, [5e6, 0.0]), (203, [-1e6, 7.0]), (250, [2.0**23, 1.0, -3.0])]
    assert found(spark, made, 5, "double", block_rows=40) == brute(made, 5)
    huge = [*made, (300, [1e30, 1.0]), (301, [1e30, 5.0]), (302, [2e30, 0.0]), (303, [-1e30]), (304, [1e308, 1e300])]
    held = {(q, r, i, min(2**63 - 1, max(-(2**63), s))) for q, r, i, s in brute(huge, 5)}
    assert set(found(spark, huge, 5, "double", block_rows=40)) == held


def test_top_k_stops_early_on_proof():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-10, 10, (3000, 16))
    vectors[7] = 90
    block = impact_index.BlockIndex(np.arange(3000), np.arange(3000), vectors)
    again = impact_index.BlockIndex.of(block.record())
    for query in (vectors[7] + 1, vectors[7] + 5):
        ids, scores, read = again.top(query, 1)
        assert ids.tolist() == [7] and scores[0] == (vectors[7] * query).sum() and read < len(block.starts)
    # A block whose bounds stay below the floor is not read at all.
    assert again.top(vectors[7], 1, floor=10**9)[2] == 0
    # Each query reads by its own impacts.
    lone = np.zeros(16, dtype=np.int64)
    lone[3] = 1
    assert again.top(lone, 1, own_row=7)[1][0] == np.delete(vectors[:, 3], 7).max()


def page_rows():
    big = "<p>" + "x" * 300_000
    return [(1, "http://a/1", "<p>one"), (2, "http://a/ü?q=1 2\n", "<p>two"), (3, None, "<p>one"), (4, "http://a", None), (9, "http://b", ""), (7, "http://c", big), (8, "http://c", big), (8, "http://c", big), (None, "http://n", "<p>one")]


def test_archives_come_back(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").withColumn("payload", F.lit(1))
    manifest, folder = warc.archive_pages(spark, pages)
    got = Counter(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc.read_archives(manifest, folder).collect())
    want, largest = Counter(), {}
    for i, _, html in page_rows():
        largest[html or ""] = max(largest.get(html or "", -1), -1 if i is None else i)
    for i, _, html in page_rows():
        data = (html or "").encode()
        top = largest[html or ""]
        kind = ("response", None) if i == top else ("revisit", top)
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), *kind] += 1
    assert got == want
    payloads = {r["payload"] for r in warc.read_archives(manifest, folder, payloads=True).collect() if r["record_type"] == "response"}
    assert payloads == {(h or "").encode() for _, _, h in page_rows()}
    empty, at = warc.archive_pages(spark, pages.limit(0))
    assert warc.read_archives(empty, at).count() == 0


def test_normaliser_makes_members_that_stand_alone(tmp_path):
    files = warc.Files(str(tmp_path))
    records = [warc.record(i, f"http://x/{i}", bytes([i]) * 3000 * i, None, False, "2024-01-01T00:00:00Z") for i in range(5)]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    (tmp_path / "all.warc.gz").write_bytes(pack.compress(b"".join(records)) + pack.flush())
    count, size = warc.normalise_file(files, "all.warc.gz", "n.warc.gz")
    data = (tmp_path / "n.warc.gz").read_bytes()
    assert count == 5 and size == len(data)
    import json

    for line, record in zip((tmp_path / "n.warc.gz.idx").read_text().splitlines(), records, strict=True):
        _, at, n, inflated = json.loads(line)
        assert zlib.decompress(data[at : at + n], 31) == record and inflated == len(record)
    # Many members are one stream as well, and reading in small pieces changes nothing.
    old, warc.PIECE = warc.PIECE, 100
    try:
        with files.open("n.warc.gz") as f:
            assert list(warc.split_records(warc.inflated(f))) == records
    finally:
        warc.PIECE = old
