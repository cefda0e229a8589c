"""Small tables with nulls, empty, long and repeated texts, held against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tarn.llm import bpe, minmax, packing, quality, substring_index, token_fst, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "the quick brown fox jumps over the lazy dog and runs far away from all of the other animals in a big dark wood until morning comes again"
PASSAGE = " ".join(f"passage{i}" for i in range(55))


def rows():
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(9000))
    texts = [
        None, "", " \n\t ", "one", "One", "a b c d", BASE, BASE, BASE.upper(), BASE + " end", f"intro {PASSAGE} outro", f"other words here {PASSAGE}", long, long + " tail",
        "repeat me now please thanks " * 12, "x\nx\nx\n\ny\n", "Ünïcödé tèxt naïve façade <|endoftext|> done", "don't we'll they've I'M 123 4567", "a" * 5000, "#$% & | < > " * 30, f"{PASSAGE} {PASSAGE}", "\x1c\x85 odd spaces here",
    ]
    out = [(i * 3, t, ["en", None, "xx", "fr"][i % 4], f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[6], (None, BASE, "en", "s", 3), (200, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def keyed(df, *names):
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=repr)


def test_substring_index_equals_brute_force(spark, docs, empty):
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, want = set(), []
    for r in order:
        own = words(r[1])
        gone = [False] * len(own)
        for i in range(len(own) - 19):
            key = tuple(own[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        kept = [w for w, g in zip(own, gone) if not g]
        want.append((r[0], len(own), len(own) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    for batches in (1, 4):
        got = substring_index.remove_repeated(spark, docs, batches=batches)
        assert keyed(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert substring_index.remove_repeated(spark, empty).count() == 0
    clash = docs.where("doc_id < 40").withColumns({"n_words": docs["n_chars"], "doc": docs["doc_id"], "places": docs["lang"]})
    assert substring_index.remove_repeated(spark, clash, keep=["doc_id", "n_words", "doc", "places"]).columns.count("n_words") == 1


def windows_seen_before(docs, size=20):
    """The (doc, start) of windows whose words start earlier, too."""
    seen, out = set(), set()
    for doc, text in sorted(docs):
        own = words(text)
        for i in range(len(own) - size + 1):
            key = tuple(own[i : i + size])
            if key in seen:
                out.add((doc, i))
            seen.add(key)
    return out


def starts_of(places):
    return {(r["doc"], s) for r in places.collect() for s in range(r["place"] >> 8, (r["place"] >> 8) + (r["place"] & 255))}


def made_batches(n=6, each=25):
    """Texts that share passages, parts of passages, and whole copies, in changing surroundings."""
    import random

    rnd = random.Random(9)
    passages = [[f"p{k}w{i}" for i in range(60)] for k in range(5)]
    out = []
    for doc in range(n * each):
        text = []
        for _ in range(3):
            text += [f"own{doc}x{rnd.randrange(10**6)}" for _ in range(rnd.randrange(30))]
            part = passages[rnd.randrange(5)]
            text += part[rnd.randrange(20) : rnd.randrange(35, 61)]
        out.append((doc, " ".join(text)))
        if doc % 10 == 9:
            out[-1] = (doc, out[doc // 2][1])
    return [out[i : i + each] for i in range(0, len(out), each)]


def test_substring_index_compacts_reopens_and_stays_exact(spark):
    """Batches against brute force; runs are merged level by level, and another object goes on with what is on disk."""
    from tarn.llm.common import Workspace

    batches, work = made_batches(), Workspace(spark, "t")
    want, got, done = windows_seen_before([d for b in batches for d in b]), set(), []
    index = substring_index.SubstringIndex(spark, work, buckets=5)
    levels = []
    for k, batch in enumerate(batches):
        if k == 3:
            index = substring_index.SubstringIndex(spark, Workspace(spark, "t", work.path), buckets=99)
            assert index.buckets == 5 and index.made == 3
        done += batch
        frame = lambda rows: spark.createDataFrame(rows, "doc long, text string")
        got |= starts_of(index.add(frame(batch), frame(done)))
        index.compact()
        levels.append([r["level"] for r in index.runs])
    assert got == want
    assert levels == [[0], [1], [1, 0], [2], [2, 0], [2, 1]]
    again = substring_index.SubstringIndex(spark, Workspace(spark, "t", work.path))
    assert again.runs == index.runs and again.last == len(done) - 1
    # A merged run is sorted, and holds each key once.
    for kind, (keys, _) in index.KINDS.items():
        rows = index._run(index.runs[0], kind)
        assert rows.count() == rows.select(*keys).distinct().count() > 0


def test_substring_index_joins_runs_in_place(spark):
    """Neither side of a merge is exchanged or sorted again but for the batch's own rows."""
    from tarn.llm.common import Workspace

    batches = made_batches(2)
    index = substring_index.SubstringIndex(spark, Workspace(spark, "t"), buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "doc long, text string")
    for k in range(2):
        index.add(frame(batches[k]), frame(batches[0] + batches[k]))
    with index._in_place():
        runs = [index._run(r, "spans").select("fp", "doc") for r in index.runs]
        plan = runs[0].join(runs[1].withColumnRenamed("doc", "other").hint("merge"), "fp", "full")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan


def test_substring_index_sends_a_row_for_each_key_and_task():
    """What a third of all documents hold leaves a task as one row; the rest travels under keys of its own."""
    import pyarrow as pa

    docs = [(i, f"{PASSAGE} own{i} " + " ".join(f"z{i}y{j}" for j in range(30))) for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], names=["doc", "text"])
    rows = pa.Table.from_batches(list(substring_index._entries([batch]))).to_pylist()
    keyed_rows = Counter(r["fp"] for r in rows if r["kind"] in (substring_index.INDEX, substring_index.SEVERAL))
    assert max(keyed_rows.values()) == 1
    spread = Counter(r["fp"] for r in rows if r["kind"] in (substring_index.VERIFY, substring_index.REPEAT))
    assert len(spread) == 300 and max(spread.values()) < 60  # a document's together
    kinds = Counter(r["kind"] for r in rows)
    assert kinds[substring_index.SEVERAL] >= 1 and kinds[substring_index.REPEAT] > 299 and kinds[substring_index.VERIFY] >= 300


def test_remove_repeated_takes_a_hot_passage_and_many_batches(spark):
    lines = [(i, f"start {i} {PASSAGE} {i} end") for i in range(12)]
    docs = spark.createDataFrame(lines, "doc_id long, text string")
    for batches in (1, 2, 3, 6):
        got = {r["doc_id"]: r["n_removed"] for r in substring_index.remove_repeated(spark, docs, batches=batches, with_text=True).collect()}
        assert got[0] == 0 and all(got[i] == 55 for i in range(1, 12))


def test_kept_text_keeps_line_ends():
    gone = np.array([False, True, True, False, False])
    assert substring_index.kept_text("a b c\nd\n e", gone) == "a d\n e"


def test_near_duplicates_equal_brute_force(spark, docs, empty):
    sets = {}
    for r in rows():
        own = words(r[1].lower() if r[1] and r[1].isascii() else r[1])
        own = (r[1] or "").encode().lower().split()
        s = frozenset(tuple(own[i : i + 5]) for i in range(len(own) - 4)) if len(own) >= 5 else frozenset([tuple(own)] if own else [])
        sets.setdefault(r[0], set()).add(s)
    parent = {d: d for d in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if a < b and any(s and t and 100 * len(s & t) >= 85 * len(s | t) for s in sets[a] for t in sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    got = minmax.near_duplicates(spark, docs.withColumn("rep", docs["lang"]), percent=85).collect()
    assert len(got) == len(rows())
    for r in got:
        if r["doc_id"] is None:
            assert r["kept"]
        else:
            assert (r["component_id"], r["kept"]) == (find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])
            assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
    assert minmax.near_duplicates(spark, empty).count() == 0


def test_near_duplicates_of_chains_and_repeated_ids(spark):
    """Members that only meet through others, more of them than are compared each with each; one id with two texts."""
    base = [f"w{i}" for i in range(200)]
    made = []
    for k in range(40):
        own = list(base)
        for j in range(k):
            own[(5 * j) % 200] = f"new{j}"
        made.append((k, " ".join(own)))
    made += [(500, "totally other words stand in this short text"), (500, "and yet more that nobody has written so far"), (501, "and yet more that nobody has written so far")]
    got = {r["doc_id"]: r["component_id"] for r in minmax.near_duplicates(spark, spark.createDataFrame(made, "doc_id long, text string"), percent=85).collect()}
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(196)} for k, t in made[:40]}
    label = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {k: got[k] for k in sets} == label
    assert got[500] == got[501] == 500


def test_near_duplicates_compare_repeated_rows_once(spark, monkeypatch):
    """Two ids of 10,000 equal rows each are two texts, and one comparison."""
    a = " ".join(f"w{i}" for i in range(60))
    df = spark.range(20_000).selectExpr("id % 2 AS doc_id", f"if(id % 2 = 0, '{a}', '{a} end') AS text")
    compared, confirm = [], minmax.confirm

    def counted(pairs, texts, percent):
        compared.append((pairs.count(), texts.count()))
        return confirm(pairs, texts, percent)

    monkeypatch.setattr(minmax, "confirm", counted)
    got = minmax.near_duplicates(spark, df, percent=85).groupBy("doc_id", "component_id", "kept").count().collect()
    assert {tuple(r) for r in got} == {(0, 0, True, 10_000), (1, 0, False, 10_000)} and compared == [(1, 2)]


def test_near_duplicates_inside_open_buckets(spark):
    """Texts that share a template but are too far apart meet in buckets; links among them are found, and only those."""
    import random

    rnd, made = random.Random(3), []
    base = [f"t{i}" for i in range(160)]
    for k in range(60):  # about 70 percent shared with each other
        made.append((k, " ".join(base + [f"own{k}x{i}" for i in range(30)])))
    for k in range(60, 75):  # links to a member each
        made.append((k, made[rnd.randrange(60)][1] + f" tail{k} more{k}"))
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in made}
    label = {k: k for k in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r["doc_id"]: r["component_id"] for r in minmax.near_duplicates(spark, spark.createDataFrame(made, "doc_id long, text string"), percent=85).collect()}
    assert got == label and len(set(label.values())) > 40


def test_minmax_estimates_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = np.concatenate([a[:2400], rng.integers(0, 1 << 63, 600, dtype=np.uint64)])
    want = 2400 / 3600
    x, y = (np.outer(s, minmax.multipliers(256)) for s in (a, b))
    same = np.concatenate([x.min(axis=0) == y.min(axis=0), x.max(axis=0) == y.max(axis=0)])
    assert abs(same.mean() - want) < 0.08


def test_encoding_and_counts_equal_the_library(docs, empty):
    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = sorted(bpe.encode_documents(docs.withColumn("n_tokens", docs["lang"]), path, ("n_tokens", "ids", "decoded", "ids_sha256")).collect(), key=repr)
    counts = sorted(token_fst.count_tokens(docs, path, 5).collect(), key=repr)
    want = defaultdict(list)
    for r in rows():
        want[r[0]].append(lib.encode(r[1] or "", add_special_tokens=False).ids)
    assert len(got) == len(counts) == len(rows())
    for r in got:
        assert r["ids"] in want[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
        assert r["decoded"] == lib.decode(r["ids"], skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
    for r in counts:
        assert r["n_tokens"] in map(len, want[r["doc_id"]]) and r["over_limit"] == (r["n_tokens"] > 5)
    assert bpe.encode_documents(empty, path).count() == token_fst.count_tokens(empty, path).count() == 0


def test_block_maps_compose_at_any_cut():
    path = P.path("word_bpe_49k.json")
    counter = token_fst.Counter(path)
    for text in (BASE, "a b<|endoftext|>c d", "nospaceatall" * 20, " lead and trail ", "é é \x1c x"):
        whole = counter.count(text)
        assert all(counter.count(text, n) == whole for n in (1, 2, 3, 7, 50))


def test_state_maps_compose_at_any_cut(monkeypatch):
    """Long words without white space against the library, cut into chunks of any size, over cleared states too."""
    import random

    path, rnd = P.path("word_bpe_49k.json"), random.Random(2)
    lib, counter = Tokenizer.from_file(path), token_fst.Counter(path)
    pieces = ["nospaceatall" * 90, "".join(rnd.choice("aeiourstnlm") for _ in range(3000)), "é" * 700, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéüß") for _ in range(1500))]
    for piece in pieces:
        want = len(lib.encode(piece, add_special_tokens=False).ids)
        assert counter.count(piece) == want
        (symbols,) = [p for p, _ in counter.vocab.parts(piece)]
        assert all(counter.transducer.count(symbols, chunk) == want for chunk in (1, 2, 5, 64, 1000))
    monkeypatch.setattr(token_fst, "MAX_STATES", 500)
    assert counter.transducer.count(counter.vocab.parts(pieces[1])[0][0], 7) == len(lib.encode(pieces[1], add_special_tokens=False).ids)


def test_state_map_is_a_map_of_states():
    """Of any state: its end and count are those of a walk from it."""
    transducer = token_fst.Transducer(token_fst.vocabulary(P.path("word_bpe_49k.json")))
    codes = list(b"internationalisation")
    whole = token_fst.StateMap(transducer, codes)
    for before in (b"", b"a", b"the", b"xyz", b"straw"):
        state = 0
        for c in before:
            state, _ = transducer.step(state, c)
        now, total = state, 0
        for c in codes:
            now, change = transducer.step(now, c)
            total += change
        assert whole(state) == (now, total)
        halves = token_fst.scan([token_fst.StateMap(transducer, codes[i : i + 3]) for i in range(0, len(codes), 3)])
        assert halves(state) == (now, total)


def test_counting_replaces_clashing_columns(docs):
    path = P.path("word_bpe_49k.json")
    clash = docs.withColumns({"N_Tokens": docs["lang"], "n_bytes": docs["lang"], "row": docs["source"]})
    assert token_fst.count_tokens(clash, path).columns == ["doc_id", "lang", "source", "n_chars", "row", "n_bytes", "n_tokens", "over_limit"]


def test_decoding_inverts_names(spark):
    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    ids = [lib.encode(t, add_special_tokens=False).ids for t in (BASE, "", "Ünïcödé 12")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ids)] + [(9, None)], "n int, ids array<long>")
    got = {r["n"]: r["decoded"] for r in bpe.decode_ids(df, path).collect()}
    assert got == {0: lib.decode(ids[0]), 1: "", 2: lib.decode(ids[2]), 9: ""}


def test_packing_places_every_piece_once(spark, docs, empty):
    files = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(files[1])
    want = Counter()
    for r in rows():
        ids = [*lib.encode(r[1] or "", add_special_tokens=False).ids, 2]
        for k, (start, n) in enumerate(packing.cut(len(ids))):
            want[r[0], k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
    got = packing.pack_documents(docs.withColumns({"length": docs["lang"], "offset": docs["lang"]}), *files).collect()
    assert {r["least_sequences"] for r in got} == {len({r["sequence_id"] for r in got})}  # proven to be the fewest
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack_documents(empty, *files).count() == 0


def exact_bins(items, capacity):
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity and bins[j] not in bins[:j]:
                go(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_bin_completion_is_optimal_on_small_inputs():
    import random

    random.seed(11)
    for _ in range(150):
        capacity = random.choice([20, 50, 100])
        items = sorted((random.randint(1, capacity) if random.random() < 0.5 else random.randint(capacity // 5, capacity // 2) for _ in range(random.randint(0, 12))), reverse=True)
        patterns, bound = packing.plan(Counter(items), capacity)
        held = Counter()
        for times, content in patterns:
            assert sum(x * k for x, k in content) <= capacity
            held.update({x: times * k for x, k in content})
        assert held == Counter(items)
        n = sum(t for t, _ in patterns)
        assert bound <= exact_bins(items, capacity) == n


def test_quality_counts_equal_brute_force(docs, empty):
    import re

    clash = docs.withColumns({"Kept": docs["lang"], "_n": docs["doc_id"], "hist_chars": docs["text"], "row": docs["lang"]})
    judged = quality.quality_rules(clash)
    assert judged.columns[:8] == [*docs.columns, "_n", "hist_chars", "row"] and "Kept" not in judged.columns
    got = judged.collect()
    assert all((r["_n"], r["hist_chars"], r["row"]) == (r["doc_id"], r["text"], r["lang"]) for r in got)
    assert len(got) == len(rows()) and quality.quality_rules(empty).count() == 0
    want = {}
    for r in rows():
        text = r[1] or ""
        own = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
        covered = {i + k for i in range(len(own) - 4) if grams[tuple(own[i : i + 5])] > 1 for k in range(5)}
        failed = len(own) < 10 or 100 * len(covered) > 20 * len(own)
        want[r[0], r[1]] = (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)
    for r in got:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want[r["doc_id"], r["text"]]
        assert not (r["kept"] and r["base_failed"])


def test_js_distance(spark):
    from pyspark.sql import functions as F

    def of(p, q):
        return spark.range(1).select(quality.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]

    assert of([1.0, 0.0], [1.0, 0.0]) == 0 and of([1.0, 0.0], [0.0, 1.0]) == 1
    assert 0.2 < of([0.7, 0.3], [0.3, 0.7]) < 0.5


def test_divergence_drops_junk_and_keeps_prose(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    refs = quality.REFERENCES
    prose = docs.where("doc_id = 0").first()["text"]
    junk = " ".join(f"{w.upper()}#$%|" for w in prose.split())
    made = spark.createDataFrame([(1, prose, "fr"), (2, junk, "fr"), (3, junk, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["kept"] for r in quality.verdict(quality.features(made, ["doc_id"]), refs).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_word_rule_alone_drops_texts_without_common_words(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    refs = quality.REFERENCES
    prose = docs.where("doc_id = 0").first()["text"]
    common = {w for ws in quality.COMMON_WORDS.values() for w in ws}
    salad = " ".join("x" * len(w) if w in common else w for w in prose.split(" "))
    made = spark.createDataFrame([(1, prose, "fr"), (2, salad, "fr"), (3, salad, None), (4, prose, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.verdict(quality.features(made, ["doc_id"]), refs).collect()}
    assert all(r["char_distance"] <= quality.QualityParams.max_char_distance and not r["base_failed"] for r in got.values())
    assert {i: r["kept"] for i, r in got.items()} == {1: True, 2: False, 3: False, 4: True}
    assert abs(got[2]["word_distance"] - quality.wordless_distance(refs["fr"][1])) < 1e-4
    bare = refs | {"fr": (refs["fr"][0], [0.0] * (len(refs["fr"][1]) - 1) + [1.0])}
    assert all(r["kept"] for r in quality.verdict(quality.features(made.where("lang = 'fr'"), ["doc_id"]), bare).collect())


def test_junk_does_not_move_the_references(spark):
    """A verdict does not depend on the other rows; a language without a reference is judged by the base rules."""
    from tarn.llm.common import tables

    docs = tables(spark, "/root/testdata/sf0.001", "documents")
    alone = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs).collect()}
    junk = docs.selectExpr("doc_id + 100000 AS doc_id", "upper(replace(text, ' ', '#% ')) AS text", "lang", "source", "n_chars")
    among = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs.union(junk).union(junk)).collect()}
    assert {k: v for k, v in among.items() if k < 100_000} == alone
    other = quality.quality_rules(junk.selectExpr("doc_id", "text", "'fi' AS lang")).collect()
    assert all(r["kept"] == (not r["base_failed"]) and r["char_distance"] is None for r in other) and any(r["kept"] for r in other)


def test_references_fitted_on_good_documents_agree_with_the_fixed_ones(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id")
    fitted = quality.references(quality.features(docs, ["doc_id"]))
    for name, (chars, words) in quality.REFERENCES.items():
        assert np.abs(np.array(fitted[name][0]) - chars).max() < 0.02 and np.abs(np.array(fitted[name][1]) - words).max() < 0.02


def test_toxicity_learns_from_training_folds_only(spark, empty):
    from tarn.llm.common import Workspace

    plain = "this is a calm report about weather and roads in the valley number"
    docs = [(i, f"{plain} {i}" if i % 4 else f"you zorgface and idiot number {i}, what a zorgface day") for i in range(400)]
    table = spark.createDataFrame([*docs, (None, "zorgface", ), (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in docs] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels, Workspace(spark, "t"))
    got = {r["doc_id"]: r for r in toxicity.score(table, model).collect()}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i, _ in docs)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[900]["score"] == got[901]["score"] < 0.5
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    flipped = spark.createDataFrame([(i, int(i % 4 == 0) ^ (i in held)) for i, _ in docs], "doc_id long, toxic int")
    again = toxicity.fit(table, flipped, Workspace(spark, "t"))
    assert np.allclose(model.weights, again.weights) and model.entries == again.entries
    none = toxicity.fit(empty, labels.limit(0), Workspace(spark, "t"))
    assert toxicity.score(empty, none).count() == 0


def test_toxicity_samples_rows_not_ids(spark, monkeypatch):
    """One labelled id on very many rows is one row of the sample; of conflicting labels the largest counts."""
    from tarn.llm.common import Workspace

    monkeypatch.setattr(toxicity, "SAMPLE", 30)
    docs = spark.range(3000).selectExpr("if(id < 2500, 7, id) AS doc_id", "concat('plain text ', id) AS text")
    labels = spark.range(3000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic").union(spark.createDataFrame([(7, 0), (7, 1)], "doc_id long, toxic int"))
    sample = toxicity.labelled_sample(docs, labels, Workspace(spark, "t"))
    assert 0 < sample.count() <= 30
    taught = toxicity.labelled_sample(docs.where("doc_id = 7"), labels.where("doc_id = 7"), Workspace(spark, "t"))
    assert [r["toxic"] for r in taught.collect()] == [1]


def test_toxicity_takes_long_repeated_and_clashing_rows(spark):
    from tarn.llm.common import Workspace

    rows = [(1, "calm words here " * 30_000, 9, 8), (1, "you idiot idiot scum", 7, 6), (1, "you idiot idiot scum", 7, 6), (None, None, 1, 2), (2, "", 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score int, predicted int")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), Workspace(spark, "t"))
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "score", "predicted"]
    scores = sorted((r["doc_id"] or 0, r["score"]) for r in got.collect())
    assert len(scores) == 5 and scores[2][1] == scores[3][1] > 0.5 > scores[1][1] and scores[0][1] == scores[4][1]


def test_voters_look_at_different_evidence():
    lexicon = toxicity.Lexicon([*toxicity.SEED, "zorg", "blixt-"])
    texts = {
        "seed": "what an idiot", "mined word": "zorg", "mined beginning of 5": "blixten", "several entries": "zorg idiot", "three occurrences": "zorg zorg zorg",
        "dense": "zorg and", "several lines": "zorg\nzorg", "address": "you are a zorg", "masked": "a f**k here", "inside a word": "an 1d10t", "shouting": "GO AWAY now", "exclamations": "no!!", "stretched": "noooo",
    }
    for name, text in texts.items():
        votes = lexicon.votes(lexicon.evidence(text))
        assert votes[toxicity.VOTERS.index(name)] == 1, name
    assert not lexicon.votes(lexicon.evidence("a calm text of plain words")).any() and not lexicon.votes(lexicon.evidence(None)).any()


def test_toxicity_finds_held_out_rows(spark):
    from pyspark.sql import functions as F

    from tarn.llm.common import Workspace

    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    taught = docs.select("doc_id", "text").join(labels, "doc_id")
    model = toxicity.fit(taught.repartition(4), labels, Workspace(spark, "t"))
    held = taught.where(toxicity.fold(F.col("doc_id")) == 0).select("doc_id", "text", "toxic")
    got = {(r["toxic"], r["predicted"]): r["count"] for r in toxicity.score(held, model).groupBy("toxic", "predicted").count().collect()}
    assert got[1, 1] >= 0.9 * (got[1, 1] + got[1, 0]) and got[0, 0] >= 0.98 * (got[0, 0] + got[0, 1])


def test_mining_keeps_entries_with_a_few_clean_rows(spark):
    rows = [(f"zorgface number {i}", 1) for i in range(27)] + [("a zorgface again", 0), ("one zorgface more", 0)]
    rows += [(f"blixtword number {i}", 1) for i in range(16)] + [("a blixtword again", 0)]
    rows += [(f"mixed number {i}", i % 2) for i in range(40)] + [(f"calm report number {i}", 0) for i in range(60)]
    got = toxicity.mine(spark.createDataFrame(rows, "text string, toxic int"))
    assert {"zorgface", "zorgfa-", "blixtword", "blixtw-"} <= set(got)
    assert not {"mixed", "number", "calm"} & set(got)


def test_label_model_recovers_voters():
    rng = np.random.default_rng(3)
    y = rng.random(40_000) < 0.2
    yes, no = np.array([0.6, 0.5, 0.7, 0.4]), np.array([0.02, 0.05, 0.01, 0.03])
    votes = (rng.random((len(y), 4)) < np.where(y[:, None], yes, no)).astype(float)
    m = toxicity.LabelModel.fit(len(y), votes.sum(axis=0), votes.T @ votes, 0.2)
    assert np.abs(m.if_toxic - yes).max() < 0.05 and np.abs(m.if_clean - no).max() < 0.03
