import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_keep_their_contract(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf)
        where = str(tmp_path / f"{i}")
        made.write.parquet(where)
        made = spark.read.parquet(where)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == columns, name
            kept.append(made.count())
            if name != "substring_dedup":
                assert made.exceptAll(docs).count() == 0  # rows stay as they are
            docs = made
        else:
            held = made.agg(F.count_distinct("doc_id"), F.sum("length"), F.count_distinct("sequence_id")).first()
            assert held[0] == docs.count() and held[2] * 1024 >= held[1]
    assert kept[0] > kept[1] > kept[2] >= kept[3] == kept[4] > kept[0] // 2
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "substring_dedup", "best_fit_packing"]


def test_near_duplicate_stage_equals_brute_force(spark, sf):
    """The documents, and pairs of 196 shingles each that share 186, 176 (0.815) and 173 (0.790) of them."""
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    for k, changed in enumerate((10, 20, 23)):
        own = [f"w{k}x{i}" for i in range(200)]
        texts[900_000 + 2 * k] = " ".join(own)
        texts[900_001 + 2 * k] = " ".join(own[: 200 - changed] + [f"new{k}x{i}" for i in range(changed)])
    sets = {}
    for d, text in texts.items():
        own = (text or "").encode().lower().split()
        sets[d] = {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()
    label = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    for _ in links:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf).collect()}
    assert got == {d for d in sets if label[d] == d}
    assert not {900_001, 900_003} & got and 900_005 in got


def test_stages_take_any_columns_and_rows(spark, sf, tmp_path):
    """Columns named like those the operators make, in other cases too; nulls, an empty text, repeated rows, an empty table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "some words here", "xx", None, 15)], docs.schema)
    odd = odd.union(docs.limit(5)).union(docs)
    more = {"Score": "1", "predicted": "'p'", "N_words": "2L", "_n": "3", "hist_chars": "'h'", "hist_en": "'e'", "Kept": "true", "row": "'r'", "set_key": "'k'", "component_id": "4", "kept_text": "'t'", "_places": "5", "kept_sha256": "'s'", "sequence_id": "6"}
    odd = odd.withColumns({k: F.expr(v) for k, v in more.items()})
    for docs in (odd, odd.limit(0)):
        columns, left = docs.columns, docs.count()
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, docs, sf)
            where = str(tmp_path / f"{left}-{i}-{name}")
            made.write.parquet(where)
            made = spark.read.parquet(where)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert made.columns == columns and made.where(" AND ".join(f"`{k}` = {v}" for k, v in more.items())).count() == made.count(), name
                docs = made
        assert left == 0 or 0 < docs.count() < left


def test_pipeline_equals_brute_force(spark, sf):
    """run() against plain Python and DuckDB, stage by stage, down to the tokens of every packed piece."""
    import re
    import zlib

    import duckdb
    import numpy as np
    import pandas as pd
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from tarn.llm import packing, toxicity
    from tarn.llm.common import Workspace, tables
    from tarn.llm.queries import ORACLE_SQL

    docs = {r["doc_id"]: (r["text"], r["lang"]) for r in tables(spark, sf, "documents").collect()}
    model = toxicity.fit(tables(spark, sf, "documents"), tables(spark, sf, "labels"), Workspace(spark, "t"))
    lexicon = toxicity.Lexicon(model.entries)
    odds = {d: lexicon.features(lexicon.evidence(t)) @ model.weights[:-1] + model.weights[-1] for d, (t, _) in docs.items()}
    docs = {d: v for d, v in docs.items() if odds[d] < 0}

    duck = duckdb.connect()
    duck.register("documents", pd.DataFrame([(d, t, lang) for d, (t, lang) in docs.items()], columns=["doc_id", "text", "lang"]))
    good = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({ORACLE_SQL['op10_divergence_rules']}) WHERE kept").fetchall()}
    docs = {d: v for d, v in docs.items() if d in good}

    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t) for d, (t, _) in docs.items()}
    lower = {d: [w.encode().lower() for w in ws] for d, ws in words.items()}
    sets = {d: {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} for d, ws in lower.items()}
    label = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    for _ in links:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    docs = {d: v for d, v in docs.items() if label[d] == d}

    seen, texts = set(), {}
    for d in sorted(docs):
        gone = [False] * len(words[d])
        for i in range(len(words[d]) - 19):
            key = tuple(words[d][i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", docs[d][0])]
        runs, text = [], docs[d][0]
        for i, (start, end) in enumerate(places):
            if not gone[i]:
                if i and not gone[i - 1] and runs:
                    runs[-1] = (runs[-1][0], end)
                else:
                    runs.append((start, end))
        texts[d] = " ".join(text[a:b] for a, b in runs) if any(gone) else text

    lib, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), set()
    for d, text in texts.items():
        ids = [*lib.encode(text, add_special_tokens=False).ids, 2]
        want |= {(d, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())) for k, (start, n) in enumerate(packing.cut(len(ids)))}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        ends = [0, *np.cumsum([n for _, n in sorted(places)]).tolist()]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 1024
    (least,) = {r["least_sequences"] for r in got}
    assert least <= len(held) <= least + 1
