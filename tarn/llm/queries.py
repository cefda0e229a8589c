"""One registered query for each training-data operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe, impact_index, minmax, packing, quality, shard, substring_index, token_fst, toxicity, warc
from tarn.llm.common import Workspace, tables


def vocabulary_file(name: str) -> str:
    """The place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_index.remove_repeated(spark, tables(spark, sf_dir, "documents"))


def op2_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, folder = warc.archive_pages(spark, tables(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, folder).drop("url")


def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, Workspace(spark, "toxicity"))
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False))
    return toxicity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def op4_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, vocabulary_file("word_bpe_49k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op5_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    return packing.pack_documents(docs, vocabulary_file("byte_bpe_50k.tiktoken"), vocabulary_file("byte_bpe_50k.json"), end=2, capacity=1024)


def op6_impact_ordered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = impact_index.integer_vectors(tables(spark, sf_dir, "embeddings"))
    return impact_index.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op7_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text")
    return token_fst.count_tokens(docs, vocabulary_file("word_bpe_49k.json"), limit=2048)


def op8_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(spark, tables(spark, sf_dir, "documents"), percent=85)


def op9_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents themselves are dealt; sizes and checksums are those of the dealt rows."""
    placed = shard.shard_rows(tables(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)
    text = F.coalesce(F.col("text"), F.lit(""))
    size, checksum = (F.octet_length(text) + 8).cast("long"), F.crc32(text.cast("binary"))
    return placed.select("doc_id", size.alias("size"), checksum.alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(tables(spark, sf_dir, "documents"), keep=["doc_id"])


QUERIES = {
    "op1_substring_index": op1_substring_index,
    "op2_warc_normaliser": op2_warc_normaliser,
    "op3_weak_supervision": op3_weak_supervision,
    "op4_speculative_bpe": op4_speculative_bpe,
    "op5_bin_completion_packing": op5_bin_completion_packing,
    "op6_impact_ordered_topk": op6_impact_ordered_topk,
    "op7_transducer_counts": op7_transducer_counts,
    "op8_minmax_near_duplicates": op8_minmax_near_duplicates,
    "op9_hypergeometric_shards": op9_hypergeometric_shards,
    "op10_divergence_rules": op10_divergence_rules,
}

#: Words of a text, as a list.
_WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE_SQL: dict[str, str] = {
    "op1_substring_index": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
        windows AS (
            SELECT doc_id, pos, array_to_string(list_slice(ws, pos, pos + 19), ' ') AS k
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS pos FROM d WHERE len(ws) >= 20)
        ),
        later AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth FROM windows) WHERE nth > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS i FROM later),
        words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op2_warc_normaliser": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS data, sha1(coalesce(html, '')) AS h FROM pages),
        kept AS (SELECT h, max(page_id) AS kept_id FROM p GROUP BY h)
        SELECT page_id, CAST(octet_length(data) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
                   ((16 * (strpos('0123456789abcdef', substr(h, 1 + (5 * i) // 4, 1)) - 1)
                     + strpos('0123456789abcdef', substr(h, 2 + (5 * i) // 4, 1)) - 1) >> (3 - (5 * i) % 4)) & 31 AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN page_id = kept_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> kept_id THEN kept_id END AS refers_to
        FROM p JOIN kept USING (h)
    """,
    "op8_minmax_near_duplicates": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(list_slice(ws, pos, pos + 4), ' ') AS k
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS pos FROM d WHERE len(ws) > 0)
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
        SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach.y) AS component_id, min(reach.y) = d.doc_id AS kept
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id
    """,
    "op6_impact_ordered_topk": """
        WITH fit AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM fit q JOIN fit c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
        FROM scored QUALIFY "rank" <= 5
    """,
}


def _quality_sql(params: quality.QualityParams = quality.QualityParams()) -> str:
    """The quality rules; a row for each document and reference that it may be held against, the nearest of which counts."""
    refs = params.references
    share = {x: params.max_word_share * quality.wordless_distance(refs[x][1]) or 1.0 for x in refs}
    table = ", ".join(f"('{x}', {refs[x][0]}, {refs[x][1]}, {params.common_words[x]}, {share[x]!r})" for x in refs)
    classes = [r"\P{Lu}+", "[^0-9]+", None, f"[^{quality.SYMBOLS}]+", "[^" + quality.PUNCTUATION.replace("'", "''").replace("-", r"\-") + "]+"]
    counts = ", ".join("length(t) - word_chars" if c is None else f"length(regexp_replace(t, '{c}', '', 'g'))" for c in classes)

    def distance(p: str, q: str) -> str:
        part = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
        pair = f"({part.format('z[1]', 'z[2]')} + {part.format('z[2]', 'z[1]')}) / 2"
        return f"round(sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: {pair})))), 6)"

    return f"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, nullif(lang, '') AS lang, coalesce(text, '') AS t, {_WORDS.format("text")} AS ws FROM documents
        ),
        grams AS (SELECT r, pos, list_slice(ws, pos, pos + 4) AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS pos FROM d)),
        twice AS (SELECT r, pos FROM grams QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
        covered AS (SELECT r, count(DISTINCT pos + o) AS n FROM twice, (SELECT unnest(range(0, 5)) AS o) GROUP BY r),
        lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
        counted AS (
            SELECT d.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                   CAST(length(regexp_replace(t, '[^{quality.SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
            FROM d JOIN lines USING (r) LEFT JOIN covered USING (r)
        ),
        refs AS (SELECT * FROM (VALUES {table}) AS v(ref, chars, words, common, most)),
        h AS (SELECT *, list_transform([{counts}], lambda x: CAST(x AS DOUBLE)) AS cs FROM counted),
        held AS (
            SELECT r, ref, most, chars, words, list_transform(list_append(cs, length(t) - list_sum(cs)), lambda x: x / length(t)) AS p,
                   list_transform(common, lambda c: CAST(len(list_filter(ws, lambda x: x = c)) AS DOUBLE)) AS found, n_words, length(t) AS n
            FROM h JOIN refs ON ref = lang OR lang IS NULL
        ),
        far AS (
            SELECT r, ref, most, CASE WHEN n >= {params.guard_chars} THEN {distance("p", "chars")} END AS cd,
                   CASE WHEN n_words >= {params.guard_words} THEN {distance("list_transform(list_append(found, n_words - list_sum(found)), lambda x: x / n_words)", "words")} END AS wd
            FROM held
        ),
        nearest AS (SELECT r, min(cd) AS char_distance, min({{'d': wd, 'most': most}}) FILTER (WHERE wd IS NOT NULL) AS w FROM far GROUP BY r),
        judged AS (
            SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, w.d AS word_distance,
                   n_words < {params.min_words} OR 100 * n_repeat_words > {params.max_repeat_percent} * n_words AS base_failed,
                   coalesce(char_distance > {params.max_char_distance}, FALSE) OR coalesce(w.d > w.most, FALSE) AS too_far
            FROM counted LEFT JOIN nearest USING (r)
        )
        SELECT * EXCLUDE (too_far), NOT base_failed AND NOT too_far AS kept FROM judged
    """


ORACLE_SQL["op10_divergence_rules"] = _quality_sql()
