"""The corpus pipeline: documents in, packed training sequences out.

Five stages, each on all that the one before kept: toxic documents go, documents
that fail the quality rules go, one document of each group of near-duplicates
stays, passages seen before are cut out, and what is left is packed. A stage
takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns they were given. These are carried as one, so that none can clash with a
column that an operator makes, whatever its name.

Defined results: null and empty texts are not toxic, and fail the quality rules;
rows whose id is null pass the third stage unchanged; of rows that repeat an id and
its text the third stage keeps one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import minmax, packing, quality, substring_index, toxicity
from tarn.llm.common import Workspace, packed, tables, unpacked
from tarn.llm.queries import vocabulary_file

#: Word shingles that near-duplicates share at least, of all that they hold; op8 has its own value.
NEAR_PERCENT = minmax.PERCENT


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, tables(spark, sf_dir, "labels"), Workspace(spark, "toxicity"))
    scored = toxicity.score(docs.select(packed(docs), "text"), model)
    return unpacked(scored.where("predicted = 0"), {})


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(docs.select(packed(docs), "text", "lang"), keep=["row"])
    return unpacked(quality.kept_rows(judged), {})


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minmax.near_duplicates(spark, docs, percent=NEAR_PERCENT)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), packed(docs))
    kept = rows.join(found.where("kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id")
    # Rows that repeat an id and its text are copies of one document.
    kept = kept.dropDuplicates(["doc_id", "text_key"]).select("row")
    return unpacked(kept.union(rows.where("doc_id IS NULL").select("row")), {})


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("doc_id", "text", packed(docs, without=("text",)))
    found = substring_index.remove_repeated(spark, rows, keep=["row"], with_text=True)
    changed = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        own = F.col("row.n_chars")
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(own)
    return found.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary_file("byte_bpe_50k.tiktoken"), vocabulary_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("best_fit_packing", packing_stage),
]

#: A trained classifier and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again."""
    work = Workspace(spark, "pipeline")
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
