"""Corpus pipeline: quality rules, near-duplicate removal, passage dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; run() applies
them to ``documents``. Every stage but the last returns the columns of documents, and an empty table gives
an empty result.

Null texts count as empty and go in the first stage, as too short. Rows without an id are judged by their text in the
stages of quality and decontamination and are neither duplicates of anything nor cut. Rows that share an id stand for one document in
the near-duplicate stage and go together; in the others each is judged by its own text. Of equal documents the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwise.llm.bpe_trie import bpe_encode_decode
from tierwise.llm.common import Stored
from tierwise.llm.decontaminate import decontaminate
from tierwise.llm.entry import table, vocabulary
from tierwise.llm.ngram_join import ngram_jaccard_join
from tierwise.llm.quality_rules import quality_rules
from tierwise.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    The filter names a row number too, which keeps Spark from repeating the rules' expressions in a filter below them.
    """
    judged = quality_rules(docs, table(spark, sf_dir, "labels")).select(*COLUMNS, "kept", F.monotonically_increasing_id().alias("_row"))
    return judged.where("kept and _row >= 0").select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each class of near duplicates: five-word shingles, similarity of 0.8 or more."""
    found = ngram_jaccard_join(docs, n=5, threshold=80)
    drop = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*COLUMNS)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that a smaller id holds; documents left without words go."""
    cut = substring_dedup(docs, window=50, passthrough=["lang", "source", "n_chars"])
    cut = cut.where("n_removed = 0 or n_removed < n_words")
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", chars).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate. Rows are told apart by id and text, so each is judged by its own."""
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_row"))
    judged = decontaminate(rows.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = judged.where("contaminated").select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(bad, "_row", "left_anti").select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left. Workers of the stages before are reused, so few words are remembered."""
    return bpe_encode_decode(docs, vocabulary("word_bpe_49k.json"), kept=1 << 15).select("doc_id", "n_tokens", "ids", "ids_sha256")


STAGES = [
    ("quality_rules", rules_stage),
    ("near_duplicates", near_duplicates_stage),
    ("passages", passages_stage),
    ("decontamination", decontamination_stage),
    ("tokens", tokens_stage),
]

#: Similarity classes and byte-pair encoding are beyond SQL; tests/llm/test_pipeline.py holds run() against a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each stored and reread as the next one's input."""
    stored = Stored(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored.keep(docs)
    return docs
