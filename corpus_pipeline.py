"""From raw documents to packed training sequences, in stages.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents, and rows that a stage keeps stay whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import language_id, minhash_dedup, packing, secret_scan, toxicity
from sluice.llm.common import load, perhaps_among, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language's score below which a text is in none of the known ones.
SURE = 0.35


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out texts without a letter and those no known language is likely for. A missing lang is filled in."""
    learned = language_id.collect_prototypes(language_id.language_prototypes(docs))
    found = language_id.identify_language(docs, learned, keep=tuple(COLUMNS))
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= SURE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out texts that the classifier predicts to be toxic."""
    learned = toxicity.train(docs, load(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, learned, keep=tuple(COLUMNS)).where("predicted = 0").select(COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near duplicates, the one with the smallest id.

    A row without id gets one from its text, larger than all others, so that equal
    texts without id are one document. Of rows that share an id the one with the
    longest text stays. Rows without words all stay, but for those that share an id
    with such rows.
    """
    made = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    keyed = docs.withColumn("__id", F.coalesce("doc_id", made))
    found = written(minhash_dedup.near_duplicates(keyed, "__id"), "near-duplicates").withColumnRenamed("doc_id", "__id")
    gone = found.where("not kept").select("__id").distinct()
    repeated = found.where("n_shingles > 0").groupBy("__id").agg(F.count("*").alias("n")).where("n > 1").select("__id")
    # rows whose id a bitmap surely lacks stay where they are read; the others are joined
    parted = perhaps_among(keyed, "__id", gone.unionByName(repeated))
    alone = parted.where("not __perhaps").select(COLUMNS)
    stays = parted.where("__perhaps").drop("__perhaps").join(gone, "__id", "left_anti")
    longest = F.max_by(F.struct(*COLUMNS), F.struct(F.coalesce(F.length("text"), F.lit(-1)), F.struct(*COLUMNS))).alias("row")
    once = stays.join(repeated, "__id", "left_semi").groupBy("__id").agg(longest).select("row.*")
    return alone.unionByName(stays.join(repeated, "__id", "left_anti").select(COLUMNS)).unionByName(once)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in place of each secret; n_chars follows the text."""
    clean = secret_scan.redact(secret_scan.scan_secrets(docs))
    changed = F.size("spans") > 0
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of equal cost, with their token ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("near_dedup", one_of_each),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: SQL cannot express the language model, the classifier or the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
