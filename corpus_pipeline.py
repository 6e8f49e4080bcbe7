"""A corpus pipeline of five stages over documents: language, near copies, secrets, mix, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of documents;
the last returns the packing plan. run() writes each stage's result as Parquet into the shared folder and reads it
again. SQL can't express the stages (trigram mixtures, SimHash, randomness tests, hashed permutations, a public
vocabulary): ORACLE_SQL is None, and tests hold each stage against a plain version on the smallest table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwell.llm import language_id, mixing, packing, secret_scan, simhash
from trackwell.llm.common import scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None
STRANGE = 0.7


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language, and sets lang to the predicted one; `und` (no letters, no text) goes, and
    so do documents whose letters are in no learned language: a uniform background explains over 0.7 of them better."""
    langs, p = language_id.learned(docs)
    found = language_id.predicted(docs, langs, p).where(f"lang_pred != 'und' and background <= {STRANGE}")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies."""
    return simhash.one_of_each(docs).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret; every document stays."""
    return secret_scan.redacted(docs).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mix of as many tokens as came in, no source repeated more than twice; a repeated document is a repeated row."""
    rows, _ = mixing.mixed(docs, entropy=None, repeats=2.0)
    return rows.select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4,096 tokens: a row for each piece with its sequence and offset."""
    return packing.packed(docs)


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("temperature_mix", mixing_stage),
    ("pattern_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
