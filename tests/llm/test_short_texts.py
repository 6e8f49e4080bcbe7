"""What the pipeline's language stage does with clean short texts."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from trackwell.llm import language_id


def test_clean_short_texts_stay(spark, medium):
    """Pieces of 20 to 99 characters of the table's own documents, none of them learned from: how many are rejected."""
    docs = spark.read.parquet(f"{medium}/documents.parquet").where("text is not null and lang is not null and length(text) > 400")
    langs, p = language_id.learned(docs.where("doc_id % 2 = 0"))
    asked = docs.where("doc_id % 2 = 1").select("doc_id", "lang", "source", "n_chars", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.substring("text", 101, n).alias("text")) for n in (20, 40, 60, 99)])).alias("s"))
    asked = asked.select("doc_id", "source", "n_chars", F.col("lang").alias("own"), "s.n", "s.text").where("text rlike '[a-zA-Z]{3}'")
    found = language_id.predicted(asked.withColumn("lang", F.lit(None).cast("string")), langs, p)
    told = found.groupBy("n").agg(F.avg((F.col("background") > corpus_pipeline.STRANGE).cast("int")).alias("lost"), F.avg((F.col("lang_pred") == F.col("own")).cast("int")).alias("right"), F.count("*").alias("texts")).orderBy("n").collect()
    print("short texts", [(r["n"], r["texts"], round(r["lost"], 4), round(r["right"], 4)) for r in told])
    assert all(r["lost"] <= (0.05 if r["n"] <= 20 else 0.01) for r in told)
    assert told[-1]["right"] > 0.95
