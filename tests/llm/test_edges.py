"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for all operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trackwell.llm import language_id, mixing, multiset_hash, nearest, packing, preference, secret_scan, simhash, suffix_dedup, tokenizing, toxicity

CLASHES = ("key", "value", "h", "tokens", "words", "n", "fp", "epoch", "_bucket", "score", "component", "piece", "node", "least", "block", "base")
LONG = "words and lines of text " * 40_000
ROWS = [
    (1, "a plain text of a few words", "en", "web", 27), (1, "a plain text of a few words", "en", "web", 27), (2, "a plain text of a few words", "en", None, 27),
    (3, None, "en", "web", None), (4, "", None, "web", 0), (None, "without an id", "en", "web", 13), (None, None, None, None, None), (5, LONG, "en", "books", len(LONG)),
    (6, "\x00 ퟿ \U0001f600 password = hunter2222", "en", "web", 30), (7, "!!! 123", "de", "web", 7), (9, "ein kurzer Text in einer andern Sprache", "de", "web", 39),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def odd(spark, rows=ROWS):
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit("clash"))
    return docs


OPERATORS = {
    "mixing": (lambda d, lab: mixing.mixed(d)[0], None),
    "language": (lambda d, lab: language_id.identify(d), len(ROWS)),
    "multiset": (lambda d, lab: multiset_hash.fingerprinted(d), len(ROWS)),
    "simhash": (lambda d, lab: simhash.near_duplicates(d), len(ROWS)),
    "dedup": (lambda d, lab: simhash.one_of_each(d), 8),
    "packing": (lambda d, lab: packing.packed(d), None),
    "secrets": (lambda d, lab: secret_scan.secrets(d), len(ROWS)),
    "redacted": (lambda d, lab: secret_scan.redacted(d), len(ROWS)),
    "tokens": (lambda d, lab: tokenizing.token_counts(d), len(ROWS)),
    "repeats": (lambda d, lab: suffix_dedup.digests(d), len(ROWS)),
    "toxicity": (lambda d, lab: toxicity.toxicity(d, lab), len(ROWS)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    f, n = OPERATORS[name]
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 1), (9, 0, None), (1, 1, 1)], LABELS)
    rows = f(odd(spark), labels).collect()
    assert n is None or len(rows) == n
    assert rows


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    f, _ = OPERATORS[name]
    assert f(odd(spark, []), spark.createDataFrame([], LABELS)).count() == 0


def test_pipeline_stages_on_odd_rows(spark, small):
    for rows in (ROWS, []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, small)
            assert docs.columns == list(corpus_pipeline.COLUMNS), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() >= bool(rows)


def test_pipeline_over_the_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    ids = {r["doc_id"] for r in docs.collect()}
    language, dedup, secret, mix, pack = (f for _, f in corpus_pipeline.STAGES)
    known = language(spark, docs, small)
    kept = {r["doc_id"] for r in known.collect()}
    lettered = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert kept == lettered
    unique = dedup(spark, known, small)
    one = [r["doc_id"] for r in unique.collect()]
    assert len(one) == len(set(one)) and set(one) <= kept
    texts = {r["text"] for r in known.collect()}
    assert len({r["text"] for r in unique.collect()}) == len(one) <= len(texts)
    clean = secret(spark, unique, small)
    assert {r["doc_id"] for r in clean.collect()} == set(one)
    mixed = mix(spark, clean, small)
    assert {r["doc_id"] for r in mixed.collect()} <= set(one)
    packed = pack(spark, mixed, small)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in mixed.collect()} <= ids


BIG = 1 << 60


@pytest.mark.parametrize("name", OPERATORS)
def test_large_ids_beside_a_null_one_stay_exact(spark, name):
    rows = [(BIG + i, f"text number {i} with words of its own {i * i}", "en", "web", 40) for i in range(1, 6)] + [(None, "a row without an id", "en", "web", None)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    labels = spark.createDataFrame([(BIG + 1, 1, 1), (BIG + 2, 1, 0), (BIG + 3, 0, 0)], LABELS)
    got = {r["doc_id"] for r in OPERATORS[name][0](docs, labels).select("doc_id").collect()}
    assert got >= {BIG + i for i in range(1, 6)}
    assert got - {BIG + i for i in range(1, 6)} <= {None}


def test_stages_keep_large_ids_and_null_counts(spark):
    rows = [(BIG + 1, "the words of a text in a language", "en", "web", BIG + 7), (None, "another text of the language with words", "en", "web", None)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    langs, p = language_id.learned(docs)
    assert {(r["doc_id"], r["n_chars"]) for r in language_id.predicted(docs, langs, p).collect()} == {(BIG + 1, BIG + 7), (None, None)}
    assert {r["doc_id"] for r in secret_scan.redacted(docs).collect()} == {BIG + 1, None}


def test_preference_pairs_of_odd_turns(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "x" * 200_000), (1, 1, "assistant", "x" * 200_000), (0, 0, None, None), (0, 1, "assistant", None), (None, 0, "user", "lost"),
        (2, None, "user", ""), (3, 0, "user", "only"), (4, 0, "assistant", "<|im_end|>"), (5, 0, "user", "q"), (5, 1, "assistant", "a"), (5, 1, "assistant", "b"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for c in ("pair_id", "chosen", "at", "reply", "n"):
        df = df.withColumn(c, F.lit("clash"))
    got = {r["pair_id"]: r for r in preference.formatted(preference.swapped_reply_pairs(df)).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5}
    assert got[1]["prompt_turns"] == 2 and got[1]["chosen_spans"] == f"22:{22 + 200_000 + 11}"  # the repeated turn is a turn
    assert got[2]["status"] == got[3]["status"] == "equal"
    assert "<|im_end|>\n" in got[4]["chosen"] and "< |im_end|>" in got[4]["chosen"]
    assert got[0]["status"] == "pair" and got[0]["rejected"].count("x") == 200_000
    assert preference.formatted(preference.swapped_reply_pairs(df.limit(0))).count() == 0


def test_repeated_and_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [5.0, 5.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, [0.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("qid", F.lit("clash")).withColumn("part", F.lit(1))
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in nearest.nearest(df, F.lit(True)).collect())
    assert got == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 2), (3, 2, 1)]
