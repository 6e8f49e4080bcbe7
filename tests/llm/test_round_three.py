"""Equal rows that recur very often, labels that contradict each other, scripts without spaces."""

from __future__ import annotations

import random
import zlib

import numpy as np

from pyspark.sql import functions as F

from trackwell.llm import nearest, packing, toxicity


def test_equal_rows_are_packed_apart(spark):
    """A third of all rows is one empty text without id, another third one short text: each gets a place of its own."""
    rows = [(None, None)] * 3000 + [(7, "ein kurzer Text")] * 3000 + [(i, f"text {i} of its own") for i in range(100, 3100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("times", F.lit("clash")).withColumn("share", F.lit(0))
    got = packing.packed(docs, capacity=256, units=64, salt_rows=70).collect()
    assert len(got) == 9000 and sum(r["doc_id"] is None for r in got) == 3000 == sum(r["doc_id"] == 7 for r in got)
    used: dict[int, list] = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(used) == -(-sum(r["length"] for r in got) // 256)


def test_the_higher_label_of_equal_texts_counts(spark):
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5][:1000]
    docs = spark.createDataFrame([(i, f"text {n // 2}") for n, i in enumerate(ids)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, n % 2 * (n // 2 % 2)) for n, i in enumerate(ids)], "doc_id long, toxic int")
    want = {f"text {k}": k % 2 for k in range(500)}
    for parts in (1, 7):
        got = toxicity.sampled(docs.repartition(parts), labels.repartition(parts, "doc_id"), 4000).collect()
        assert {r["text"]: r["toxic"] for r in got} == want and len(got) == 500


def test_toxic_passages_without_spaces(spark):
    """A term inside long runs of letters, as in scripts without spaces, is learned and found."""
    rng = random.Random(9)
    signs = [chr(0x4E00 + i) for i in range(400)]
    run = lambda n: "".join(rng.choices(signs, k=n))
    term = "毒辱骂恶劣词语坏"
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5][:1600]
    bad = lambda k: k % 2 == 0
    docs = spark.createDataFrame([(i, run(40) + (term if bad(k) else "") + run(40)) for k, i in enumerate(ids)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bad(k))) for k, i in enumerate(ids)], "doc_id long, toxic int")
    model = toxicity.learned(docs, labels)
    assert all(model.score(run(60) + term + run(30)) >= 0.5 for _ in range(20))
    assert all(model.score(run(90)) < 0.5 for _ in range(20))


def test_short_words_are_windows():
    assert set(toxicity.window_counts("An ox is ok")) == {"an", "ox", "is", "ok"}
    assert len(toxicity.window_counts("x" * 17)) == 1 and sum(toxicity.window_counts("abcdefghijklmnopqrst").values()) == 13


def test_a_crowded_cell_has_a_tree_of_its_own(spark):
    """Most vectors fall into few cells; parts of them are found by a second tree, and recall stays."""
    rng = np.random.default_rng(11)
    rows = np.vstack([rng.normal(0, 1, (4000, 24)) * np.r_[[3.0] * 4, [0.4] * 20], rng.normal(60, 0.5, (200, 24))])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    asked = F.col("vec_id") % 50 == 0
    got = nearest.nearest(df, asked, levels=2, cell_rows=500, part_rows=100, part_sample=400, block=20).collect()
    found: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, len(rows), 50):
        d = np.sqrt(((rows - rows[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(len(d)), d)) if i != q][:10]
        assert len(found[q]) == 10 and all(abs(s - d[i]) < 1e-9 for i, s in found[q])
        hits += len({i for i, _ in found[q]} & set(want))
    assert hits / (10 * len(found)) >= 0.95


def test_long_vectors(spark):
    """Vectors of 3,000 numbers, and a sample of bounded bytes."""
    rng = np.random.default_rng(12)
    rows = rng.normal(size=(120, 3000))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = nearest.nearest(df, F.col("vec_id") == 7, k=3, cell_rows=30, part_rows=40, sample_bytes=1 << 20, sure=0.9999).orderBy("rank").collect()
    d = np.sqrt(((rows - rows[7]) ** 2).sum(1))
    assert [r["vec_id"] for r in got] == [int(i) for i in np.argsort(d)[1:4]]
