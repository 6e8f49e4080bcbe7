"""Language identification, toxicity and nearest neighbours: held-out quality, recall, defined edge results."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackwell.llm import language_id, nearest, toxicity


def test_language_held_out(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    judged = [(r, got[r["doc_id"]]) for r in rows if r["lang"] and r["text"] and len(r["text"]) > 40]
    for r, g in judged:
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= g["score"] <= 1
    held = [r["lang"] == g["lang_pred"] for r, g in judged if g["held_out"]]
    assert np.mean(held) > 0.95


def test_mixture_finds_both_languages(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").where("lang is not null and n_chars between 400 and 4000")
    langs, p = language_id.learned(docs)
    two = [docs.where(F.col("lang") == lang).orderBy("doc_id").first()["text"][:400] for lang in langs[:2]]
    chosen, share, _ = language_id.languages(language_id.trigram_bins(" ".join(two)), p)
    assert {0, 1} <= set(chosen)
    assert abs(share.sum() - 1) < 1e-6
    chosen, share, _ = language_id.languages(language_id.trigram_bins(two[0]), p)
    assert chosen[int(np.argmax(share))] == 0 and share.max() > 0.8


def test_language_without_letters_or_learning(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "123 !?", "en"), (None, "words", None), (5, "", "en")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identify(docs).where("doc_id is not null").collect()} == {"und"}
    assert language_id.identify(docs.where("doc_id > 99")).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels.where("toxic is not null"), "doc_id").where("held_out").collect()
    truth, score = np.array([r["toxic"] for r in got]), np.array([r["score"] for r in got])
    assert ((score >= 0) & (score <= 1)).all() and all(r["predicted"] == int(r["score"] >= 0.5) for r in got)
    above = np.mean([(a > score[truth == 0]).mean() + 0.5 * (a == score[truth == 0]).mean() for a in score[truth == 1]])
    print("toxicity: held-out AUC", above, "positives", truth.sum(), "recall", (score[truth == 1] >= 0.5).mean(), "false alarms", (score[truth == 0] >= 0.5).mean())
    assert above > 0.9
    assert (score[truth == 0] >= 0.5).mean() < 0.05


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "words in a text"), (2, None), (3, ""), (None, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.toxicity(docs, none).collect()] == [0.0] * 4
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def exact(v: dict[int, np.ndarray], ask: list[int], k: int) -> dict[int, list]:
    ids = np.array(sorted(v))
    x = np.stack([v[i] for i in ids])
    out = {}
    for q in ask:
        d = np.sqrt(((x - v[q]) ** 2).sum(1))
        out[q] = [(float(d[j]), int(ids[j])) for j in np.lexsort((ids, d)) if ids[j] != q][:k]
    return out


def test_nearest_recall(spark, medium):
    rows = spark.read.parquet(f"{medium}/embeddings.parquet")
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    v = {i: x for i, x in v.items() if np.isfinite(x).all() and x.any()}
    expected = exact(v, [i for i in v if i % 10 == 0], 10)
    got: dict = {}
    for r in nearest.nearest(rows, F.col("vec_id") % 10 == 0, cell_rows=64).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert set(got) == set(expected)
    recall = np.mean([len({i for _, i in got[q]} & {i for _, i in e}) / len(e) for q, e in expected.items()])
    print("recall", recall)
    assert recall >= 0.95
    for q, found in got.items():
        assert found == sorted(found) and len(found) == 10
        assert all(abs(d - np.sqrt(((v[i] - v[q]) ** 2).sum())) < 1e-9 for d, i in found)


def test_nearest_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (100, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("clash")).withColumn("v", F.lit(0))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest.nearest(vectors, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (0, 4, 3), (100, 1, 0), (100, 2, 1), (100, 3, 2), (100, 4, 3)]
    assert nearest.nearest(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_nearest_in_parts_and_blocks(spark, medium):
    """Cells in several parts and queries in several blocks give the same rows as one of each; repeated ids count once."""
    rows = spark.read.parquet(f"{medium}/embeddings.parquet")
    again = rows.unionByName(rows.where("vec_id % 7 = 0")).unionByName(rows.where("vec_id = 10").withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(1000).cast("float"))))
    ask = F.col("vec_id") % 10 == 0
    whole = sorted(map(tuple, nearest.nearest(rows, ask, sure=0.999999).collect()))
    parts = sorted(map(tuple, nearest.nearest(again, ask, sure=0.999999, cell_rows=100, part_rows=20, block=5).collect()))
    assert len(whole) == len(parts)
    assert np.mean([a == b for a, b in zip(whole, parts)]) > 0.99


def test_rows_come_in_order_of_their_projections():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((700, 16))
    directions = rng.standard_normal((16, 8))
    cell = nearest.Cell(v, [np.array([i]) for i in range(700)], directions, 64)
    q = rng.standard_normal(16)
    got = list(cell.in_order(q @ directions))
    far, row = np.concatenate([d for d, _ in got]), np.concatenate([r for _, r in got])
    assert sorted(row.tolist()) == list(range(700)) and (np.diff(far) >= 0).all()
    assert np.allclose(far, ((v[row] @ directions - q @ directions) ** 2).sum(1))


def test_letters_beyond_the_second_plane_are_letters():
    assert len(language_id.trigram_bins(chr(0x30000) + chr(0x31350))) == 2
    assert len(language_id.trigram_bins("\U0001f600 12")) == 0


def slow_mixture(p, n, rounds=400):
    """Expectation-maximisation as it is written in books, number by number."""
    share = [1 / len(p[0])] * len(p[0])
    for _ in range(rounds):
        new = [0.0] * len(share)
        for row, count in zip(p, n):
            whole = sum(a * b for a, b in zip(row, share))
            for j, (a, b) in enumerate(zip(row, share)):
                new[j] += count * a * b / whole
        share = [x / sum(n) for x in new]
    return share


def test_mixtures_against_plain_ones():
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.ones(60), 3).T
    for true in ([0.6, 0.3, 0.1], [0.2, 0.2, 0.6], [0.05, 0.9, 0.05]):
        n = rng.multinomial(3000, p @ true).astype(float)
        share, value = language_id.mixture(p, n, rounds=400)
        plain = slow_mixture(p.tolist(), n.tolist())
        assert np.abs(share - plain).max() < 0.02
        assert value == pytest.approx(sum(c * np.log(sum(a * b for a, b in zip(row, plain))) for row, c in zip(p.tolist(), n) if c), abs=0.5)


def test_language_sets_against_all_sets(spark):
    """Each text's language set costs no more, by likelihood and penalty, than the best of all sets by more than a little."""
    rng = np.random.default_rng(7)
    p = rng.dirichlet(np.full(200, 0.2), 3).T + 1e-6
    p /= p.sum(0)
    for true in ([1, 0, 0], [0.5, 0.5, 0], [0.4, 0.3, 0.3]):
        bins = rng.choice(200, 1500, p=p @ true)
        chosen, share, _ = language_id.languages(bins, p)
        k, n = np.unique(bins, return_counts=True)
        cost = lambda s: -language_id.mixture(p[k][:, s], n.astype(float), 400)[1] + (len(s) - 1) * language_id.COUPLING * 0.5 * np.log(n.sum())
        sets = [[0], [1], [2], [0, 1], [0, 2], [1, 2], [0, 1, 2]]
        best = min(sets, key=cost)
        assert cost(chosen) <= cost(best) + 1.0
        assert set(chosen) == {i for i, x in enumerate(true) if x}
        assert np.abs(share - np.array(true)[chosen]).max() < 0.1


def test_background_tells_strange_letters(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    langs, p = language_id.learned(docs)
    strange = spark.createDataFrame([(1, "qzx vkw jqq zzxq wxqk"), (2, "\u042d\u0442\u043e \u0442\u0435\u043a\u0441\u0442 \u043e \u043f\u043e\u0433\u043e\u0434\u0435"), (3, "1 2 3")], "doc_id long, text string")
    assert all(r["background"] > 0.7 for r in language_id.predicted(strange, langs, p).collect())
    clean = language_id.predicted(docs.where("length(text) > 100"), langs, p)
    assert clean.where("background > 0.7").count() == 0
    with pytest.raises(ValueError):
        language_id.learned(docs, most=1)
