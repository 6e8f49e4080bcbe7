"""Near copies of several kinds of edits, of crowded bands, at the edge of the similarity, and blank texts."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from trackwell.llm import simhash


def words_of(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(n)]


def jaccard(a: str, b: str) -> float:
    x, y = (set(simhash.word_hashes(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def kept(spark, texts: list[str]) -> set[int]:
    return {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))).collect()}


@pytest.mark.parametrize("kind", ["cut", "extended", "block", "front"])
def test_copies_at_80_to_85_hundredths_meet(spark, kind):
    rng, texts = random.Random(17), []
    for _ in range(100):
        n = rng.randrange(200, 1000)
        w, at, part = words_of(rng, n), rng.randrange(n // 2), n * 8 // 100
        copy = {"cut": w[: n * 83 // 100], "extended": w + words_of(rng, n * 20 // 100), "block": w[:at] + words_of(rng, part) + w[at + part :], "front": w[n * 17 // 100 :]}[kind]
        texts += [" ".join(w), " ".join(copy)]
    assert all(0.8 <= jaccard(*texts[i : i + 2]) <= 0.87 for i in range(0, 200, 2))
    stay = kept(spark, texts)
    assert set(range(0, 200, 2)) <= stay
    assert len(stay) <= 101


def test_strangers_in_a_band_part_no_copies(spark):
    rng = random.Random(23)
    texts = [" ".join(words_of(rng, 60)) for _ in range(40)]
    texts += [t + " more" for t in texts]
    marked = simhash.signatures(spark.createDataFrame(pd.DataFrame({"doc_id": range(80), "text": texts})), 128)
    crowded = spark.createDataFrame([(r["doc_id"], r["digest"], r["fp"], [1], r["sketch"]) for r in marked.collect()], marked.schema)
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(80), "text": texts}))
    got = {r["doc_id"]: r["component"] for r in simhash.near_copy_classes(crowded, docs, 128, 0.8).collect()}
    assert got == {i: i % 40 for i in range(80)}


def test_the_whole_sets_decide(spark):
    rng, texts = random.Random(29), []
    for i in range(120):  # similarity just under or just over 0.8
        w = words_of(rng, 504)
        texts += [" ".join(w), " ".join(w[: 403 if i % 2 else 405])]
    like = [jaccard(*texts[i : i + 2]) for i in range(0, 240, 2)]
    assert {x >= 0.8 for x in like} == {True, False} and all(abs(x - 0.8) < 0.01 for x in like)
    stay = kept(spark, texts)
    assert sum((2 * i + 1 not in stay) != (x >= 0.8) for i, x in enumerate(like)) == 0


def test_blank_texts_are_copies(spark):
    assert kept(spark, ["", "a b c", " ", " \n"]) == {0, 1}


def test_band_keys_of_parts_and_nothing():
    h = np.unique(simhash.word_hashes(" ".join(words_of(random.Random(1), 3000)), 5))
    assert simhash.band_keys(h, 7) == simhash.band_keys(h)
    assert len(set(simhash.band_keys(np.empty(0, "<u8")))) == simhash.BANDS
