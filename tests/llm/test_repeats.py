"""Removal of repeated byte strings against all windows of a small table, and its parts."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackwell.llm import suffix_dedup
from trackwell.llm.suffix_dedup import anchors, gram_hashes, merged, multikey_quicksort, repeated, sorted_common


def brute(texts: list[str | None], length: int = 200) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, sha256) of each text, by every window of every text."""
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - length + 1):
            w = hashlib.md5(d[i : i + length]).digest()
            seen[w] = seen.get(w, 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[hashlib.md5(d[i : i + length]).digest()] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(d, gone) if not g)).hexdigest()))
    return out


def made_texts(seed: int) -> list[str | None]:
    """Texts with passages at, below and above the length, in other surroundings, at edges, overlapping, and in copies."""
    r = random.Random(seed)
    fresh = lambda n: "".join(r.choice("abcdefgh äß€\n😀") for _ in range(n))
    p = [fresh(n) for n in (150, 190, 200, 201, 260, 400, 1200)]
    texts: list[str | None] = [None, "", "short", fresh(3000), "a" * 1500, "ab" * 700, ("x" * 300 + fresh(50)) * 3]
    for _ in range(30):
        texts.append("".join(fresh(r.randrange(120)) + r.choice(p)[r.randrange(30) :] for _ in range(r.randrange(1, 5))))
    line = fresh(120)
    texts += [fresh(400) + line + fresh(400) for _ in range(40)]
    edge = fresh(330)
    texts += [fresh(300) + edge + fresh(300) for _ in range(40)]
    texts += [texts[3], texts[8], texts[8]]
    return texts


def digest_rows(spark, texts, **how):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, k1 string").repartition(5)
    found = suffix_dedup.without_repeats(docs, **how)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["stop"] - r["start"])
    rows = found.select("doc_id", "n_bytes", gone.alias("n"), F.size("removed").alias("s"), F.sha2("kept", 256).alias("h")).orderBy("doc_id").collect()
    return [tuple(r)[1:] for r in rows]


@pytest.mark.parametrize(("seed", "bucket_rows"), [(1, 30_000), (2, 40), (3, 7)])
def test_made_texts_by_brute_force(spark, seed, bucket_rows):
    """Few rows a bucket part grams over many buckets, so that most repeats are found across boundaries."""
    texts = made_texts(seed)
    assert digest_rows(spark, texts, bucket_rows=bucket_rows) == brute(texts)


def test_other_lengths(spark):
    texts = made_texts(4)[:40]
    assert digest_rows(spark, texts, length=64) == brute(texts, 64)


def test_small_table_by_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    rows = suffix_dedup.digests(spark.read.parquet(f"{small}/documents.parquet")).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute([d["text"] for d in docs])
    assert sum(r["n_removed"] for r in rows) > 1000


def test_a_removed_run_and_its_neighbours(spark):
    passage = "p" + "q" * 3 + "".join(chr(97 + i * 7 % 26) for i in range(196))
    texts = ["begin " * 20 + passage + "!" * 30, passage + "end", passage[1:] + "tail " * 10]
    got = digest_rows(spark, texts)
    assert [r[1] for r in got] == [200, 200, 0] and got == brute(texts)


def test_copies_and_repeated_rows(spark):
    text = "".join(random.Random(5).choices("abcdefghij ", k=900))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None), (2, text[:250])], "doc_id long, text string")
    rows = {(r["doc_id"], r["n_bytes"]): r for r in suffix_dedup.digests(docs).collect()}
    assert rows[1, 900]["n_removed"] == 900 and rows[None, 900]["n_removed"] == 900 and rows[2, 250]["n_removed"] == 250
    assert rows[None, 0]["n_removed"] == 0 and rows[None, 0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()


def test_empty_table(spark):
    assert suffix_dedup.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_anchors_of_every_window(monkeypatch):
    """Every window has one anchor, the first of its least grams, also over slices and several texts."""
    r = np.random.default_rng(6)
    texts = [bytes(r.integers(97, 101, n).astype(np.uint8)) for n in (500, 199, 200, 0, 1300)] + [b"z" * 600]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    for slice_size in (1 << 19, 300):
        monkeypatch.setattr(suffix_dedup, "SLICE", slice_size)
        found = {}
        for t, g, at, first, last in zip(*anchors(data, ends - [len(x) for x in texts], ends, 200)):
            assert g == gram_hashes(np.frombuffer(texts[t], np.uint8))[at].view(np.int64)
            for s in range(first, last + 1):
                assert (t, s) not in found
                found[t, s] = at
        assert set(found) == {(t, s) for t, x in enumerate(texts) for s in range(len(x) - 199)}
        for (t, s), at in found.items():
            h = gram_hashes(np.frombuffer(texts[t], np.uint8))[s : s + 169] >> np.uint64(20)
            assert at == s + int(h.argmin())


def test_multikey_quicksort():
    r = np.random.default_rng(7)
    rows = r.integers(0, 2, (300, 24)).astype(np.uint8)
    rows[50:80] = rows[50]
    order, common = sorted_common(rows)
    assert [bytes(x) for x in rows[order]] == sorted(bytes(x) for x in rows)
    for i in range(1, 300):
        a, b = rows[order[i - 1]], rows[order[i]]
        assert common[i] == next((k for k in range(24) if a[k] != b[k]), 24)
    assert list(multikey_quicksort(np.zeros((5, 3), np.uint64))) == [0, 1, 2, 3, 4]


def test_windows_by_classes_of_both_sides():
    r = np.random.default_rng(8)
    left, right = r.integers(0, 2, (200, 8)).astype(np.uint8), r.integers(0, 2, (200, 16)).astype(np.uint8)
    low, high, many = r.integers(0, 4, 200), r.integers(4, 9, 200), np.zeros(200, bool)
    got = repeated(left, right, low, high, many, 16)
    for i in range(200):
        for o in range(9):
            same = (left[:, :o] == left[i, :o]).all(1) & (right[:, : 16 - o] == right[i, : 16 - o]).all(1) & (low <= o) & (o <= high)
            assert got[i, o] == (low[i] <= o <= high[i] and same.sum() > 1)


def test_merged_spans():
    a, z = merged(np.array([10, 0, 12, 40, 50]), np.array([20, 5, 15, 50, 60]))
    assert list(zip(a, z)) == [(0, 5), (10, 20), (40, 60)]
