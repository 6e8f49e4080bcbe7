"""SimHash near-duplicates against brute force over all pairs, and the deduplication on planted copies."""

from __future__ import annotations

import random
import re

import pandas as pd
import xxhash
from pyspark.sql import functions as F

from trackwell.llm import simhash
from trackwell.llm.common import components


def slow_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def grouped(links: list[tuple], nodes: list) -> dict:
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_query_against_all_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted((r["doc_id"], slow_fingerprint(r["text"])) for r in docs.collect())
    links = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[i + 1 :] if (x ^ y).bit_count() <= 2]
    expected = grouped(links, [a for a, _ in rows])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {a: (f"{x:016x}", expected[a]) for a, x in rows}


def test_ball_loses_no_link(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = set(base)
    for x in base:
        for _ in range(12):
            values.add(x ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 4))}))
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    expected = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    rows = spark.createDataFrame([(v,) for v in signed], "value long")
    found = {tuple(sorted(r)) for r in simhash.ball_links(rows, 64).collect()}
    assert found <= expected
    assert grouped(list(found), signed) == grouped(list(expected), signed)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1400)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_group_stays(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(3000)]
    rows, groups = [], []
    for g in range(60):
        words = rng.choices(vocabulary, k=300)
        own = []
        for copy in range(4):
            w = list(words)
            if copy:
                for _ in range(copy):  # up to 3 of 300 words change: similarity above 0.9
                    w[rng.randrange(300)] = rng.choice(vocabulary)
            own.append(len(rows))
            rows.append((len(rows), " ".join(w)))
        groups.append(own)
    docs = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"]))
    kept = {r["doc_id"] for r in simhash.one_of_each(docs).collect()}
    missed = sum(len(kept & set(g)) - 1 for g in groups)
    assert all(g[0] in kept for g in groups)
    assert missed <= 2


def test_repeated_rows_stay_once_and_null_ids_stay(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, "other words are in this text"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("component", F.lit(1))
    got = sorted((r["doc_id"] for r in simhash.one_of_each(docs).collect()), key=lambda x: (x is None, x))
    assert got == [1, 3, 4, None]
    assert set(simhash.one_of_each(docs).columns) == set(docs.columns)
