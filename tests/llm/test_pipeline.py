"""Each stage of the pipeline against a plain version, on what the stage before it kept of a small table."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from trackwell.llm import language_id, secret_scan, tokenizing
from trackwell.llm.common import scratch
from trackwell.llm.queries import OP2_SQL


@pytest.fixture(scope="module")
def kept(spark, small):
    """What goes into each stage and comes out of it, by name."""
    docs, out = spark.read.parquet(f"{small}/documents.parquet").select(*corpus_pipeline.COLUMNS), {}
    for name, stage in corpus_pipeline.STAGES:
        made = scratch(stage(spark, docs, small), name)
        out[name] = (docs, made)
        docs = made
    return out


def trigrams(text: str | None) -> list[str]:
    """Of letters in lower case, anything else a gap; those with a letter in the middle."""
    t = "\0" + "".join(c if c.isalpha() else "\0" for c in (text or "").lower()) + "\0"
    return [t[i : i + 3] for i in range(len(t) - 2) if t[i + 1] != "\0"]


def test_language(kept):
    docs, made = kept["language_id"]
    rows = docs.collect()
    counts: dict[str, Counter] = {}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None:
            counts.setdefault(r["lang"], Counter()).update(trigrams(r["text"]))
    smooth, bins = 0.5, language_id.BINS
    total = {lang: sum(c.values()) + smooth * bins for lang, c in counts.items()}
    p = lambda lang, t: (counts[lang][t] + smooth) / total[lang]
    got, sure = {r["doc_id"]: r["lang"] for r in made.collect()}, 0
    assert set(got) <= {r["doc_id"] for r in rows if trigrams(r["text"])}
    for r in rows:
        own = trigrams(r["text"])
        scores = sorted(((sum(math.log(p(lang, t)) for t in own), lang) for lang in counts), reverse=True)
        if len(own) > 60 and scores[0][0] - scores[1][0] > 0.2 * len(own):  # of one language
            assert got.get(r["doc_id"]) == scores[0][1]
            sure += 1
    assert sure > 100


def shingles(text: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_groups(rows: list) -> set[int]:
    """The smallest doc_id of each group of texts with a similarity of 0.8 or more, by comparing all pairs."""
    ids, sets = [r["doc_id"] for r in rows], [shingles(r["text"]) for r in rows]
    up = list(range(len(ids)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and (a == b or len(a & b) >= 0.8 * len(a | b)):
                x, y = sorted((top(i), top(j)), key=lambda k: ids[k])
                up[y] = x
    return {ids[i] for i in range(len(ids)) if top(i) == i}


def test_near_copies(kept):
    docs, made = kept["simhash_near_dedup"]
    assert {r["doc_id"] for r in made.collect()} == plain_groups(docs.collect())


def test_near_copies_of_a_larger_table(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    stay = corpus_pipeline.near_duplicate_stage(spark, docs, medium)
    assert {r["doc_id"] for r in stay.collect()} == plain_groups(docs.collect())


def test_secrets(kept):
    docs, made = kept["secret_scan"]
    spans, clean = {r["doc_id"]: r["spans"] for r in secret_scan.secrets(docs).collect()}, {r["doc_id"]: r for r in made.collect()}
    assert len(clean) == docs.count()
    for r in docs.collect():
        text, last = r["text"], None
        cut = sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in spans[r["doc_id"]].split(",") if s)
        joined: list[list[int]] = []
        for s, e in cut:
            if joined and s < joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], e)
            else:
                joined.append([s, e])
        for s, e in reversed(joined):
            text, last = text[:s] + "[SECRET]" + text[e:], s
        assert clean[r["doc_id"]]["text"] == text and clean[r["doc_id"]]["n_chars"] == len(text), last


def test_mix(kept):
    docs, made = kept["temperature_mix"]
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    expected = Counter(r[0] for r in con.execute(f"select doc_id from ({OP2_SQL})").fetchall())
    assert Counter(r["doc_id"] for r in made.collect()) == expected


def test_packing(kept):
    from tokenizers import Tokenizer

    docs, made = kept["pattern_packing"]
    tok = Tokenizer.from_file(tokenizing.default_path())
    ids = {r["doc_id"]: np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    uses = Counter(r["doc_id"] for r in docs.collect())
    rows = made.collect()
    assert Counter((r["doc_id"], r["piece"]) for r in rows) == Counter({(d, k): n for d, n in uses.items() for k in range(-(-len(ids[d]) // 4096))})
    by: dict[int, list] = {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 4096 * r["piece"] and len(part) == r["length"] == min(4096, len(ids[r["doc_id"]]) - r["start"]) and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0 and sum(places[-1]) <= 4096
