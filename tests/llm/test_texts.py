"""Token counts, packing, fingerprints, secret scans, preference formatting and mixing against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from trackwell.llm import mixing, multiset_hash, packing, preference, secret_scan
from trackwell.llm.tokenizing import Encoder, default_path, token_counts


@pytest.fixture(scope="module")
def vocabulary():
    return Tokenizer.from_file(default_path())


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def test_token_counts(spark, small, vocabulary):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(docs).collect()}
    for r in docs.collect():
        n = len(ids_of(vocabulary, r["text"]))
        assert got[r["doc_id"]] == (len((r["text"] or "").encode()), n, n > 2048)


def test_odd_texts_and_splices(vocabulary):
    rng = random.Random(3)
    odd = [
        None, "", " ", " 　x", "it's we'll I'm 'S d'", "<|endoftext|> a<|startoftext|>b", "é ́a", "\U0001f600\U0001f600 1234 a1b2", "a" * 3000, "\n\n\t\r\x0b\x0c a\x85b c", "İstanbul ẞ ŉ ﬁ Å Å ﻿", "​zero​ width", "中文字 かな 한국어", "x'́s a\u0000b",
    ]
    odd += ["".join(rng.choices("aé'S1 \n.,<|>́ 中", k=rng.randrange(1, 80))) for _ in range(400)]
    small = Encoder(default_path(), chunk=60, overlap=8)
    whole = Encoder(default_path())
    expected = [np.array(ids_of(vocabulary, t), "<u4").tobytes() for t in odd]
    assert list(whole.encode_many(odd)) == expected
    assert list(small.encode_many(odd)) == expected
    long = " ".join("".join(rng.choices(string.ascii_letters, k=rng.randrange(1, 12))) for _ in range(9000))
    assert list(whole.encode_many([long])) == [np.array(ids_of(vocabulary, long), "<u4").tobytes()]


def test_memo_of_few_pieces_gives_the_same():
    texts = [f"word{i} other{i % 7} é{i}" for i in range(500)]
    assert list(Encoder(default_path(), memo=20).encode_many(texts, group=5)) == list(Encoder(default_path()).encode_many(texts))


def test_packing(spark, small, vocabulary):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.packed(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    total = 0
    for d in docs.collect():
        ids = np.array([*ids_of(vocabulary, d["text"]), 1], "<u4")
        total += len(ids)
        own = sorted(by_doc[d["doc_id"]], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own] == [(k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert len(by_sequence) <= -(-total // 4096) + 1


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(4)
    for capacity in (1, 7, 64, 512):
        counts = np.zeros(capacity + 1, np.int64)
        for n in rng.integers(1, capacity + 1, 3000):
            counts[n] += 1
        plan = packing.pattern_plan(counts, capacity)
        used = Counter()
        for p, k in plan:
            assert sum(p) <= capacity
            for n in p:
                used[n] += k
        assert all(used[n] == counts[n] for n in range(1, capacity + 1))
        least = -(-int(counts @ np.arange(capacity + 1)) // capacity)
        assert sum(k for _, k in plan) <= 1.05 * max(least, int(counts[capacity // 2 + 1 :].sum())) + 2
    assert packing.pattern_plan(np.zeros(65, np.int64), 64, 16) == []


def test_least_squares_against_a_grid():
    a, b = np.array([[1.0, 0, 1], [0, 2, 1]]), np.array([3.0, 4.0])
    x = packing.nnls(a, b)
    assert (x >= 0).all() and np.abs(a @ x - b).max() < 1e-8


def test_fingerprints(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = [(r["doc_id"], r["text"] or "") for r in docs.orderBy("doc_id").collect()]
    got = {r["doc_id"]: r for r in multiset_hash.fingerprinted(docs).collect()}
    assert len(got) == len(texts)
    same = defaultdict(set)
    for (i, text), (_, after) in zip(texts, texts[1:] + texts[:1]):
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        r, whole = got[i], multiset_hash.vector(multiset_hash.unit_hashes(edited)[0])
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["edited_fingerprint"] == multiset_hash.written(whole)
        assert r["fingerprint"] == multiset_hash.written(multiset_hash.vector(multiset_hash.unit_hashes(text)[0]))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == text:
            assert r["near_edited"] == 1
        same[text].add(r["fingerprint"])
    assert all(len(f) == 1 for f in same.values())


def test_fingerprint_updates():
    v = lambda t: multiset_hash.vector(multiset_hash.unit_hashes(t)[0])
    parts = ["one line.\n", "another one.\n", "the third\n", "one line.\n"]
    whole = v("".join(parts))
    assert multiset_hash.written(whole) == multiset_hash.written(v("".join(reversed(parts))))
    out = multiset_hash.subtract(whole, v(parts[1]))
    assert multiset_hash.written(out) == multiset_hash.written(v(parts[0] + parts[2] + parts[3]))
    assert multiset_hash.written(multiset_hash.add(out, v(parts[1]))) == multiset_hash.written(whole)
    assert multiset_hash.written(whole) != multiset_hash.written(v("".join(parts[:3])))


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def slow_base(text: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secret_base_spans(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r["doc_id"]: r for r in secret_scan.secrets(docs).collect()}
    for r in docs.collect():
        own = slow_base(r["text"] or "")
        g, joined = got[r["doc_id"]], ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in own)
        assert (g["n_assign"], g["n_access"], g["n_hex"]) == tuple(sum(k == x for _, k, _ in own) for x in range(3))
        assert g["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(g["spans"].split(","))


def test_random_runs_are_found_and_words_are_not(spark):
    rng = random.Random(11)
    key = lambda: "".join(rng.choices(string.ascii_letters + string.digits, k=40))
    plain = ["see /usr/local/lib/python3/site-packages/tool for more", "version-1-of-the-very-long-name-2 and others", "the quick brown fox", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz1"]
    rows = [(i, f"text {key()} goes on") for i in range(60)] + [(100 + i, plain[i % 4]) for i in range(200)]
    got = {r["doc_id"]: r for r in secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i]["n_random"] == 1 and got[i]["spans"] == "random:5:45" for i in range(60)) >= 54
    assert not any(got[100 + i]["n_random"] for i in range(200))
    red = {r["doc_id"]: r["text"] for r in secret_scan.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(red[i] == "text [SECRET] goes on" for i in range(60)) >= 54
    assert all(red[100 + i] == plain[i % 4] for i in range(200))


def test_preference_pairs(spark):
    t = lambda *x: [dict(zip(("role", "text"), r)) for r in x]
    chosen, rejected = t(("user", "hi"), ("assistant", "good")), t(("user", "hi"), ("assistant", "bad <|im_end|>"), ("user", "why"))
    rows = [(1, chosen, rejected), (2, chosen, chosen), (3, chosen, []), (4, None, None), (5, t(("user", "a")), t(("user", "b")))]
    pairs = spark.createDataFrame(rows, "pair_id long, chosen array<struct<role string, text string>>, rejected array<struct<role string, text string>>")
    got = {r["pair_id"]: r for r in preference.formatted(pairs).collect()}
    assert {i: r["status"] for i, r in got.items()} == {1: "pair", 2: "equal", 3: "empty", 4: "empty", 5: "unmasked"}
    r = got[1]
    assert (r["prompt_turns"], r["prompt"]) == (1, "<|im_start|>user\nhi<|im_end|>\n")
    start, end = map(int, r["chosen_spans"].split(":"))
    assert r["chosen"][start:end] == "good<|im_end|>\n"


def realised(spark, docs, **kw):
    rows, weights = mixing.mixed(docs, block_tokens=200, **kw)
    return rows.collect(), {r["source"]: r for r in weights.collect()}


def test_mixing_realises_the_weights(spark):
    rng = random.Random(1)
    docs = [(i, s, " ".join(["w"] * rng.randrange(1, 30))) for i, s in enumerate(["big"] * 600 + ["mid"] * 150 + ["tiny"] * 20 + [None] * 10)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string")
    tokens = Counter()
    for _, s, t in docs:
        tokens[s] += len(t.split())
    for kw in ({"entropy": 0.8}, {"entropy": None, "repeats": 2.0}, {"entropy": 0.9, "budget": 5000.0}):
        rows, weights = realised(spark, frame, **kw)
        p = np.array([w["weight"] for w in weights.values()])
        assert abs(p.sum() - 1) < 1e-9
        if kw.get("entropy"):
            assert abs(-(p * np.log(p)).sum() / np.log(4) - kw["entropy"]) < 0.01
        else:
            assert max(w["epochs"] for w in weights.values()) <= 2 + 1e-6
        made, uses = Counter(), Counter()
        for r in rows:
            made[r["source"]] += r["mix_tokens"]
            uses[r["doc_id"]] += 1
        for s, w in weights.items():
            assert w["budget"] <= made[s] + 1e-6 and made[s] < w["budget"] + 30
        for i, s, _ in docs:
            assert int(weights[s]["epochs"]) <= uses[i] <= int(np.ceil(weights[s]["epochs"]))
        assert len({(r["source"], r["epoch"], r["block_rank"], r["place"]) for r in rows}) == len(rows)
