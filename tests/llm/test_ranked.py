"""Hard negatives and ranked search: made rows against plain versions, and the parts of the methods."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackwell.llm import hard_negatives, lexical_search
from trackwell.llm.hard_negatives import PRIMES, Rows, firsts, primes_for, residues
from trackwell.llm.lexical_search import Tree, greatest, saturated, sums, terms


# hard negatives


def plain_negatives(rows, every=10, scale=256):
    """The contract in plain Python: rows (vec_id, embedding, label)."""
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, [math.floor(scale * float(x)) for x in v], lab) for i, v, lab in rows if lab is not None and fine(v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for a in {(i, tuple(v), lab) for i, v, lab in rows if i is not None and i % every == 0}:
        others = [(sum(x * y for x, y in zip(a[1], v)), i, lab) for i, v, lab in rows if i != a[0] and len(v) == len(a[1])]
        others.sort(key=lambda r: (-r[0], last(r[1])))
        for s, p, _ in [r for r in others if r[2] == a[2]][:5]:
            ok = [r for r in others if r[2] != a[2] and 50 * s <= 100 * r[0] <= 95 * s][:3]
            out += [(a[0], p, k + 1, n, s, t) for k, (t, n, _) in enumerate(ok)]
    return sorted(map(str, out))


def mined(spark, rows, **how):
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for c in ("g", "ask", "dim", "v", "anchor", "parts", "part", "base", "scores"):
        docs = docs.withColumn(c, F.lit("clash"))
    return sorted(str(tuple(r)) for r in hard_negatives.hard_negatives(docs, F.col("vec_id") % 10 == 0, **how).collect())


@pytest.mark.parametrize("scale", [1.0, 3e5])
def test_negatives_by_brute_force(spark, scale):
    """Ties, repeated rows and ids, nulls, other lengths, a label of most rows, large components of either sign."""
    r = random.Random(1)
    rows = [(i, [r.choice([-0.5, 0.25, 0.5, 1.0, r.random()]) * scale for _ in range(70)], 0 if i % 3 else i % 5) for i in range(160)]
    rows += rows[20:24] + [(20, rows[25][1], 1), (None, rows[0][1], 0), (None, rows[3][1], 2), (300, None, 1), (301, [1.0, None], 1), (310, [float("nan")] * 70, 0)]
    rows += [(320, [float("inf")] * 70, 0), (330, rows[0][1], None), (340, [], 1), (341, [], 1), (342, [], 2), (350, [0.5, 0.5], 1), (351, [0.5, 0.4], 1), (352, [0.4, 0.3], 3)]
    assert mined(spark, rows, group_bytes=9000) == plain_negatives(rows)


def test_negatives_of_nothing(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []


def test_scores_beyond_64_bits_are_an_error(spark):
    with pytest.raises(ValueError, match="64 bits"):
        mined(spark, [(0, [1e18], 1), (1, [1e18], 1)])


@pytest.mark.parametrize(("most", "dim"), [(300, 64), (2**20, 130), (2**29, 8)])
def test_products_in_residue_numbers(most, dim):
    r = np.random.default_rng(2)
    a, b = r.integers(-most, most + 1, (9, dim)), r.integers(-most, most + 1, (11, dim))
    a[0], b[0], b[1] = most, most, -most
    exact = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
    n = primes_for(float(most) ** 2 * dim)
    assert Rows(a, n).scores(Rows(b, n)).tolist() == exact
    assert n == 1 or math.prod(PRIMES[: n - 1]) <= 2.001 * most**2 * dim + 2


def test_sums_of_residues_are_exact_in_float32():
    for p in PRIMES:
        assert 64 * (p // 2) ** 2 < 2**24 and all(p % q for q in range(2, 33))
        x = residues(np.arange(-2 * p, 2 * p), p)
        assert np.abs(x).max() == p // 2 and ((np.arange(-2 * p, 2 * p) - x.astype(int)) % p == 0).all()


def test_firsts_of_groups():
    g, s, at = np.array([1, 0, 1, 1, 0]), np.array([5, 2, 7, 7, 2]), np.array([0, 4, 9, 3, 1])
    assert firsts(g, s, at, 2).tolist() == [4, 1, 3, 2]


# ranked search


def plain_ranking(docs, items):
    """The contract in plain Python: docs (doc_id, text), items (item_id, text)."""
    cut = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
    rows = [(i, Counter(cut(t))) for i, t in docs]
    rows = [(i, c, sum(c.values())) for i, c in rows if c]
    total, length = len(rows), sum(n for *_, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in set(items):
        asked, scored = Counter(cut(text)), []
        for i, c, n in rows:
            m = 100 - 75 + 75 * n * total // length
            s = sum(k * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, k in asked.items() if c[t])
            scored += [(s, i)] * (s > 0)
        scored.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        out += [(item, k + 1, i, s) for k, (s, i) in enumerate(scored[:10])]
    return sorted(map(str, out))


def found(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("terms", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("block", F.lit("clash"))
    return sorted(str(tuple(r)) for r in lexical_search.ranked(d, i, **how).collect())


WORDS = ["alpha", "Beta", "GAMMA", "δέλτα", "Δέλτα", "été", "x1", "7", "日本語", "rare"]


@pytest.mark.parametrize("how", [{}, {"block_bytes": 60, "part_docs": 50, "tree_docs": 30}])
def test_ranking_by_brute_force(spark, how):
    """Ties, copies, repeated rows, nulls, empty and very long texts, letters of other scripts; several blocks and trees."""
    r = random.Random(3)
    text = lambda n: "".join(r.choices(WORDS, weights=range(len(WORDS), 0, -1))[0] + r.choice(" ,-_\n\x7f") for _ in range(n))
    docs = [(i, text(r.randrange(30))) for i in range(150)]
    docs += [(i, docs[3][1]) for i in range(200, 260)] + docs[:5] + [(None, docs[3][1]), (None, None), (7, None), (8, ""), (9, "!?"), (500, "alpha rare " * 30_000)]
    items = [(i, text(6)) for i in range(12)] + [(0, "alpha alpha rare"), (0, "alpha alpha rare"), (0, "unknown words"), (20, None), (21, ""), (None, "rare 7")]
    assert found(spark, docs, items, **how) == plain_ranking(docs, items)


def test_ranking_of_nothing(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, "a")], [(1, None)]) == []


def test_terms_are_what_the_pattern_matches():
    every = "".join(map(chr, range(0x250))) + "ŁßİK"
    want = [re.sub("[A-Z]", lambda m: m[0].lower(), w).encode() for w in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", every)]
    assert terms(every) == want


def vectors(r, n, size, deep=False):
    paths = [tuple(range(i + 1)) for i in range(n)] if deep else [tuple(sorted(r.sample(range(size), r.randrange(0, size)))) for _ in range(n)]
    paths = sorted(paths)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
    term = np.array([t for p in paths for t in p], np.int64)
    return paths, starts, term, np.array([r.randrange(1, 9) for _ in term], np.int64), np.array([r.randrange(25, 400) for _ in paths], np.int64)


@pytest.mark.parametrize("deep", [False, True])
def test_tree_bounds_and_best(deep):
    """Every child's bound is no less than the score of any document below it, and the best are those of all scores."""
    r = random.Random(4)
    paths, starts, term, tf, m = vectors(r, 700 if deep else 300, 12, deep)
    tree = Tree(starts, term, tf, m, leaf_docs=4)
    worth = saturated(tf, np.repeat(m, np.diff(starts)))
    ids = np.array(r.sample(range(1000), len(m)))
    for _ in range(20):
        weight = np.zeros(max(12, len(m)), np.int64)
        for t in r.sample(range(12), 4):
            weight[t] = r.randrange(9000)
        score = sums(weight[term] * worth, starts)

        def below(node):
            if node in tree.leaf:
                return score[slice(*tree.leaf[node])].max()
            numbers, at, t, w = tree.children[node]
            most = [below(int(c)) for c in numbers]
            assert (sums(weight[t] * w, at) >= most).all()
            return max(most)

        assert below(0) == score.max()
        want = sorted((-s, i, d) for d, (s, i) in enumerate(zip(score.tolist(), ids.tolist())) if s > 0)[:10]
        assert tree.best(weight, 10, ids) == [(-s, d) for s, _, d in want]
    assert deep or any(len(n[0]) > 1 for n in tree.children.values())


def test_greatest_of_each_term():
    t, tf = greatest(np.array([3, 1, 3, 2]), np.array([1, 5, 4, 2]))
    assert t.tolist() == [1, 2, 3] and tf.tolist() == [5, 2, 4]


def test_saturation_is_monotone():
    tf, m = np.meshgrid(np.arange(1, 60), np.arange(25, 900, 7))
    x = saturated(tf, m)
    assert (np.diff(x, axis=1) >= 0).all() and (np.diff(x, axis=0) <= 0).all()


