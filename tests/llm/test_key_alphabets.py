"""Planted random keys of each alphabet without a keyword: found and redacted."""

from __future__ import annotations

import math
import random
import string

import pytest

from trackwell.llm import secret_scan

UP, LOW, DIG = string.ascii_uppercase, string.ascii_lowercase, string.digits
ALPHABETS = {"base32": UP + "234567", "base32 lower": LOW + "234567", "base36": UP + DIG, "base36 lower": LOW + DIG, "base62": UP + LOW + DIG, "base64": UP + LOW + DIG + "+/", "hex upper": "0123456789ABCDEF"}


def keys(name: str, n: int, size: int) -> list[str]:
    rng = random.Random(f"{name} {size}")
    made = ("".join(rng.choices(ALPHABETS[name], k=size)) for _ in range(10 * n))
    return [k for k in made if any(c.isdigit() for c in k) and any(c.isalpha() for c in k)][:n]


@pytest.mark.parametrize("size", [24, 32, 40, 64])
@pytest.mark.parametrize("name", ALPHABETS)
def test_random_keys_pass_their_own_alphabet(name, size):
    assert sum(secret_scan.randomness(k) > 0.03 for k in keys(name, 400, size)) >= 370


def test_keys_of_each_alphabet_are_found_and_redacted(spark):
    planted = [k for name in ALPHABETS for k in keys(name, 20, 40)]
    plain = ["see /usr/local/lib/python3/site-packages/tool for more", "internationalisationcommittee2of the", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz1"]
    rows = [(i, f"text {k} goes on") for i, k in enumerate(planted)] + [(1000 + i, plain[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secret_scan.secrets(docs).collect()}
    red = {r["doc_id"]: r["text"] for r in secret_scan.redacted(docs).collect()}
    for a in range(0, len(planted), 20):
        assert sum(got[i] == "random:5:45" and red[i] == "text [SECRET] goes on" for i in range(a, a + 20)) >= 17
    assert all(red[1000 + i] == plain[i % 3] for i in range(300))


def slow_battery(run: str) -> float:
    """The battery as its docstring has it, symbol by symbol; the chi-squared tail by numerical integration."""
    run = run.rstrip("=")
    ordered = ["0123456789abcdef", "0123456789ABCDEF", UP + "234567", LOW + "234567", UP + DIG, LOW + DIG, UP + LOW + DIG, UP + LOW + DIG + "+/"]
    code = next(a for a in ordered if set(run) <= set(a))
    v, size, n = [code.index(c) for c in run], len(code), len(run)
    classes = min(size, max(8, n // 3))
    seen, expected = [0] * classes, [0.0] * classes
    for x in v:
        seen[x * classes // size] += 1
    for x in range(size):
        expected[x * classes // size] += n / size
    chi, k = sum((a - b) ** 2 / b for a, b in zip(seen, expected)), classes - 1
    steps = 20_000
    p_chi = 1 - sum(((i + 0.5) * chi / steps) ** (k / 2 - 1) * math.exp(-(i + 0.5) * chi / steps / 2) for i in range(steps)) * chi / steps / (2 ** (k / 2) * math.gamma(k / 2))
    high = [2 * x >= size for x in v]
    a, b = sum(high), n - sum(high)
    runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
    mean, var = 1 + 2 * a * b / n, 2 * a * b * (2 * a * b - n) / n**2 / (n - 1)
    p_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * var))
    m = sum(v) / n
    r = sum((x - m) * (y - m) for x, y in zip(v, v[1:])) / sum((x - m) ** 2 for x in v)
    return min(1.0, 3 * min(p_chi, p_runs, math.erfc(abs(r * n + 1) / math.sqrt(2 * n))))


@pytest.mark.parametrize("name", ALPHABETS)
def test_battery_against_a_plain_one(name):
    for k in keys(name, 5, 40) + keys(name, 5, 90) + [x for x in ["abcabcabc1abcabcabc1"] if name == "base36 lower"]:
        assert secret_scan.randomness(k) == pytest.approx(slow_battery(k), abs=0.02)


def test_reports_hold_the_rate_and_find_keys(spark):
    """300 keys among 3,000 ordinary long runs and as many texts without any."""
    rng = random.Random(41)
    words = ["".join(rng.choices("etaoinshrdlucmfw", weights=range(16, 0, -1), k=rng.randrange(2, 9))) for _ in range(4000)]
    text = lambda: " ".join(rng.choices(words, k=30))
    name = lambda: rng.choice("-_/").join([*rng.choices(words, k=8), str(rng.randrange(1000))])
    rows = [(i, f"{text()} {k} {text()}") for i, k in enumerate(keys("base62", 300, 40))]
    rows += [(1000 + i, f"{text()} {name()} {text()}") for i in range(3000)] + [(5000 + i, text()) for i in range(3000)]
    got = {r["doc_id"]: r["n_random"] for r in secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    true, false = sum(got[i] for i in range(300)), sum(n for i, n in got.items() if i >= 1000)
    assert true >= 270
    assert false <= 0.1 * (true + false)  # asked for: 0.05 on average


def test_thresholds_are_benjamini_hochbergs():
    """The reported runs of a band are those of the step-up rule over single p-values, by brute force."""
    import numpy as np

    from trackwell.llm import secret_scan as S

    rng = np.random.default_rng(21)
    for trial in range(40):
        plain = {(0, int(b)): int(n) for b, n in zip(rng.choice(300, 60, replace=False), rng.integers(1, 200, 60))}
        runs = {(0, int(b)): int(n) for b, n in zip(rng.choice(300, 40, replace=False) // (1 + trial % 4), rng.integers(1, 9, 40))}
        rate = (0.01, 0.05, 0.2)[trial % 3]
        total = sum(plain.values())
        p = sorted(((sum(n for (_, c), n in plain.items() if c <= b) + 1) / (total + 1), b) for (_, b), n in runs.items() for _ in range(n))
        largest = max((k for k, (x, _) in enumerate(p, 1) if x <= rate * k / len(p)), default=0)
        want = min(S.PASSES, p[largest - 1][1]) if largest else -1
        reported = lambda most: {b for _, b in runs if b <= most}
        assert reported(S.thresholds(runs, plain, rate)[0]) == reported(want)
    assert S.thresholds({}, {}, 0.05) == [-1] * 4


def test_many_runs_at_once_are_like_one_by_one():
    import random

    from trackwell.llm import secret_scan as S

    r = random.Random(22)
    runs = ["".join(r.choices(sorted(a), k=r.randrange(20, 200))) for a in S.ALPHABETS for _ in range(12)]
    runs += ["a" * 30, "0" * 25 + "a", "ab" * 20, "z1" * 12 + "==", "A-b_9" * 6, "1" * 19 + "f" * 19, "name-of-a-path/2024/part-1234"]
    assert S.randomness_of([]) == []
    for run, p in zip(runs, S.randomness_of(runs)):
        assert abs(p - S.randomness(run)) < 1e-9, run
