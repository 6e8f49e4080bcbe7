"""Precision and recall of secret reports by length, on keys among UUIDs, paths, camel case and base64 of plain text."""

from __future__ import annotations

import base64
import random
import string
import uuid
from collections import Counter

from trackwell.llm import secret_scan

LENGTHS = (24, 32, 40, 64)


def corpus(seed: int, n: int):
    """(text, kind, start, end): prose with one run in it."""
    r = random.Random(seed)
    words = ["".join(r.choices("etaoinshrdlucmfwyp", weights=range(18, 0, -1), k=r.randrange(2, 11))) for _ in range(3000)]
    some = lambda k: r.choices(words, k=k)
    kinds = {
        **{f"key{k}": lambda k=k: "".join(r.choices(string.ascii_letters + string.digits, k=k)) for k in LENGTHS},
        "uuid": lambda: str(uuid.UUID(int=r.getrandbits(128), version=4)), "path": lambda: "/".join(some(4)) + f"/v{r.randrange(9)}/{r.randrange(2030)}",
        "camel": lambda: "".join(w.capitalize() for w in some(5)) + str(r.randrange(100)), "base64": lambda: base64.b64encode(" ".join(some(7)).encode()).decode(),
    }
    rows = []
    for i in range(n):
        kind = list(kinds)[i % len(kinds)]
        run, head = kinds[kind](), " ".join(some(r.randrange(20, 80))) + " "
        rows.append((f"{head}{run} {' '.join(some(r.randrange(20, 80)))}", kind, len(head), len(head) + len(run)))
    return rows


def test_reports_among_ordinary_runs(spark):
    rows = corpus(31, 4000)
    docs = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], "doc_id long, text string")
    planted, hit, false = Counter(k for _, k, *_ in rows), Counter(), Counter()
    for d in secret_scan.secrets(docs).collect():
        _, kind, start, end = rows[d["doc_id"]]
        for s in (x.split(":") for x in d["spans"].split(",") if x.startswith("random")):
            if int(s[1]) < end and start < int(s[2]):
                (hit if kind.startswith("key") else false)[kind] += 1
            else:
                false["prose"] += 1
    reported = sum(hit.values()) + sum(false.values())
    print("reported", reported, "false", dict(false), "recall", {k: round(hit[k] / planted[k], 3) for k in sorted(planted) if k.startswith("key")})
    assert sum(false.values()) <= 0.1 * reported
    assert all(hit[f"key{k}"] >= 0.9 * planted[f"key{k}"] for k in LENGTHS[1:])
