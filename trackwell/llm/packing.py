"""Best-fit packing by patterns: a non-negative least-squares fit of few-document length patterns to the histogram.

1. Every whole text becomes token ids and a final id; only longer documents are cut into pieces of the capacity.
2. The histogram of piece lengths (at most `capacity` entries, whatever the corpus) goes to the driver. Lengths are
   rounded up to units; all patterns of two or three units that fill a sequence exactly are enumerated, their repeat
   counts are fitted to the histogram by non-negative least squares and rounded down. What is left is packed by
   best fit, longest first, into the gaps of those sequences and into new ones, still on the histogram.
3. Each piece gets a rank among the pieces of its length (salted windows, so a length that a third of all pieces
   share is dealt over many tasks) and the rank says which sequence and offset it takes.

The plan that is broadcast has a row for each length of each pattern: its size depends on the capacity, not on the
corpus. Null texts count as empty (one final id). Repeated rows are packed as often as they occur; equal pieces are one
row with a count until they have their ranks, dealt in shares of bounded size, so that no row that recurs very often, an
empty text without id for one, is the work of one task. Texts of any length are read whole, in pieces; an empty table
gives no rows; other columns are ignored."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackwell.llm.common import mapped, scratch
from trackwell.llm.tokenizing import default_path, encoder

def pieces(docs: DataFrame, path: str, capacity: int = 4096, final_id: int = 1) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""
    end = np.array([final_id], "<u4").tobytes()

    def run(texts: list[str]) -> list:
        rows = []
        for i, own in enumerate(encoder(path, memo=500_000).encode_many(texts, splice=False)):
            ids = own + end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
        return list(zip(*rows))

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return mapped(rows, "text", ["doc_id"], "piece int, start long, length long, ids_crc32 long", run, group=2048)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[free] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= tol:
            break
        free[j] = True
        while True:
            k = np.flatnonzero(free)
            z = np.linalg.lstsq(a[:, k], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[k] = z
                break
            low = k[z <= 0]
            step = min(x[i] / (x[i] - v) for i, v in zip(k, z) if v <= 0 and x[i] != v) if len(low) else 1.0
            x[k] += step * (z - x[k])
            free[k[x[k] <= 1e-12]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def fitted(hist: np.ndarray, capacity: int, units: int) -> list[tuple[tuple[int, ...], int]]:
    """Exact-length patterns and repeat counts from the least-squares fit; takes what they use out of hist."""
    size = -(-capacity // units)
    by_unit = [[n for n in range(min(capacity, u * size), (u - 1) * size, -1)] for u in range(units + 1)]
    total = np.array([hist[by_unit[u]].sum() if u else 0 for u in range(units)], float)
    patterns = [(a, units - a) for a in range(1, units // 2 + 1)]
    patterns += [(a, b, units - a - b) for a in range(1, units // 3 + 1) for b in range(a, (units - a) // 2 + 1)]
    patterns = [p for p in patterns if all(total[u] for u in p)]
    if not patterns:
        return []
    used = np.flatnonzero(total)
    row = {int(u): i for i, u in enumerate(used)}
    a = np.zeros((len(used), len(patterns)))
    for j, p in enumerate(patterns):
        for u in p:
            a[row[u], j] += 1
    weight = 1 / np.sqrt(total[used])
    repeats = np.floor(nnls(a * weight[:, None], total[used] * weight) + 1e-6).astype(np.int64)
    out: list[tuple[tuple[int, ...], int]] = []
    for j in np.argsort(-repeats, kind="stable"):
        left = int(repeats[j])
        while left > 0:
            pick, taken = [], {}
            for u in patterns[j]:  # the longest pieces of each unit first
                n = next((n for n in by_unit[u] if hist[n] - taken.get(n, 0) > 0), None)
                if n is None:
                    break
                pick.append(n)
                taken[n] = taken.get(n, 0) + 1
            if len(pick) < len(patterns[j]):
                break
            k = min(left, *(int(hist[n]) // m for n, m in taken.items()))
            for n, m in taken.items():
                hist[n] -= k * m
            out.append((tuple(pick), k))
            left -= k
    return out


def pattern_plan(counts: np.ndarray, capacity: int = 4096, units: int = 256) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of exact lengths with repeat counts that use every piece of the histogram counts[length] once."""
    hist = counts.astype(np.int64).copy()
    gaps: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    filled = np.zeros(capacity + 1, bool)

    def put(pattern: tuple[int, ...], k: int) -> None:
        room = capacity - sum(pattern)
        gaps[room][pattern] = gaps[room].get(pattern, 0) + k
        filled[room] = True

    for p, k in fitted(hist, capacity, min(units, capacity)):
        put(p, k)
    for n in range(capacity, 0, -1):
        while hist[n]:
            room = n + int(filled[n:].argmax())
            if filled[room]:
                p, have = gaps[room].popitem()
                k = min(have, int(hist[n]))
                if have > k:
                    gaps[room][p] = have - k
                filled[room] = bool(gaps[room])
                put((*p, n), k)
            else:
                each = min(capacity // n, int(hist[n]))
                k = int(hist[n]) // each
                put((n,) * each, k)
                k *= each
            hist[n] -= k
    return [(p, k) for room in gaps for p, k in room.items()]


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length of each pattern: key (length and first rank), first sequence, how many a sequence takes, first offset."""
    rows, used, first = [], {}, 0
    for pattern, k in plan:
        at = 0
        for n in sorted(set(pattern), reverse=True):
            m = pattern.count(n)
            rows.append(((n << 40) + used.get(n, 0), first, m, at))
            used[n] = used.get(n, 0) + k * m
            at += n * m
        first += k
    rows.sort()
    return dict(zip(("key", "sequence", "each", "offset"), np.array(rows, np.int64).reshape(-1, 4).T.copy()))


def packed(docs: DataFrame, path: str | None = None, capacity: int = 4096, units: int = 256, salt_rows: int = 20_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    cut = pieces(docs, path or default_path(), capacity).groupBy(*kept).agg(F.count("*").alias("times"))  # equal pieces are one row
    cut = scratch(cut, "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").agg(F.sum("times").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    plan = spark.sparkContext.broadcast(places(pattern_plan(counts, capacity, units)))
    salts = spark.createDataFrame(pd.DataFrame({"length": np.arange(1, capacity + 1), "salts": -(-counts[1:] // salt_rows)}), "length long, salts long")
    share = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / salt_rows)))  # of a piece that recurs very often, `salt_rows` a share
    shared = cut.withColumn("share", share).withColumn("times", F.least(F.lit(salt_rows), F.col("times") - F.col("share") * salt_rows))
    salted = shared.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64(*kept, "share"), F.greatest("salts", F.lit(1)))).drop("salts")
    sums = salted.groupBy("length", "salt").agg(F.sum("times").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32", "share").rowsBetween(Window.unboundedPreceding, -1)
    ranked = salted.withColumn("own", F.coalesce(F.sum("times").over(own), F.lit(0))).join(base, ["length", "salt"])
    nth = F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))
    ranked = ranked.select(*kept, (F.col("base") + F.col("own")).alias("rank"), nth.alias("nth")).withColumn("rank", F.col("rank") + F.col("nth"))

    key = F.shiftleft("length", 40) + F.col("rank")

    def place(keys: list[int]) -> list[np.ndarray]:
        p, key = plan.value, np.array(keys, np.int64)
        i = np.searchsorted(p["key"], key, "right") - 1
        nth = key - p["key"][i]
        return [p["sequence"][i] + nth // p["each"][i], p["offset"][i] + nth % p["each"][i] * (key >> 40)]

    return mapped(ranked.select(*kept, key.alias("key")), "key", kept, "sequence_id long, offset long", place, group=8192)
