"""Hard negatives by exact integer scores: a matrix product in residue numbers, then windowed selection.

Components become integers, floor(scale * x). The product of two blocks of vectors is taken modulo several small primes
in float32: with residues of at most 510 either side of zero and 64 components at a time, every sum stays below 2^24
and so is exact. Chinese remaindering (symmetric mixed-radix digits) gives the signed scores back. As many primes are
taken as the largest product of norms asks for (Cauchy-Schwarz), up to seven, which cover 64 bits.

Anchors are a stated query set; all rows are dealt into groups of bounded size, and every anchor visits every group: in
round one the groups of its own label, for its positives, in round two all groups, for the negatives between the marks
that each positive sets. A task holds one group and streams the anchors past it, so memory depends on the group only,
and a label that most rows share is just more groups. A group hands on at most `positives` or `negatives` rows for each
ask; ranking merges them.

Rows with null label, null vector, or a null or non-finite component take no part. Vectors score against vectors of
their own length only; empty vectors score 0. A row without vec_id is no anchor, but may be a positive or negative, in
ties the last. `Other` rows are rows of another vec_id. Anchors that repeat entirely count once; one vec_id with other
vectors or labels is another anchor; repeated rows of one vec_id are positives and negatives as often as they occur.
Other columns are ignored, an empty table gives no rows. Scores beyond 64 bits are an error before any work is done."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackwell.llm.common import scratch

PRIMES = (1021, 1019, 1013, 1009, 997, 991, 983)
AT_ONCE = 64  # components whose residues' products sum to less than 2^24


def residues(v: np.ndarray, p: int) -> np.ndarray:
    """float32 residues of integers, within (p - 1) / 2 of zero."""
    r = v % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def primes_for(bound: float) -> int:
    """How many primes are needed for scores of at most bound either way."""
    product = 1
    for n, p in enumerate(PRIMES, 1):
        product *= p
        if product > 2.001 * bound + 2:
            return n
    if bound < 2**63:
        return len(PRIMES)
    raise ValueError("inner products of these vectors don't fit in 64 bits")


class Rows:
    """Integer row vectors with their residues, ready to be multiplied."""

    def __init__(self, v: np.ndarray, primes: int):
        self.n, self.dim = v.shape
        self.parts = [residues(v, p) for p in PRIMES[:primes]]

    def scores(self, other: Rows) -> np.ndarray:
        """int64 inner products of these rows (down) with the other ones (across)."""
        digits, weight = [], 1
        out = np.zeros((self.n, other.n), np.int64)
        for p, a, b in zip(PRIMES, self.parts, other.parts):
            x = np.zeros((self.n, other.n), np.int64)
            for i in range(0, self.dim, AT_ONCE):
                x += (a[:, i : i + AT_ONCE] @ b[:, i : i + AT_ONCE].T).astype(np.int64)
            for q, d in digits:  # the digit of p, from what the digits so far leave
                x = (x - d) % p * pow(q, -1, p)
            x %= p
            x[x > p // 2] -= p
            digits.append((p, x))
            out += x * np.int64(weight - (1 << 64) if weight >= 1 << 63 else weight)  # exact modulo 2^64, and the sum is within it
            weight = weight * p % (1 << 64)
        return out


def firsts(group: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the first k of each group by highest score, then smallest place."""
    by = np.lexsort((place, -score, group))
    g = group[by]
    rank = np.arange(len(g)) - np.searchsorted(g, g, "left")
    return by[rank < k]


def _matrix(column, dim: int) -> np.ndarray:
    """int64 rows of an Arrow column of lists of whole doubles, all of length dim."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def usable(vectors: DataFrame, relabel: Column | None, scale: int) -> DataFrame:
    """(vec_id, label, v array of whole doubles) of the rows that take part."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    label = F.col("label").cast("long")
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.where(~F.exists(F.col("embedding").cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), (label if relabel is None else relabel.cast("long")).alias("label"), v.alias("v"))


def hard_negatives(
    vectors: DataFrame, anchors: Column, relabel: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, group_bytes: int = 8 << 20,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each row for which `anchors` holds: its first `positives` other rows of its label, and for each of them the first
    `negatives` rows of another label that score from low to high percent of the positive. Higher scores come first, ties
    by smaller vec_id. relabel: the label that counts, if it isn't the column's."""
    rows = scratch(usable(vectors, relabel, scale).withColumn("dim", F.size("v")), "whole-vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("norm"), F.max(F.when(anchors, norm)).alias("asked")).collect()  # a row a length
    primes = primes_for(max((r["norm"] * (r["asked"] or 0.0) for r in sizes), default=0.0) * 1.000001)
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    total = sum(r["n"] for r in sizes)
    rows_of = F.greatest(F.lit(1), F.least(F.lit(group_bytes) / (8 * F.greatest("dim", F.lit(1))), F.lit(math.ceil(total / (2 * parallel)))))

    def grouped(*own: str) -> DataFrame:
        """(own, parts, base): into how many groups the rows of equal own are dealt."""
        parts = rows.groupBy(*own).agg(F.ceil(F.count("*") / F.first(rows_of)).cast("int").alias("parts"))
        return scratch(parts.withColumn("base", F.xxhash64(*own)), "groups")

    def visited(look, schema: str, asks: DataFrame, *own: str) -> DataFrame:
        """look(a group's rows) gives a function of asks; its rows for every ask and every group of the ask's own values.

        Rows and asks of a group come to one task, the rows first; the asks stream by, 256 at a time."""
        parts = grouped(*own)
        number = F.xxhash64("base", "part")
        held = rows.join(parts, list(own)).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int"))
        come = asks.join(parts, list(own)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        both = held.withColumns({"g": number, "ask": F.lit(0)}).unionByName(come.withColumns({"g": number, "ask": F.lit(1)}), allowMissingColumns=True).drop("base", "parts", "part")
        groups = parts.agg(F.sum("parts")).first()[0] or 0
        ordered = both.repartition(max(parallel, groups), "g").sortWithinPartitions("g", "ask", F.asc_nulls_last("vec_id"))

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            now, of, state = [], None, None
            for b in batches:
                g, ask = b.column("g").to_numpy(zero_copy_only=False), b.column("ask").to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero((np.diff(g) != 0) | (np.diff(ask) != 0)) + 1), len(g)]
                for i, j in zip(cuts, cuts[1:]):
                    if i == j:
                        continue
                    if g[i] != of:
                        now, of, state = [], g[i], None
                    if not ask[i]:
                        now.append(b.slice(i, j - i))
                    elif now:
                        state = state or look(pa.Table.from_batches(now))
                        for at in range(i, j, 256):
                            yield from state(b.slice(at, min(256, j - at)))

        return ordered.mapInArrow(run, schema)

    asked = rows.where(anchors & F.col("vec_id").isNotNull()).distinct()
    asked = scratch(asked.withColumn("anchor", F.struct("vec_id", F.col("label").alias("l"), F.xxhash64("v").alias("h"))), "anchors")

    def loaded(table) -> tuple:
        """Ids, which of them are null, labels, vectors and their length, of a group."""
        ids = table.column("vec_id").combine_chunks()
        gone = ids.is_null().to_numpy(zero_copy_only=False)
        number = ids.fill_null(0).to_numpy()
        dim = table.column("dim")[0].as_py()
        v = _matrix(table.column("v").combine_chunks(), dim)
        return number, gone, table.column("label").to_numpy(), Rows(v, primes), dim

    def same_label(table):
        ids, gone, _, held, dim = loaded(table)

        def look(batch) -> Iterator:
            import pyarrow as pa

            own = batch.column("vec_id").to_numpy(zero_copy_only=False)
            s = Rows(_matrix(batch.column("v"), dim), primes).scores(held)
            me = (own[:, None] == ids[None, :]) & ~gone[None, :]
            s[me] = np.iinfo(np.int64).min
            edge = np.partition(s, max(0, s.shape[1] - positives), axis=1)[:, max(0, s.shape[1] - positives)]
            a, i = np.nonzero((s >= edge[:, None]) & ~me)
            best = firsts(a, s[a, i], i, positives)  # rows of a group are in the order of vec_id, nulls last
            yield pa.RecordBatch.from_arrays(
                [batch.column("anchor").take(pa.array(a[best])), pa.array(ids[i[best]], mask=gone[i[best]]), pa.array(s[a[best], i[best]])], names=["anchor", "positive_id", "positive_score"]
            )

        return look

    def other_label(table):
        ids, gone, labels, held, dim = loaded(table)

        def look(batch) -> Iterator:
            import pyarrow as pa

            own = batch.column("label").to_numpy(zero_copy_only=False)
            scores = batch.column("scores").to_pylist()
            marks = np.array([[(-(-p * low // 100), p * high // 100) for p in x] + [(1, 0)] * (positives - len(x)) for x in scores], np.int64)
            s = Rows(_matrix(batch.column("v"), dim), primes).scores(held)
            some = marks[:, :, 0] <= marks[:, :, 1]
            least = np.where(some, marks[:, :, 0], np.iinfo(np.int64).max).min(1)
            most = np.where(some, marks[:, :, 1], np.iinfo(np.int64).min).max(1)
            a, i = np.nonzero((s >= least[:, None]) & (s <= most[:, None]) & (own[:, None] != labels[None, :]))
            score = s[a, i]
            for j in range(positives):
                within = np.flatnonzero((score >= marks[a, j, 0]) & (score <= marks[a, j, 1]))
                best = within[firsts(a[within], score[within], i[within], negatives)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("anchor").take(pa.array(a[best])), pa.array(np.full(len(best), j, np.int32)), pa.array(ids[i[best]], mask=gone[i[best]]), pa.array(score[best])],
                    names=["anchor", "nth", "negative_id", "negative_score"],
                )

        return look

    key = "anchor struct<vec_id: bigint, l: bigint, h: bigint>"
    found = visited(same_label, f"{key}, positive_id long, positive_score long", asked, "dim", "label")
    by_score = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    found = found.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= positives)
    best = F.array_sort(F.collect_list(F.struct("nth", "positive_id", "positive_score")))
    best = scratch(found.groupBy("anchor").agg(best.alias("best")), "positives")

    asks = asked.join(best, "anchor").withColumn("scores", F.col("best.positive_score")).drop("best")
    hits = visited(other_label, f"{key}, nth int, negative_id long, negative_score long", asks, "dim")
    rank = F.row_number().over(Window.partitionBy("anchor", "nth").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id")))
    hits = hits.withColumn("rank", rank.cast("int")).where(F.col("rank") <= negatives)
    named = best.select("anchor", F.posexplode("best").alias("nth", "p"))
    return named.join(hits, ["anchor", "nth"]).select(F.col("anchor.vec_id").alias("anchor_id"), "p.positive_id", "rank", "negative_id", "p.positive_score", "negative_score")
