"""Approximate nearest neighbours by low-dimensional stable projections in a kd-tree.

Vectors are projected to m dimensions with fixed Gaussian (2-stable) directions: the squared projected distance of
two vectors at distance d is d^2 times a chi-squared variable with m degrees of freedom. A kd-tree over the
projections, its upper levels fitted on a bounded sample (`sample` vectors of `sample_bytes` in all, at most 2^`levels` cells) and applied to
every row, deals the rows into cells. A cell of more than `part_rows` rows gets a second tree of its own, fitted on about
`part_sample` of its rows by a task of its own and kept in a table, which deals it into parts; a part goes on down to
leaves. So what a query visits follows the reach of its neighbours, not the size of the table. A query takes its neighbours in order of projected distance, leaf by leaf, and verifies each by the exact
distance, until the chi-square test holds: a row not taken yet that is nearer than the k-th best found would lie
within the projected distance reached with probability `sure` or more.

Round one searches the query's own part and so bounds its k-th distance; round two visits the other cells and parts that
the test doesn't exclude. Queries of a cell come in blocks of bounded size, and a cell is copied as often as it has blocks
of queries, so copies grow with the visits, not with the table. Equal vectors are searched once: only their k+1
smallest ids can be in a result, so a vector that a third of all rows share costs one entry.

Vectors null, empty, zero, with null or non-finite components, of another size than the commonest one, or without
vec_id take no part. A repeated vec_id counts once, with the smallest of its vectors. Fewer candidates than k give
fewer rows; an empty table gives none."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from trackwell.llm.common import scratch

FOUND = "qid long, vec_id long, score double"


def chi_squared_radius(sure: float, m: int) -> float:
    """x with P(chi-squared of m degrees <= x) = sure, for even m."""
    low, high = 0.0, 400.0
    for _ in range(80):
        x = (low + high) / 2
        inside = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        low, high = (x, high) if inside < sure else (low, x)
    return high


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where("vec_id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists("v", lambda x: x != 0))
    dim = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (dim["n"] if dim else 0))


class Tree:
    """The upper levels of the kd-tree: splits by level, and the boxes of its cells."""

    def __init__(self, points: np.ndarray, levels: int):
        self.levels, self.m = levels, points.shape[1]
        self.axis, self.at = np.zeros(1 << levels, np.int64), np.zeros(1 << levels)
        self.low = np.full((1 << levels, self.m), -np.inf)
        self.high = np.full((1 << levels, self.m), np.inf)
        self._split(points, 1, 0, self.low[0].copy(), self.high[0].copy())

    def _split(self, points: np.ndarray, node: int, level: int, low: np.ndarray, high: np.ndarray) -> None:
        if level == self.levels:
            self.low[node - (1 << self.levels)], self.high[node - (1 << self.levels)] = low, high
            return
        a = int(np.ptp(points, axis=0).argmax()) if len(points) else level % self.m
        at = float(np.median(points[:, a])) if len(points) else 0.0
        self.axis[node], self.at[node] = a, at
        for right in (0, 1):
            lo, hi = low.copy(), high.copy()
            (lo if right else hi)[a] = at
            self._split(points[(points[:, a] > at) == bool(right)], 2 * node + right, level + 1, lo, hi)

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        row = np.arange(len(points))
        for _ in range(self.levels):
            node = 2 * node + (points[row, self.axis[node]] > self.at[node])
        return node - (1 << self.levels)

    def near(self, point: np.ndarray, reach: float) -> np.ndarray:
        """Cells whose box comes within reach of a point."""
        out = np.maximum(self.low - point, 0) + np.maximum(point - self.high, 0)
        return np.flatnonzero((out * out).sum(1) <= reach * reach)


def leaves(points: np.ndarray, rows: int) -> list[np.ndarray]:
    """The rows of each leaf of a kd-tree over points."""
    todo, done = [np.arange(len(points))], []
    while todo:
        i = todo.pop()
        if len(i) <= rows:
            done.append(i)
            continue
        a = int(np.ptp(points[i], axis=0).argmax())
        half = np.argsort(points[i, a], kind="stable")
        todo += [i[half[: len(i) // 2]], i[half[len(i) // 2 :]]]
    return done


class Cell:
    """The rows of a part of a cell with their leaves; finds the nearest of a query."""

    def __init__(self, v: np.ndarray, ids: list[np.ndarray], directions: np.ndarray, leaf_rows: int):
        self.v, self.ids, self.p = v, ids, v @ directions
        self.leaves = leaves(self.p, leaf_rows)
        self.low = np.array([self.p[i].min(0) for i in self.leaves])
        self.high = np.array([self.p[i].max(0) for i in self.leaves])

    def in_order(self, point: np.ndarray, at_once: int = 512, leaves: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(squared projected distances, rows) of all rows from the nearest projection on, some at a time. A leaf is
        opened when its box is nearer than whatever of the opened ones is left."""
        out = np.maximum(self.low - point, 0) + np.maximum(point - self.high, 0)
        reach = (out * out).sum(1)
        order, opened = np.argsort(reach, kind="stable"), 0
        d, row = np.empty(0), np.empty(0, np.int64)
        while opened < len(order) or len(row):
            edge = reach[order[opened]] if opened < len(order) else np.inf
            ready = min(int(np.searchsorted(d, edge, "right")), at_once)
            if ready:
                yield d[:ready], row[:ready]
                d, row = d[ready:], row[ready:]
                continue
            some = np.concatenate([self.leaves[x] for x in order[opened : opened + leaves]])
            opened += leaves
            away = self.p[some] - point
            d, row = np.concatenate([d, (away * away).sum(1)]), np.concatenate([row, some])
            by = np.argsort(d, kind="stable")
            d, row = d[by], row[by]

    def search(self, q: np.ndarray, point: np.ndarray, k: int, bound: float, factor: float) -> list[tuple[float, int]]:
        """At most k (distance, id), nearest first; bound: a distance within which k are known already."""
        best: list[tuple[float, int]] = []
        for far, rows in self.in_order(point):
            if far[0] > factor * bound * bound:  # the chi-square test holds for all that is left
                break
            d = np.sqrt(((self.v[rows] - q) ** 2).sum(1))
            near = bound if len(d) <= k else min(bound, np.partition(d, k - 1)[k - 1])  # every row has an id or more
            for j in np.flatnonzero(d <= near):
                best += [(float(d[j]), int(x)) for x in self.ids[rows[j]]]
            if len(best) >= k:
                best = sorted(best)[:k]
                bound = min(bound, best[-1][0])
        return sorted(best)[:k]


def nearest(vectors: DataFrame, queries: F.Column, k: int = 10, m: int = 8, sure: float = 0.99, sample: int = 20_000, levels: int = 12, cell_rows: int = 4096, part_rows: int = 32_768, part_sample: int = 8192, block: int = 4000, sample_bytes: int = 64 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row for which `queries` holds, itself left out."""
    spark = vectors.sparkSession
    rows = usable(vectors).groupBy("vec_id").agg(F.min("v").alias("v"))
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    distinct = scratch(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    total = distinct.count()
    size = distinct.select(F.size("v").alias("n")).first()
    sample = min(sample, max(1, sample_bytes // (8 * size["n"]))) if size else sample
    picked = np.array([r["v"] for r in distinct.orderBy(F.xxhash64("v")).limit(sample).collect()], float)
    dim = picked.shape[1] if len(picked) else 1
    directions = np.random.default_rng(20).standard_normal((dim, m))
    tree = Tree(picked @ directions if len(picked) else np.zeros((0, m)), min(levels, max(0, math.ceil(math.log2(max(1, total) / cell_rows)))))
    shared = spark.sparkContext.broadcast((tree, directions))  # boxes of at most 2^levels cells
    factor = chi_squared_radius(sure, m)

    @F.pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        tree, directions = shared.value
        return pd.Series(tree.cell(np.array(v.tolist(), float).reshape(len(v), -1) @ directions) if len(v) else [], dtype="int32")

    placed = scratch(distinct.withColumn("cell", cell_of("v")), "cells")
    crowded = placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > part_rows)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        _, directions = shared.value
        points = np.stack(rows["v"].to_numpy()).astype(float) @ directions
        below = Tree(points, max(1, min(levels, math.ceil(math.log2(rows["n"].iloc[0] / part_rows)))))
        return pd.DataFrame({"cell": [rows["cell"].iloc[0]], "blob": [pickle.dumps(below)], "salts": [math.ceil(rows["n"].iloc[0] / (4 * part_rows))]})

    few_of_each = placed.join(crowded, "cell").where(F.pmod(F.xxhash64("v"), F.col("n")) < part_sample)  # about part_sample rows a cell
    below = scratch(few_of_each.select("cell", "v", "n").groupBy("cell").applyInPandas(fit, "cell int, blob binary, salts int"), "trees")

    def routed(rows: DataFrame, near: bool = False) -> DataFrame:
        """rows with the part of their cell that their vector is in, or with a row for each part within reach of bound. A
        crowded cell's tree comes to the tasks of its rows, before them; other cells are one part."""
        trees = below.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("kind", F.lit(0)).drop("salts")
        salted = rows.join(below.select("cell", "salts"), "cell").withColumn("salt", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int")).withColumn("kind", F.lit(1))
        both = salted.drop("salts").unionByName(trees, allowMissingColumns=True)
        columns = rows.columns

        def run(batches: Iterator) -> Iterator:
            _, directions = shared.value
            tree = None
            for b in batches:
                cuts = [0, *(np.flatnonzero(np.diff(b["kind"]) | np.diff(b["cell"]) | np.diff(b["salt"])) + 1), len(b)]
                for i, j in zip(cuts, cuts[1:]):
                    part = b.iloc[i:j]
                    if i == j:
                        continue
                    if not part["kind"].iloc[0]:
                        tree = pickle.loads(part["blob"].iloc[0])
                        continue
                    points = np.stack(part["v"].to_numpy()).astype(float) @ directions
                    to = [tree.near(x, math.sqrt(factor) * r) for x, r in zip(points, part["bound"])] if near else [[c] for c in tree.cell(points)]
                    out = part.loc[part.index.repeat([len(t) for t in to])][columns].copy()
                    out["part"] = np.concatenate(to).astype("int32")
                    yield out

        schema = StructType([*rows.schema.fields, StructField("part", IntegerType())])
        deep = both.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind").mapInPandas(run, schema)
        return rows.join(below.select("cell"), "cell", "left_anti").withColumn("part", F.lit(0)).select(*columns, "part").unionByName(deep)

    indexed = scratch(routed(placed), "index")
    asked = scratch(rows.where(queries), "queries")
    single = asked.groupBy("v").agg(F.min("vec_id").alias("qid"))
    single = scratch(routed(single.withColumn("cell", cell_of("v"))), "asked")
    # Vectors that no axis parts may leave a part too large: it is dealt into pieces, all searched by its queries.
    pieces = indexed.groupBy("cell", "part").agg(F.ceil(F.count("*") / (4 * part_rows)).cast("int").alias("pieces"))

    def search(key: tuple, data: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(ask):
            _, directions = shared.value
            cell = Cell(np.stack(data["v"].to_numpy()).astype(float), data["ids"].tolist(), directions, 64)
            q = np.stack(ask["v"].to_numpy()).astype(float)
            for qid, x, point, bound in zip(ask["qid"], q, q @ directions, ask["bound"]):
                out += [(qid, i, d) for d, i in cell.search(x, point, k + 1, bound, factor)]
        return pd.DataFrame(out, columns=["qid", "vec_id", "score"]).astype({"qid": "int64", "vec_id": "int64", "score": "float64"})

    def upto(n: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def searched(ask: DataFrame) -> DataFrame:
        """ask (v, qid, bound, cell, part) against the vectors there; each piece is copied once a block of its queries."""
        where = ["cell", "part"]
        visits = ask.groupBy(*where).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).join(pieces, where)
        dealt = indexed.join(visits, where).withColumn("piece", F.pmod(F.xxhash64("v"), F.col("pieces")).cast("int")).withColumn("block", upto("blocks"))
        own = ask.join(visits, where).withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int")).withColumn("piece", upto("pieces"))
        key = (*where, "piece", "block")
        return dealt.select(*key, "v", "ids").groupBy(*key).cogroup(own.select(*key, "v", "qid", "bound").groupBy(*key)).applyInPandas(search, FOUND)

    first = scratch(searched(single.withColumn("bound", F.lit(float("inf")))), "round-one")
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("score", "vec_id")))
    bounds = ranked.where(F.col("n") == k + 1).select("qid", F.col("score").alias("bound"))

    def spread(batches):
        tree, directions = shared.value
        for b in batches:
            q = np.stack(b["v"].to_numpy()).astype(float)
            to = [tree.near(p, math.sqrt(factor) * bound) for p, bound in zip(q @ directions, b["bound"])]
            out = b.loc[b.index.repeat([len(t) for t in to])].copy()
            out["cell"] = np.concatenate(to).astype("int32")
            yield out[["v", "qid", "bound", "own_cell", "own_part", "cell"]]

    start = single.select("v", "qid", F.col("cell").alias("own_cell"), F.col("part").alias("own_part"))
    wider = start.join(bounds, "qid", "left").fillna(float("inf"), ["bound"]).mapInPandas(spread, "v array<double>, qid long, bound double, own_cell int, own_part int, cell int")
    visits = routed(wider, near=True).where("cell != own_cell or part != own_part").select("v", "qid", "bound", "cell", "part")
    found = first.unionByName(searched(scratch(visits, "visits")))
    top = found.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("score", "vec_id"))).where(F.col("n") <= k + 1)
    near = asked.join(single.select("v", "qid"), "v").select("qid", F.col("vec_id").alias("query_id")).join(top.drop("n"), "qid").where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
