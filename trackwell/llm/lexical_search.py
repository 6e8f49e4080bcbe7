"""Ranked lexical search over a document FP-tree, by depth-first branch and bound for each item.

1. The items' terms are the restricted vocabulary. One pass over the whole texts counts each document's terms (n) and
   its occurrences (tf) of restricted terms; from these rows come N, L and each term's df and weight.
2. A document becomes the vector of its restricted terms, most frequent term of the corpus first. Vectors are
   range-partitioned, so that documents that begin alike meet; equal vectors are told apart by document, so a group
   of copies is split like any other range.
3. A partition builds its FP-tree in blocks of documents: vectors with equal prefixes share the path down to leaves of
   few documents. A node keeps, of the documents below it, the greatest tf of every term and the least m.
4. An item goes down the tree, best child first. The score of the node's greatest tf at its least m bounds all scores
   below; what can't reach the item's tenth best so far is left out. Leaves are scored exactly. Each partition
   hands on its ten best of an item, and ranking merges them.

What is broadcast is one block of items: about `block_bytes` of their text at most (more only if one item is longer);
more items take more passes over the documents. Scores are 64-bit integers and independent of blocks and partitions.

Null texts and items have no terms. Documents and items without terms give no rows. Every row of the documents is a
document of its own, whatever its id; null ids come last among equal scores. Items that repeat entirely count once; one
item_id with several texts is several items. Texts of any length are read whole. Empty tables give no rows; other
columns are ignored."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackwell.llm.common import discard, scratch

#: ASCII but digits and letters parts terms; A-Z are lowered; bytes of other characters stay.
TERM_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): how many terms a text has, and the restricted ones with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        place, size = shared.value.get, len(shared.value)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                n, ids, of = [], [], []
                for d, text in enumerate(part.column("text").to_pylist()):
                    words = terms(text)
                    n.append(len(words))
                    known = [x for x in map(place, words) if x is not None]
                    ids += known
                    of.append(len(known))
                key, tf = np.unique(np.repeat(np.arange(len(n)), of) * size + np.array(ids, np.int64), return_counts=True)
                ends = np.searchsorted(key, np.arange(len(n) + 1) * size).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x, pa.int32())) for x in (key % max(size, 1), tf)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one unit of a term's weight scores: it grows with tf and falls with m."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Tree:
    """The FP-tree of a block of documents: vectors of term places (most frequent term first) with tf, and m.

    Leaves and inner nodes are numbered; children of a node lie side by side, and so do their terms' bounds."""

    def __init__(self, starts: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, leaf_docs: int = 16):
        """Documents must be in lexicographic order of their vectors. starts: where each one's terms begin, and the end."""
        self.starts, self.term, self.leaf_docs = starts, term, leaf_docs
        self.worth = saturated(tf, np.repeat(m, np.diff(starts)))
        self.leaf: dict[int, tuple[int, int]] = {}
        self.children: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.nodes = 1
        self._grow(0, 0, len(m), 0, 0, tf, m)

    def _prefix(self, low: int, high: int, depth: int) -> int:
        """How many terms the vectors from low to high - 1 share: in order, the first and the last tell it."""
        a, b = (self.term[self.starts[d] : self.starts[d + 1]] for d in (low, high - 1))
        while depth < min(len(a), len(b)) and a[depth] == b[depth]:
            depth += 1
        return depth

    def _grow(self, node: int, low: int, high: int, depth: int, level: int, tf: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Builds what is below a node; gives its terms, their greatest tf and the least m."""
        depth = self._prefix(low, high, depth) if high - low > self.leaf_docs else depth
        own = self.starts[low:high] + depth
        ends = self.starts[low + 1 : high + 1]
        first = np.where(own < ends, self.term[np.minimum(own, len(self.term) - 1)], -1) if len(self.term) else np.full(high - low, -1)
        cuts = np.flatnonzero(np.diff(first)) + 1
        if high - low <= self.leaf_docs or not len(cuts) or level >= 300:  # what nests deeper is one leaf
            self.leaf[node] = low, high
            a, b = self.starts[low], self.starts[high]
            return *greatest(self.term[a:b], tf[a:b]), int(m[low:high].min())
        edges = [low, *(low + cuts), high]
        numbers = np.arange(self.nodes, self.nodes + len(edges) - 1)
        self.nodes += len(numbers)
        made = [self._grow(int(k), i, j, depth, level + 1, tf, m) for k, i, j in zip(numbers, edges, edges[1:])]
        terms, most = np.concatenate([x[0] for x in made]), np.concatenate([x[1] for x in made])
        sizes = np.array([len(x[0]) for x in made])
        least = np.array([x[2] for x in made])
        self.children[node] = numbers, np.concatenate([[0], np.cumsum(sizes)]), terms, saturated(most, np.repeat(least, sizes))
        return *greatest(terms, most), int(least.min())

    def best(self, weight: np.ndarray, k: int, ids: np.ndarray) -> list[tuple[int, int]]:
        """(score, document) of the k best, highest first, ties by smaller ids; weight has the item's for every term."""
        found: list[tuple[int, int, int]] = []
        least = 1
        todo = [(0, 1 << 62)]
        while todo:
            node, bound = todo.pop()
            if bound < least:
                continue
            if node in self.leaf:
                low, high = self.leaf[node]
                a, b = self.starts[low], self.starts[high]
                score = sums(weight[self.term[a:b]] * self.worth[a:b], self.starts[low : high + 1] - a)
                for d in np.flatnonzero(score >= least):
                    found.append((-int(score[d]), int(ids[low + d]), low + int(d)))
                if len(found) >= k:
                    found = sorted(found)[:k]
                    least = max(1, -found[-1][0])
            else:
                numbers, starts, terms, worth = self.children[node]
                bounds = sums(weight[terms] * worth, starts)
                keep = np.flatnonzero(bounds >= least)
                todo += [(int(numbers[i]), int(bounds[i])) for i in keep[np.argsort(bounds[keep], kind="stable")]]
        return [(-s, d) for s, _, d in sorted(found)[:k]]


def greatest(terms: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each term once, with its greatest tf."""
    if not len(terms):
        return terms, tf
    by = np.argsort(terms, kind="stable")
    t = terms[by]
    heads = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    return t[heads], np.maximum.reduceat(tf[by], heads)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the pieces that begin at starts (the last is the end); an empty piece sums to 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def searched(docs: DataFrame, block: list, k: int, part_docs: int, tree_docs: int) -> DataFrame | None:
    """(item, doc_id, score): each partition's k best of each item of the block, by its number in it."""
    spark = docs.sparkSession
    asked = [Counter(terms(text)) for text in block]
    words = sorted({t for item in asked for t in item})
    if not words:
        return None
    rows = counted(docs, {t: i for i, t in enumerate(words)})
    rows = scratch(rows.where("n > 0"), "restricted")
    total, length = (x or 0 for x in rows.agg(F.count("*"), F.sum("n")).first())
    held = {r["t"]: r["df"] for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}  # a row a restricted term
    df = np.array([held.get(i, 0) for i in range(len(words))])
    rank = np.empty(len(words), np.int32)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(words), dtype=np.int32)
    weight = [math.floor(1000 * math.log((2 * total + 2) / (2 * int(d) + 1))) for d in df]
    at = {t: i for i, t in enumerate(words)}
    items = [(np.array([rank[at[t]] for t in item], np.int64), np.array([n * weight[at[t]] for t, n in item.items()], np.int64)) for item in asked]
    shared = spark.sparkContext.broadcast((rank, items, total, length, len(words)))

    def vectors(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rank, _, total, length, size = shared.value
        for b in batches:
            n, lists = b.column("n").to_pylist(), b.column("terms")
            of = np.diff(lists.offsets.to_numpy())
            own, place, tf = np.repeat(np.arange(len(n)), of), rank[lists.flatten().to_numpy()].astype(np.int64), b.column("tfs").flatten().to_numpy()
            by = np.lexsort((place, own))
            ends = pa.array(np.concatenate([[0], np.cumsum(of)]).astype(np.int32))
            m = pa.array([25 + 75 * x * total // length for x in n], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), m, pa.ListArray.from_arrays(ends, pa.array(place[by], pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf[by]))], names=["doc_id", "m", "path", "tfs"])

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        _, items, _, _, size = shared.value
        weight = np.zeros(size, np.int64)
        held, n = [], 0

        def block(parts: list) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            path, tf = t.column("path").combine_chunks(), t.column("tfs").combine_chunks()
            starts = path.offsets.to_numpy().astype(np.int64)
            ids = t.column("doc_id").combine_chunks()
            number = ids.fill_null((1 << 63) - 1).to_numpy()
            tree = Tree(starts - starts[0], path.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64), t.column("m").to_numpy())
            out = []
            for i, (places, w) in enumerate(items):
                weight[places] = w
                out += [(i, d, s) for s, d in tree.best(weight, k, number)]
                weight[places] = 0
            item, doc, score = (list(x) for x in zip(*out)) if out else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids.take(pa.array(doc, pa.int64())), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

        for b in batches:
            for i in range(0, b.num_rows, tree_docs):
                held.append(b.slice(i, tree_docs))
                n += held[-1].num_rows
                if n >= tree_docs:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    parts = max(spark.sparkContext.defaultParallelism, -(-total // part_docs))
    paths = rows.where(F.size("terms") > 0).mapInArrow(vectors, "doc_id long, m long, path array<int>, tfs array<int>")
    # The driver samples the ranges' keys: a vector's first terms are enough of it, a hash keeps equal vectors together.
    dealt = paths.repartitionByRange(parts, F.slice("path", 1, 16), F.xxhash64("path", "tfs"), "doc_id").sortWithinPartitions("path", "doc_id", "m")
    best = dealt.mapInArrow(search, "item int, doc_id long, score long")
    rank_of = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    out = scratch(best.withColumn("rank", rank_of.cast("int")).where(F.col("rank") <= k), "found")
    discard(rows)
    return out


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = 8 << 20, part_docs: int = 8192, tree_docs: int = 8192) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item, scores above 0."""
    spark = docs.sparkSession
    own = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    dealt = scratch(own.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items") if blocks > 1 else own.withColumn("block", F.lit(0))
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for b in range(blocks):
        block = dealt.where(F.col("block") == b).orderBy("item_id", "text").collect()  # at most about block_bytes
        found = searched(docs, [r["text"] for r in block], k, part_docs, tree_docs)
        if found is not None:
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item int, item_id {kind}")
            out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
