"""SimHash near-duplicates by meet-in-the-middle ball hashing, and near copies by whole shingle sets.

Every distinct fingerprint emits itself and its variants within half the radius (radius 2: the 64 one-bit flips).
Two fingerprints within the radius share a variant, so a shuffle on variants brings them together; each row of a
variant is tied to that variant's smallest fingerprint and to its predecessor (a line of links, never all pairs).

For one 64-bit fingerprint at radius 2, all fingerprints under one variant lie within one bit of it, hence within
two of each other: at most 65 distinct ones, and the ties lose no link. Exact copies collapse to one fingerprint
before anything is emitted, so a group of copies of any size costs one set of variants.

Null texts count as empty. A text without words has fingerprint zero. Null doc_ids keep their own rows and take
part in links; they never become a component id unless all ids of the component are null. Repeated rows are rows of
their own with the same result. Texts of any length are read whole, in blocks of hashes. An empty table
gives no rows; other columns are ignored, and one_of_each() passes them on, whatever their names."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackwell.llm.common import components, discard, mapped, scratch

SEED = 42


def word_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of the words `[^\\x20\\x09-\\x0D]+` (A-Z lowered), repeats included."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, "<u8")
    if len(w) <= words:
        parts = [b" ".join(w)]
    else:
        parts = [b" ".join(x) for x in zip(*(w[i:] for i in range(words)))] if words > 1 else w
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, SEED) for x in parts), "<u8", len(parts))


def majority(hashes: np.ndarray, block: int = 65536) -> int:
    """The signed 64-bit number whose bit b is set if more than half the hashes have it."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), block):
        part = hashes[i : i + block]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long): the 64-bit SimHash of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return mapped(rows, "text", ["doc_id"], "fp long", lambda texts: [[majority(word_hashes(t, words)) for t in texts]])


def ball_links(values: DataFrame, bits: int, radius: int = 2, task_rows: int = 1_000_000) -> DataFrame:
    """Links (u, v) between distinct fingerprints (value) that differ in at most radius (2 or less) of bits bits, or in
    one bit with a third that links them. Each task emits about `task_rows` variants."""
    masks = [0] + [(1 << b) - (1 << 64 if b == 63 else 0) for b in range(bits if radius else 0)]
    values = values.repartition(max(1, math.ceil(values.count() * len(masks) / task_rows)))
    emitted = values.select("value", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    emitted = emitted.select(F.col("value").bitwiseXOR(F.col("mask")).alias("variant"), "value")
    by_variant = Window.partitionBy("variant").orderBy("value")
    met = emitted.select("value", F.first("value").over(by_variant).alias("first"), F.lag("value").over(by_variant).alias("before"))
    pairs = met.where("value != first").select(F.explode(F.array("first", "before")).alias("u"), F.col("value").alias("v"))
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).distinct()


def ball_classes(marked: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint of marked (doc_id, fp): the smallest doc_id that links reach."""
    distinct = scratch(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    reach = components(ball_links(distinct.select(F.col("fp").alias("value")), 64, radius))
    least = distinct.join(reach, distinct.fp == reach.node, "left").select("fp", F.coalesce("component", "fp").alias("component"), "least")
    least = scratch(least, "simhash-classes")
    root = least.groupBy("component").agg(F.min("least").alias("component_id"))
    return least.join(root, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    marked = scratch(fingerprints(docs, words), "simhash")
    named = ball_classes(marked, radius)
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _bottom(hashes: np.ndarray, k: int | None) -> np.ndarray:
    return np.unique(hashes.view("<i8"))[:k]


BANDS, ROWS = 24, 5  # similarity 0.8: a pair shares no band in 1 of 10,000 cases
_salts = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), "uint64")


def band_keys(shingles: np.ndarray, block: int = 1024) -> list[int]:
    """A key for each band: a hash of the band's minima of the shingle hashes under ROWS orders of their own."""
    least = np.full(BANDS * ROWS, np.iinfo("uint64").max, "uint64")
    for i in range(0, len(shingles), block):
        np.minimum(least, ((shingles[i : i + block, None] ^ _salts[0]) * (_salts[1] | np.uint64(1))).min(0), out=least)
    return [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) - (1 << 63) for b in range(BANDS)]


def signatures(docs: DataFrame, sketch: int) -> DataFrame:
    """(doc_id, digest, fp, bands, sketch): a text's MD5, the SimHash and the band keys of its five-word shingles, and
    the `sketch` smallest of their hashes. All texts without words have the same bands and an empty sketch."""

    def run(texts: list[str]) -> tuple:
        every = [word_hashes(t, 5) for t in texts]
        sets = [np.unique(h) for h in every]
        return [majority(h) for h in every], [band_keys(h) for h in sets], [_bottom(h, sketch) for h in sets]

    return mapped(_readable(docs), "text", ["doc_id", "digest"], "fp long, bands array<long>, sketch array<long>", run)


def _readable(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), text.alias("text"), F.md5(text).alias("digest"))


def shingle_sets(marked: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, shingles): the whole set of hashes of the five-word shingles of each text that marked (doc_id, digest) names."""
    texts = _readable(docs).join(marked.select("doc_id", "digest"), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id"])
    return mapped(texts, "text", ["doc_id"], "shingles array<long>", lambda t: [[_bottom(word_hashes(x, 5), None) for x in t]], group=128)


def resemblance(a: Column, b: Column, sketch: int) -> Column:
    """Jaccard similarity of two shingle sets from their smallest hashes; exact for a union of up to `sketch` hashes.
    Two empty sets are equal."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, sketch)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(F.array_intersect(union, a), b)), F.size(union)), F.lit(1.0))


def verified(pairs: DataFrame, marked: DataFrame, docs: DataFrame, sketch: int, similarity: float, block: int = 2000) -> DataFrame:
    """The pairs (u, v) whose five-word shingle sets have a Jaccard similarity of `similarity` or more.

    The sketches only discard strangers (an estimate of five standard errors less); whole sets decide all others. Of a
    pair the document with more links is the centre. A centre's links come in blocks of about `block`, and its set
    travels once a block, however many links it has; the others' sets travel once a link."""
    clear = similarity - 5 * (similarity * (1 - similarity) / sketch) ** 0.5
    left, right = (marked.select(F.col("doc_id").alias(x), F.col("sketch").alias(f"s{x}")) for x in "uv")
    near = pairs.join(left, "u").join(right, "v").where(resemblance(F.col("su"), F.col("sv"), sketch) >= clear)
    near = scratch(near.select("u", "v"), "near")
    ends = near.select(F.explode(F.array("u", "v")).alias("doc_id"))
    degrees = scratch(ends.groupBy("doc_id").agg(F.count("*").alias("n")), "degrees")
    sets = scratch(shingle_sets(degrees.join(marked, "doc_id"), docs), "shingles")
    nu, nv = (degrees.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}")) for x in "uv")
    more = F.col("nu") >= F.col("nv")
    links = near.join(nu, "u").join(nv, "v").select(F.when(more, F.col("u")).otherwise(F.col("v")).alias("centre"), F.when(more, F.col("v")).otherwise(F.col("u")).alias("leaf"), F.greatest("nu", "nv").alias("n"))
    links = scratch(links.select("centre", "leaf", F.pmod(F.xxhash64("leaf"), F.ceil(F.col("n") / block)).alias("part")), "blocks")
    own = sets.select(F.col("doc_id").alias("leaf"), "shingles")
    leaves = links.join(own, "leaf").select("centre", "part", "leaf", "shingles", F.lit(1).alias("kind"))
    centres = links.select("centre", "part").distinct().join(own.withColumnRenamed("leaf", "centre"), "centre").select("centre", "part", F.lit(None).cast("long").alias("leaf"), "shingles", F.lit(0).alias("kind"))

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        centre = np.empty(0, np.int64)
        for b in batches:
            kinds, lists = b.column("kind").to_pylist(), b.column("shingles")
            found = []
            for i, kind in enumerate(kinds):
                own = np.sort(lists.slice(i, 1).flatten().to_numpy())
                if not kind:
                    centre = own
                    continue
                at = np.minimum(np.searchsorted(centre, own), max(0, len(centre) - 1))
                shared = int((centre[at] == own).sum()) if len(centre) else 0
                if shared >= similarity * (len(centre) + len(own) - shared):
                    found.append(i)
            hit = b.take(pa.array(found, pa.int64()))
            yield pa.RecordBatch.from_arrays([hit.column("centre"), hit.column("leaf")], names=["a", "b"])

    blocks = centres.unionByName(leaves).repartition("centre", "part").sortWithinPartitions("centre", "part", "kind")
    hits = blocks.mapInArrow(compare, "a long, b long")
    out = scratch(hits.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")), "links")
    for used in (near, degrees, sets, links):
        discard(used)
    return out


def similar_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Every pair (u, v) of different classes with Jaccard similarity of `similarity` or more, and few others, each once.
    sets: (doc_id, shingles, c), c the document's class.

    A prefix join: shingles are ordered from the rarest on (among these documents), and only a document's first ones
    are shuffled, so many that two similar sets must share one of them. Pairs that meet are kept if their sizes and
    what is left after the shared shingle allow the similarity: text that very many otherwise different documents
    share, or copies that each have enough of their own, part before anything is compared."""
    tokens = scratch(sets.select("doc_id", "c", F.size("shingles").alias("n"), F.explode("shingles").alias("token")), "tokens")
    spread = tokens.groupBy("token").agg(F.count("*").alias("df"))
    ranked = tokens.join(spread, "token").withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "token")) - 1)
    prefix = ranked.where((F.col("df") > 1) & (F.col("at") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-6)))
    prefix = scratch(prefix.select("token", "doc_id", "c", "n", "at"), "prefix")
    left, right = (prefix.select("token", *[F.col(k).alias(f"{k}_{x}") for k in ("doc_id", "c", "n", "at")]) for x in "uv")
    rest = F.least(F.col("n_u") - F.col("at_u"), F.col("n_v") - F.col("at_v"))
    fits = (rest * (1 + similarity) >= similarity * (F.col("n_u") + F.col("n_v")) - 1e-6) & (F.least("n_u", "n_v") >= similarity * F.greatest("n_u", "n_v") - 1e-6)
    met = left.join(right, (left["token"] == right["token"]) & (F.col("doc_id_u") < F.col("doc_id_v")) & (F.col("c_u") != F.col("c_v")) & fits)
    out = scratch(met.select(F.col("doc_id_u").alias("u"), F.col("doc_id_v").alias("v")).distinct(), "similar")
    discard(tokens)
    discard(prefix)
    return out


def near_copy_classes(marked: DataFrame, docs: DataFrame, sketch: int, similarity: float) -> DataFrame:
    """(doc_id, component) of the documents that resemble another one. marked: signatures, one row per doc_id.

    First links: each document with the smallest one of its SimHash class (fingerprints within two bits, by ball
    hashing), and with the most central document of each band's key that it shares; at similarity s two share a key
    with 1 - (1 - s^5)^24. The most central one meets the most others over all its keys: in a group of copies that is
    the one that the others were made from. Then the documents whose keys hold several classes yet go through a prefix
    join over all of them. So every pair that meets under a key is verified, connected already or ruled out."""
    classes = ball_classes(marked.select("doc_id", "fp"))
    alike = marked.join(classes, "fp").where("component_id < doc_id").select(F.col("component_id").alias("u"), F.col("doc_id").alias("v"))
    rows = marked.select(F.explode("bands").alias("band"), F.col("doc_id").alias("key"))
    crowds = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = scratch(rows.join(crowds, "band"), "met")
    central = met.join(met.groupBy("key").agg(F.sum("n").alias("meets")), "key")
    pivot = central.groupBy("band").agg(F.max(F.struct("meets", (-F.col("key")).alias("least"))).alias("m")).select("band", (-F.col("m.least")).alias("u"))
    near = met.join(pivot, "band").where("u != key").select(F.least("u", "key").alias("u"), F.greatest("u", "key").alias("v"))
    links = verified(near.unionByName(alike).distinct(), marked, docs, sketch, similarity)
    reach = scratch(components(links), "reach")
    named = met.select("band", "key").join(reach, met["key"] == reach["node"], "left").select("band", "key", F.coalesce("component", "key").alias("c"))
    parted = named.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("band")
    parted = named.join(parted, "band", "left_semi").groupBy("key").agg(F.first("c").alias("c"))
    asked = scratch(marked.join(parted, marked["doc_id"] == parted["key"]).select("doc_id", "digest", "c"), "parted")
    sets = shingle_sets(asked, docs).join(asked.select("doc_id", "c"), "doc_id")
    more = verified(similar_pairs(sets, similarity), marked, docs, sketch, similarity)
    discard(met)
    return components(links.unionByName(more)).select(F.col("node").alias("doc_id"), "component")


def one_of_each(docs: DataFrame, similarity: float = 0.8, sketch: int = 128) -> DataFrame:
    """The documents with all but the smallest doc_id of each group of exact or near copies taken out.

    Near copies resemble each other in five-word shingles by `similarity` or more, directly or through others. Texts
    without words (empty, spaces) are copies of each other. A row that occurs more than once stays once. Rows without
    doc_id stay as they are. Other columns are passed on."""
    marked = scratch(signatures(docs, sketch), "signatures")
    exact = marked.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    distinct = scratch(marked.join(exact.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "distinct")
    classes = near_copy_classes(distinct, docs, sketch, similarity)
    gone = classes.where("doc_id != component").select("doc_id")
    keep = scratch(exact.join(gone, "doc_id", "left_anti").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")), "keep")
    keyed = docs.where("doc_id is not null").withColumn("_d", F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    stay = keyed.join(keep, (keyed["doc_id"] == keep["_id"]) & (keyed["_d"] == keep["_digest"]), "left_semi")
    again = marked.groupBy("doc_id", "digest").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    if again.limit(1).count():
        repeated = (stay["doc_id"] == again["_id"]) & (stay["_d"] == again["_digest"])
        stay = stay.join(again, repeated, "left_anti").unionByName(stay.join(again, repeated, "left_semi").dropDuplicates(["doc_id", "_d"]))
    return stay.drop("_d").unionByName(docs.where("doc_id is null"))
