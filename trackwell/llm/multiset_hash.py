"""Document fingerprints by a homomorphic multiset hash.

A text is a multiset of paragraph units (lines, cut again at sentence ends and table bars). Each unit is hashed to a
wide vector and the vectors are summed, lane by lane, modulo powers of two: 8 lanes modulo 2^64 that tell multisets
apart, and 256 lanes of +1 or -1 modulo 2^16. Order doesn't matter, and units can be put in or taken out by adding
or subtracting their vectors, which is how the edited text's fingerprint is made here. The inner product of two
fingerprints' +-1 lanes estimates that of the unit counts, so 2ab / (aa + bb) tells how much two texts share.

Null texts count as empty; the empty text's vector is zero. The next document is the next row by (doc_id, text); rows
without doc_id come first, in the order of a hash of their text. Repeated rows follow each other; those without doc_id
are worked on once, with their number. A table of one row is its own next document."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = re.compile(r"[^\n.!?|]+[\n.!?|]*|[\n.!?|]+")
WIDE, SIGNS = 8, 256
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LANES = (np.arange(1, WIDE + SIGNS // 64 + 1, dtype=np.uint64) * _STEP)[None, :]


def unit_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the end of each unit of a text."""
    digest = xxhash.xxh64_intdigest
    found = [(digest(m[0].strip().encode("utf-8", "surrogatepass"), 7), m.end()) for m in UNIT.finditer(text)]
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, end = zip(*found)
    return np.array(h, np.uint64), np.array(end, np.int64)


def vector(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The summed vectors of units: WIDE numbers modulo 2^64 and SIGNS numbers modulo 2^16."""
    wide, signs = np.zeros(WIDE, np.uint64), np.zeros(SIGNS, np.int64)
    for i in range(0, len(hashes), 16384):
        x = hashes[i : i + 16384, None] + _LANES
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        wide += x[:, :WIDE].sum(0, dtype=np.uint64)
        bits = np.unpackbits(np.ascontiguousarray(x[:, WIDE:]).view(np.uint8), axis=1)
        signs += 2 * bits.sum(0, dtype=np.int64) - len(x)
    return wide, signs.astype(np.int16)


def add(a, b):
    """Vector of the union of two multisets."""
    return a[0] + b[0], a[1] + b[1]


def subtract(a, b):
    """Vector of a multiset with another's units taken out."""
    return a[0] - b[0], a[1] - b[1]


def written(v) -> str:
    return v[0].astype("<u8").tobytes().hex() + v[1].astype("<i2").tobytes().hex()


def likeness(a, b) -> float:
    """2ab / (aa + bb) of the unit counts, estimated from the fingerprints; 1 for equal ones."""
    if (a[0] == b[0]).all() and (a[1] == b[1]).all():
        return 1.0
    x, y = a[1].astype(float), b[1].astype(float)
    return float(min(1.0, max(0.0, 2 * (x @ y) / max(x @ x + y @ y, 1.0))))


class _Held:
    """A document waiting for the one after it."""

    def __init__(self, doc_id: int | None, text: str, copies: int):
        self.doc_id, self.text, self.copies = doc_id, text, copies
        self.hashes, self.ends = unit_hashes(text)
        self.vector = vector(self.hashes)

    def rows(self, after: _Held) -> Iterator[tuple]:
        """The rows of its copies: all but the last are followed by another one."""
        if self.copies > 1:
            yield (*self.row(self), self.copies - 1)
        yield (*self.row(after), 1)

    def row(self, after: _Held) -> tuple:
        n = len(self.text)
        k = n // 4
        new = after.text[:k]
        edited = self.text[: n - k] + new
        stay = int(np.searchsorted(self.ends, n - k, "left")) if k else len(self.ends)  # units that end before the edit
        at = int(self.ends[stay - 1]) if stay else 0
        changed = subtract(self.vector, vector(self.hashes[stay:]))
        changed = add(changed, vector(unit_hashes(edited[at:])[0])) if k else self.vector
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return self.doc_id, n, sha, written(self.vector), written(changed), likeness(self.vector, changed), likeness(self.vector, after.vector)


PER_BUCKET = 32 << 20  # bytes of text


def bucketed(docs: DataFrame, per_bucket: int) -> tuple[DataFrame, list[tuple[int, int | None, int | None]]]:
    """docs (doc_id, text, place) with a bucket number in the order of doc_id, null first, and place; and (bucket, least
    doc_id, least place) of each bucket that has rows. A bucket holds about `per_bucket` bytes."""
    from pyspark.ml.feature import Bucketizer

    known = F.col("doc_id").isNotNull()
    size = F.octet_length("text").cast("long") + 64
    total, nulls = (x or 0 for x in docs.agg(F.sum(F.when(known, size)), F.sum(F.when(~known, size))).first())
    per_bucket = max(per_bucket, (total + nulls) // 50_000)  # streamed, so that larger ones only take longer
    buckets, ahead = max(2, math.ceil(total / per_bucket)), math.ceil(nulls / per_bucket)
    cuts = docs.select(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], max(10_000, 8 * buckets))).first()[0]
    splits = [-float("inf"), *sorted({float(c) for c in cuts or [0]}), float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="_at", outputCol="_bucket", handleInvalid="keep").transform(docs.withColumn("_at", F.col("doc_id").cast("double")))
    early = F.floor((F.col("place") / 2.0**64 + 0.5) * ahead).cast("int") - ahead  # ranges of the hash, before all others
    dealt = dealt.withColumn("_bucket", F.when(known, F.col("_bucket").cast("int")).otherwise(F.greatest(early, F.lit(-ahead)))).drop("_at")
    heads = dealt.groupBy("_bucket").agg(F.min(F.struct("doc_id", "place")).alias("head")).orderBy("_bucket").collect()  # a row a bucket
    return dealt, [(r["_bucket"], r["head"]["doc_id"], r["head"]["place"]) for r in heads]


def fingerprinted(docs: DataFrame, per_bucket: int = PER_BUCKET) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    Documents are dealt once, into ordered buckets of about `per_bucket` bytes, a task each, and streamed in order;
    each bucket also gets the first document of the next one, and the last bucket the very first."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bare = rows.where("doc_id is null").groupBy("doc_id", "text").agg(F.count("*").alias("copies")).withColumn("place", F.xxhash64("text"))
    rows = rows.where("doc_id is not null").withColumns({"copies": F.lit(1).cast("long"), "place": F.lit(None).cast("long")}).unionByName(bare)
    dealt, heads = bucketed(rows, per_bucket)
    to = spark.createDataFrame([(heads[i - 1][0], *h) for i, h in enumerate(heads)], "_to int, _from int, _head long, _place long")
    joined = (F.col("_bucket") == F.col("_from")) & F.col("doc_id").eqNullSafe(F.col("_head")) & F.col("place").eqNullSafe(F.col("_place"))
    first = dealt.join(F.broadcast(to), joined)  # a row a bucket
    first = first.groupBy("_to").agg(F.min(F.struct("doc_id", "text", "place")).alias("d")).select("d.*", F.lit(1).cast("long").alias("copies"), F.col("_to").alias("_bucket"), F.lit(1).alias("_after"))
    every = dealt.withColumn("_after", F.lit(0)).unionByName(first)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("times", pa.int64())])
        held = None
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part, out = b.slice(i, 512), []
                for doc_id, text, copies, after in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "copies", "_after"))):
                    now = _Held(doc_id, text, copies)
                    if held is not None:
                        out += held.rows(now)
                    held = None if after else now
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(kinds)], schema=kinds)

    low, high = heads[0][0] if heads else 0, heads[-1][0] if heads else 0
    tasks = every.withColumn("_task", F.col("_bucket") - low).repartitionById(high - low + 1, "_task")
    ordered = tasks.sortWithinPartitions("_bucket", "_after", F.asc_nulls_first("doc_id"), "place", "text").select("doc_id", "text", "copies", "_after")
    made = ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, times long")
    return made.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("_", "times")
