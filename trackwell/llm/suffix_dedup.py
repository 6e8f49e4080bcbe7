"""Removal of repeated byte strings by a sparse suffix array, range-partitioned by sampled splitters.

A string of `length` bytes (200) that starts at two places, in whatever documents, is removed at both. All suffixes of a
corpus, with the bytes that order them, are hundreds of times the corpus. So only those that can matter are sorted:

1. Every window of `length` bytes names one of its 32-byte grams, the first one with the least hash. Equal windows name
   equal grams at equal places. These anchors are about one in 85 bytes; an anchor has a range of windows that name it.
2. Anchors whose gram no other anchor has can't be in a repeated window; counting and one join on the gram's hash leave
   the rest. Texts are joined with the anchors left, and each becomes a suffix: the bytes from the anchor on as far
   as its windows reach, and the bytes before it, last first.
3. Suffixes are range-partitioned by their leading bytes (Spark samples the splitters). A bucket sorts them
   by multikey quicksort, eight bytes at a time, and does the same for the bytes before the anchors. Neighbours' common
   lengths in both orders give, for each place of the anchor in the window, classes of equal left and right
   parts; a window whose pair of classes occurs twice is repeated. No two suffixes are compared pair by pair.
4. Only windows whose gram is a bucket's first or last can have their like in another bucket. These are compared across
   boundaries by 128-bit hashes of the whole windows, one for each distinct repeated window of a bucket, so a gram
   that a third of all anchors share is split over buckets like any other range, and counted.

Documents with equal texts are one text to all this, with every window repeated; so copies, however many, cost one text
and a count. Texts are told apart by 128-bit hashes. A bucket holds about `bucket_rows` suffixes.

Null texts count as empty; texts shorter than the window keep everything. Rows are documents whatever their ids: a
repeated row is another document with the same text, so all its windows are repeated. Very long texts are read whole,
in slices; identical surroundings in one text (runs of one character) are one suffix with many places. Other columns
are ignored; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwell.llm.common import discard, scratch

GRAM = 32
SLICE = 1 << 19  # windows whose anchors are found at once
KEY = ["k1", "k2"]


def text_key(text) -> list:
    """Two 64-bit hashes of a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes from each place on."""
    n = len(data) - 7
    h = np.ndarray((n,), "<u8", data.data if data.flags.c_contiguous else data.tobytes(), 0, (1,)).copy()
    for step, a, b in ((8, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (16, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93)):
        x = h[:-step] * np.uint64(a)
        x ^= x >> np.uint64(29)
        x += h[step:]
        x *= np.uint64(b)
        x ^= x >> np.uint64(32)
        h = x
    return h


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, gram hash, place, first and last window start) of the anchors of texts that lie one after another in data.

    Places and window starts count from the text's start."""
    width = length - GRAM + 1
    out = []
    for a in range(0, max(0, int(ends[-1]) - length + 1) if len(ends) else 0, SLICE):
        part = data[a : a + SLICE + length - 1]
        h = gram_hashes(np.ascontiguousarray(part))
        low = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype=np.uint64)  # the least hash, and the first of these
        step = 1
        while step * 2 <= width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
        at = (low & np.uint64(0xFFFFF)).astype(np.int64)
        s = np.arange(a, a + len(at))
        text = np.searchsorted(starts, s, "right") - 1
        fine = s + length <= ends[text]
        s, at, text = s[fine], at[fine], text[fine]
        if not len(s):
            continue
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1) | (text[1:] != text[:-1])]))
        last = np.concatenate([new[1:] - 1, [len(s) - 1]])
        t = text[new]
        out.append((t, h[at[new]].view(np.int64), a + at[new] - starts[t], s[new] - starts[t], s[last] - starts[t]))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out))


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of an Arrow column of strings or binaries without nulls; where each begins and ends."""
    kind = np.int64 if "large" in str(column.type) else np.int32
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return every[o[0] : o[-1]], o[:-1] - o[0], o[1:] - o[0]


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """The order of rows of words, from the first word on: rows that are equal so far are parted by the next word."""
    order = np.argsort(words[:, 0], kind="stable")
    group = np.zeros(len(words), np.int64)
    for depth in range(words.shape[1]):
        sorted_word = words[order, depth]
        new = np.concatenate([[False], (sorted_word[1:] != sorted_word[:-1]) | (group[1:] != group[:-1])])
        group = np.cumsum(new)
        if depth + 1 == words.shape[1]:
            break
        tied = np.concatenate([group[1:] == group[:-1], [False]])
        tied[1:] |= tied[:-1].copy()
        i = np.flatnonzero(tied)
        if not len(i):
            break
        order[i] = order[i][np.lexsort((words[order[i], depth + 1], group[i]))]
    return order


def sorted_common(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes, and how many bytes each has in common with the one before it (the first: 0)."""
    pad = -data.shape[1] % 8
    words = np.ascontiguousarray(np.pad(data, ((0, 0), (0, pad)))).view(">u8").astype(np.uint64)
    order = multikey_quicksort(words)
    s = data[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(1), differ.argmax(1), data.shape[1]) if len(data) > 1 else np.empty(0, np.int64)
    return order, np.concatenate([[0], common]).astype(np.int64)


def repeated(left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray, many: np.ndarray, length: int) -> np.ndarray:
    """For each row and each place 0.. of the anchor in a window: is the window one of the row's and does it occur again.

    left: the bytes before the anchors, last first; right: those from the anchors on; low and high: the places that
    the row's windows have; many: rows that stand for several places, whose windows all occur again."""
    n, places = len(left), left.shape[1] + 1
    o = np.arange(places)
    own = (o >= low[:, None]) & (o <= high[:, None])
    found = own & many[:, None]
    by_right, common_right = sorted_common(right)
    by_left, common_left = sorted_common(left)

    def nearest(order: np.ndarray, common: np.ndarray) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[order] = np.maximum(common, np.concatenate([common[1:], [0]]))
        return out

    most_right, most_left = nearest(by_right, common_right), nearest(by_left, common_left)
    first, last = np.maximum(low, length - most_right), np.minimum(high, most_left)  # elsewhere a part has no equal
    class_right, class_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for x in range(int(first.min()), int(last.max()) + 1) if n else ():
        i = np.flatnonzero((first <= x) & (x <= last))
        if len(i) < 2:
            continue
        class_right[by_right] = np.cumsum(common_right < length - x)
        class_left[by_left] = np.cumsum(common_left < x)
        key = class_right[i] * (n + 1) + class_left[i]
        by = np.argsort(key)
        same = np.concatenate([[False], key[by[1:]] == key[by[:-1]]])
        same[:-1] |= same[1:].copy()
        found[i[by[same]], x] = True
    return found


def _suffixes(texts: DataFrame, length: int) -> DataFrame:
    """texts (k1, k2, text, locs: array of place, first and last window) as suffixes: right, left, k1, k2, low, high, places."""
    before = length - GRAM

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["right", "left", "k1", "k2", "low", "high", "places"]
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
        rows: list[tuple] = []
        for b in batches:
            for i in range(b.num_rows):
                data = b.column("text")[i].as_py().encode("utf-8", "surrogatepass")
                k1, k2 = b.column("k1")[i].as_py(), b.column("k2")[i].as_py()
                locs = b.column("locs").slice(i, 1).flatten()
                at, first, last = (locs.field(c).to_numpy() for c in ("at", "first", "last"))
                joined: dict[int, tuple[int, int]] = {}
                for p, f, z in zip(at.tolist(), first.tolist(), last.tolist()):  # a slice's edge parts an anchor in two
                    f0, z0 = joined.get(p, (f, z))
                    joined[p] = min(f, f0), max(z, z0)
                same: dict[tuple, list[int]] = {}
                for p, (f, z) in joined.items():
                    right, left = data[p : p + length], data[max(0, p - before) : p][::-1]
                    same.setdefault((right.ljust(length, b"\0"), left.ljust(before, b"\0"), p - z, p - f), []).append(p)
                rows += [(r, x, k1, k2, low, high, places) for (r, x, low, high), places in same.items()]
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return texts.mapInArrow(run, "right binary, left binary, k1 long, k2 long, low int, high int, places array<long>")


def _buckets(suffixes: DataFrame, length: int) -> DataFrame:
    """A bucket a partition: spans (k1, k2, start, stop) that occur again in it, and, with hashes w1 and w2, windows of its
    outer grams: those without their like in the bucket with their place, of the others one each without key."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["w1", "w2", "k1", "k2", "start", "stop"]
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        right, left = (_bytes_of(t.column(c).combine_chunks())[0].reshape(t.num_rows, -1) for c in ("right", "left"))
        k1, k2, low, high = (t.column(c).to_numpy() for c in ("k1", "k2", "low", "high"))
        places = t.column("places").combine_chunks()
        ends = places.offsets.to_numpy().astype(np.int64) - places.offsets[0].as_py()
        flat = places.flatten().to_numpy()
        many = np.diff(ends) > 1
        found = repeated(left, right, low, high, many, length)
        edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, a = np.nonzero(edge == 1)
        z = np.nonzero(edge == -1)[1] - 1  # windows with the anchor at a to z: bytes from place - z to place - a + length
        times = ends[row + 1] - ends[row]
        which = np.repeat(np.arange(len(row)), times)
        at = flat[np.repeat(ends[row], times) + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)] if len(which) else np.empty(0, np.int64)
        none = pa.nulls(len(which), pa.int64())
        for i in range(0, len(which), 65536):
            w = which[i : i + 65536]
            yield pa.RecordBatch.from_arrays([none[i : i + 65536], none[i : i + 65536], pa.array(k1[row[w]]), pa.array(k2[row[w]]), pa.array(at[i : i + 65536] - z[w]), pa.array(at[i : i + 65536] - a[w] + length)], names=names)
        grams = right[:, :GRAM]
        words = np.ascontiguousarray(grams).view(">u8")
        by = np.lexsort(tuple(words[:, c] for c in range(words.shape[1] - 1, -1, -1)))
        outer = np.flatnonzero((grams == grams[by[0]]).all(1) | (grams == grams[by[-1]]).all(1))
        told, rows = set(), []
        for i in outer.tolist():
            back, on = left[i, ::-1].tobytes(), right[i].tobytes()
            for o in range(int(low[i]), int(high[i]) + 1):
                d = xxhash.xxh3_128_digest((back[len(back) - o :] if o else b"") + on[: length - o])
                w = int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
                if not found[i, o]:
                    start = int(flat[ends[i]]) - o
                    rows.append((*w, int(k1[i]), int(k2[i]), start, start + length))
                elif w not in told:
                    told.add(w)
                    rows.append((*w, None, None, None, None))
            if len(rows) >= 16384:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    return suffixes.mapInArrow(run, "w1 long, w2 long, k1 long, k2 long, start long, stop long")


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans that overlap or touch."""
    by = np.argsort(starts, kind="stable")
    starts, stops = starts[by], np.maximum.accumulate(stops[by])
    new = np.concatenate([[True], starts[1:] > stops[:-1]])
    return starts[new], stops[np.concatenate([new[1:], [True]])]


def spans(docs: DataFrame, length: int = 200, bucket_rows: int = 30_000) -> DataFrame:
    """(k1, k2, start, stop) of what is to be removed of the texts with these keys; spans may overlap. docs: text."""
    spark = docs.sparkSession
    rows = docs.select(*text_key(F.col("text")), "text")

    def found(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            data, starts, ends = _bytes_of(b.column("text"))
            t, g, at, first, last = anchors(data, starts, ends, length)
            i = pa.array(t)
            yield pa.RecordBatch.from_arrays([b.column("k1").take(i), b.column("k2").take(i), *(pa.array(x) for x in (g, at, first, last))], names=["k1", "k2", "g", "at", "first", "last"])

    long_enough = rows.where(F.octet_length("text") >= length)
    every = long_enough.mapInArrow(found, "k1 long, k2 long, g long, at long, first long, last long").distinct()  # of copies one
    every = scratch(every, "anchors")
    twice = scratch(every.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "grams")  # so that the join can split a gram
    left = every.join(twice, "g").groupBy(*KEY).agg(F.collect_set(F.struct("at", "first", "last")).alias("locs"))
    left = scratch(left, "candidates")
    discard(every)
    discard(twice)
    total = left.agg(F.sum(F.size("locs"))).first()[0] or 0
    one = long_enough.groupBy(*KEY).agg(F.first("text").alias("text"))  # copies become one text before they move
    parts = max(spark.sparkContext.defaultParallelism, -(-total // bucket_rows))
    suffixes = scratch(_suffixes(one.join(left, KEY), length), "suffixes")
    discard(left)
    # Leading bytes are the ranges' key, and few of them, as the driver samples keys; a hash parts what begins alike.
    leading = [F.substring("right", 1, GRAM + 8), F.substring("left", 1, 8), F.xxhash64("right", "left"), *KEY]
    buckets = scratch(_buckets(suffixes.repartitionByRange(parts, *leading), length), "spans")
    discard(suffixes)
    own = buckets.where("w1 is null")
    across = buckets.where("w1 is not null")
    again = across.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    met = across.where("k1 is not null").join(again, ["w1", "w2"])
    copies = long_enough.groupBy(*KEY).agg(F.count("*").alias("n"), F.max(F.octet_length("text")).cast("long").alias("stop")).where("n > 1")
    columns = [*KEY, "start", "stop"]
    return own.select(columns).unionByName(met.select(columns)).unionByName(copies.select(*KEY, F.lit(0).cast("long").alias("start"), "stop"))


def without_repeats(docs: DataFrame, length: int = 200, bucket_rows: int = 30_000) -> DataFrame:
    """doc_id, kept (the bytes that stay), n_bytes, removed: array of the maximal runs (start, stop) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cut = spans(rows, length, bucket_rows).groupBy(*KEY).agg(F.collect_set(F.struct("start", "stop")).alias("cuts"))
    cut = scratch(cut, "cuts")  # a row a text, so that the join can split a text with very many copies
    both = rows.select("doc_id", "text", *text_key(F.col("text"))).join(cut, KEY, "left").select("doc_id", "text", "cuts")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                kept, sizes, removed = [], [], []
                for j in range(part.num_rows):
                    data = part.column("text")[j].as_py().encode("utf-8", "surrogatepass")
                    cuts = part.column("cuts").slice(j, 1).flatten()
                    a, z = merged(cuts.field("start").to_numpy(), cuts.field("stop").to_numpy()) if len(cuts) else (np.empty(0, np.int64),) * 2
                    edges = [0, *np.ravel(np.column_stack([a, z])).tolist(), len(data)]
                    kept.append(b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2])))
                    sizes.append(len(data))
                    removed.append([{"start": x, "stop": y} for x, y in zip(a.tolist(), z.tolist())])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, kind)], names=["doc_id", "kept", "n_bytes", "removed"])

    return both.mapInArrow(run, "doc_id long, kept binary, n_bytes long, removed array<struct<start: long, stop: long>>")


def digests(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    rows = without_repeats(docs, length)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["stop"] - r["start"])
    return rows.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
