"""Toxicity by compression distance.

Two zstandard dictionaries are trained on the windows of labelled texts. A window is a word with its borders, lower
case, each character written as four fixed bytes so that zstd's whole-byte lengths are fine enough for a word; over a
run of more than 16 letters (a script without spaces) windows of eight letters slide, letter by letter. The ordinary dictionary comes first, from the windows that recur in ordinary texts.
It also holds the windows of one or two ordinary texts that recur in toxic ones without being far more frequent there.
The toxic one is trained on what is left for it to say: windows that recur in toxic texts (in `least` texts, whatever
the sample) and that the ordinary dictionary can't compress. Search tables are as large as a dictionary needs, so that
all of it is searched, and lengths count from what a window costs that the dictionary holds whole: a reference into a
large dictionary takes more bytes than one into a small dictionary. Windows of ordinary texts that the toxic dictionary
compresses better nonetheless then go into the ordinary one.

A window's distance is what the toxic dictionary saves against the ordinary one, as a share of the most that it could
save (all of what the ordinary one leaves, and a tenth of the window at least). The threshold on the distance is the one that,
with a least number of windows beyond it, best separates the learning texts; a document's score is the share of toxic
learning texts among those with as many windows beyond the threshold (0, 1, 2, 3, 4 or more), smoothed and never
falling. (Wider windows were tried; the README has the figures.)

The model is fitted on a bounded sample: at most `sample` labelled documents a class, by hash of doc_id, copies
counted once; all of their windows count. Whole texts are scored, whatever their length; repeated rows get the same
score. Null and empty texts have no window and get the lowest score. Without learning documents of both classes every
score is 0. Two labels of one document, or of equal texts, count as the higher one.
An empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwell.llm.common import discard, mapped, scratch
from trackwell.llm.language_id import held_out

WORD = re.compile(r"[^\W\d_]+")
LONG, PIECE = 16, 8  # letters of a run that is more than a word (scripts without spaces), and of the windows that slide over it
GRID = tuple(round(0.02 * i, 2) for i in range(15, 50))
MOST_BITS = 27  # of a search table: 64 MB of dictionary


def search(size: int) -> zstandard.ZstdCompressionParameters:
    """A deep search of a whole dictionary of so many bytes: the usual levels give up after a few places that begin alike,
    and a tree has room for half as many places as its table has entries."""
    bits = min(MOST_BITS, max(20, size.bit_length() + 1))
    return zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, window_log=max(22, bits), chain_log=bits, hash_log=bits - 1, search_log=12,
        min_match=6, strategy=zstandard.STRATEGY_BTLAZY2,
    )


WHOLE = 13  # bytes of a window that is one match, at most
MOST = 4  # windows beyond the threshold; as many or more count alike
NEW = 0.08  # share of a window that the ordinary dictionary must leave for the toxic one to learn it
LEAST = 0.1  # share of a window that counts as the most that could be saved, at least
FAR_MORE = 50  # a window of an ordinary text is the toxic dictionary's only if so many times as many toxic texts hold it


class _Wide(dict):
    def __missing__(self, c: str) -> bytes:
        out = self[c] = (ord(c) * 0x9E3779B1 & 0xFFFFFFFF).to_bytes(4, "little")
        return out


_wide = _Wide()


def widened(text: str) -> bytes:
    return b"".join(map(_wide.__getitem__, text))


def window_counts(text: str | None) -> Counter:
    """The windows of a text with how often each occurs."""
    out: Counter = Counter()
    for word in WORD.findall((text or "").lower()):
        if len(word) <= LONG:
            out[word] += 1
        else:
            out.update(word[i : i + PIECE] for i in range(0, len(word) - PIECE + 1))
    return out


def dictionary(words: dict[str, int], size: int) -> str:
    """The content of a zstandard dictionary of all windows (word to weight, the strongest first): what zstd trains to
    `size`, or less, at the end, and before it the windows that the trainer left out, the weakest first."""
    samples = [f" {w} ".encode() for w, n in words.items() for _ in range(min(n, 40))]
    plain = "".join(f" {w} " for w in reversed(words))
    try:
        trained = zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 4)), samples, k=32, d=6).as_bytes()
    except zstandard.ZstdError:
        return plain
    content = trained.decode("utf-8", "ignore")
    kept = "".join(f" {w} " for w in reversed(words) if f" {w} " not in content)
    return kept + content  # what comes last is nearest, and cheapest to refer to


@dataclass
class Model:
    toxic: str = ""
    ordinary: str = ""
    threshold: float = 1.0
    posterior: tuple[float, ...] = (0.0,) * (MOST + 1)
    _made: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_made"} | {"_made": {}}

    def _left(self, which: str, wide: bytes) -> int:
        """Bytes of a window that a dictionary leaves: its length beyond that of a window which the dictionary holds whole,
        at its far end."""
        if which not in self._made:
            content = getattr(self, which)
            held = widened(content) or b"\0" * 8
            made = search(len(held))
            d = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=made)
            press = zstandard.ZstdCompressor(dict_data=d, compression_params=made)
            first = content.split(maxsplit=1)[:1]
            self._made[which] = press, min(WHOLE, len(press.compress(widened(f" {first[0]} ")))) if first else WHOLE
        press, whole = self._made[which]
        return max(0, len(press.compress(wide)) - whole)

    def distance(self, word: str, memo: int = 300_000) -> float:
        known = self._made.setdefault("memo", {})
        d = known.get(word)
        if d is None:
            if len(known) >= memo:
                known.clear()
            w = widened(f" {word} ")
            plain, bad = self._left("ordinary", w), self._left("toxic", w)
            d = known[word] = min(1.0, (plain - bad) / max(1, plain, LEAST * len(w)))
        return d

    def is_new(self, word: str) -> bool:
        """Whether the ordinary dictionary leaves much of a window."""
        w = widened(f" {word} ")
        return self._left("ordinary", w) >= NEW * len(w)

    def distances(self, text: str | None) -> list[tuple[float, int]]:
        return [(self.distance(w), n) for w, n in window_counts(text).items()]

    def score(self, text: str | None) -> float:
        beyond, most = 0, 0.0
        for d, n in self.distances(text):
            most = max(most, d)
            if d >= self.threshold:
                beyond += n
        p = self.posterior[min(beyond, MOST)]
        return p if beyond else p * (0.5 + 0.5 * min(1.0, most))


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic) of at most `sample` labelled documents a class, copies once, with the higher of their labels."""
    rows = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    pick = [rows.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    ids = pick[0].union(pick[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    return texts.join(F.broadcast(ids), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))


def learned(docs: DataFrame, labels: DataFrame, sample: int = 4000, least: int = 5) -> Model:
    """Dictionaries, threshold and posterior. `least`: toxic texts that hold a window of the toxic dictionary, at least."""
    rows = scratch(sampled(docs, labels, sample), "toxic-sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"]):
                seen[toxic].update(window_counts(text).keys())
        yield pd.DataFrame([(w, seen[1][w], seen[0][w]) for w in seen[0].keys() | seen[1].keys()], columns=["word", "bad", "good"])

    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model()
    seen = rows.mapInPandas(count, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    kept = seen.where(f"bad >= {least} or good >= 3").orderBy("word").collect()  # windows of at most 2 x `sample` texts
    usual = [r for r in kept if r["good"] >= 3 or 0 < r["good"] and r["bad"] < FAR_MORE * r["good"]]
    plain = Model(ordinary=dictionary({r["word"]: r["good"] for r in sorted(usual, key=lambda r: (-r["good"], r["word"]))}, 48 * 1024))
    chosen = {r["word"]: r["bad"] for r in sorted(kept, key=lambda r: (-r["bad"], r["word"])) if r["bad"] >= least and plain.is_new(r["word"])}
    model = Model(dictionary(chosen, 8192), plain.ordinary)

    def judge(model: Model) -> pd.DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for text, toxic in zip(b["text"], b["toxic"]):
                    found = model.distances(text)
                    out.append([toxic, *(sum(n for d, n in found if d >= t) for t in GRID)])
                yield pd.DataFrame(out, columns=["toxic", *(f"t{i}" for i in range(len(GRID)))]).astype("int64")

        return rows.mapInPandas(run, "toxic long, " + ", ".join(f"t{i} long" for i in range(len(GRID)))).toPandas()

    def false_alarms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = Counter(w for text in b["text"] for w in window_counts(text) if model.distance(w) >= GRID[0])
            yield pd.DataFrame(list(seen.items()), columns=["word", "n"])

    alarms = rows.where("toxic = 0").mapInPandas(false_alarms, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    worst = [r["word"] for r in alarms.where("n >= 3").orderBy("n", "word").collect()]  # windows of at most `sample` texts
    model = Model(model.toxic, model.ordinary + "".join(f" {w} " for w in worst))
    found = judge(model)
    discard(rows)
    bad_rows = found["toxic"] == 1

    def f1(i: int, least: int) -> float:
        hit = found[f"t{i}"] >= least
        return 2 * (hit & bad_rows).sum() / max(1, hit.sum() + bad_rows.sum())

    best = max(range(len(GRID)), key=lambda i: (round(max(f1(i, c) for c in range(1, MOST + 1)), 3), -abs(i - len(GRID) // 2)))
    hits, last, post = found[f"t{best}"].clip(upper=MOST), 0.0, []
    for c in range(MOST + 1):
        own = hits == c
        last = max(last, float(((own & bad_rows).sum() + 0.5) / (own.sum() + 1.5)))  # what no learning text has counts as ordinary
        post.append(last)
    return Model(model.toxic, model.ordinary, GRID[best], tuple(post))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = mapped(rows, "text", ["doc_id"], "score double", lambda texts: [[shared.value.score(t) for t in texts]])
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = scored(docs, learned(docs, labels, sample))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
