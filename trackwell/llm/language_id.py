"""Language identification by multilingual mixture inference.

Letter trigrams (lower case, anything else as a gap), hashed to a fixed number of bins, are counted per language
over all learning documents. A document is a mixture of languages: expectation-maximisation estimates the
proportions from the trigram likelihoods. The set of languages starts with the likeliest one and grows by the
language with the steepest gain while the log-likelihood gained exceeds a penalty (BIC for one more proportion;
overlapping trigrams count a third each). The prediction is the language with the largest proportion.

A uniform background over all bins competes with the document's mixture: the share of trigrams that it explains
better tells letters that are in no learned language at all.

The model that is broadcast has bins x languages numbers, for at most `most` languages (more are an error: a column of
languages with so many values isn't one). Null texts, empty ones and texts without a letter give `und` with score 0;
without any learning document everything does. Ties go to the language first in order. Texts of any length count
whole; repeated rows are learned from as often as they occur and all get the same prediction. An empty table gives no
rows; other columns are passed on by predicted(), whatever their names, and ignored otherwise."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwell.llm.common import mapped

BINS = 1 << 15
COUPLING = 3.0  # a letter is in three trigrams
_alpha = None


def _letters() -> np.ndarray:
    global _alpha
    if _alpha is None:
        _alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _alpha


def trigram_bins(text: str | None) -> np.ndarray:
    """The bin of each trigram that has a letter in the middle; none if the text has no letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(c):
        return np.empty(0, np.int64)
    c = np.concatenate([[0], np.where(_letters()[c], c, 0), [0]]).astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77) + c[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(49)).astype(np.int64)[c[1:-1] > 0]


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def counts(docs: DataFrame) -> DataFrame:
    """(lang, bin, n) over all rows with a language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                total.setdefault(lang, np.zeros(BINS, np.int64))
                total[lang] += np.bincount(trigram_bins(text), minlength=BINS)
        for lang, n in total.items():
            k = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bin": k.astype("int32"), "n": n[k]})

    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    return rows.mapInPandas(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def learned(docs: DataFrame, smoothing: float = 0.5, most: int = 200) -> tuple[list[str], np.ndarray]:
    """The languages in order and the probability of each bin under each (bins x languages)."""
    named = docs.where("lang is not null and text is not null").select("lang").distinct().limit(most + 1).count()
    if named > most:
        raise ValueError(f"more than {most} languages to learn")
    seen = counts(docs).toPandas()  # at most bins x languages rows
    langs = sorted(seen["lang"].unique())
    p = np.full((BINS, len(langs)), smoothing)
    for j, lang in enumerate(langs):
        own = seen[seen["lang"] == lang]
        p[own["bin"].to_numpy(), j] += own["n"].to_numpy()
    return langs, p / p.sum(0) if langs else p


def mixture(p: np.ndarray, n: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation and the log-likelihood. p: bins x languages, n: counts."""
    share, total = np.full(p.shape[1], 1 / p.shape[1]), n.sum()
    for _ in range(rounds):
        part = p * share
        part *= (n / part.sum(1))[:, None]
        new = part.sum(0) / total
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(n @ np.log(p @ share))


def languages(bins: np.ndarray, p: np.ndarray) -> tuple[list[int], np.ndarray, float]:
    """The selected languages, their proportions, and how far the first leads as a single language (0 to 1)."""
    k, n = np.unique(bins, return_counts=True)
    q, n = p[k], n.astype(float)
    total = n.sum()
    single = n @ np.log(q)
    first = int(single.argmax())
    lead = 1 / float(np.exp(np.minimum(0, (single - single[first]) / COUPLING)).sum())
    chosen, share, best = [first], np.ones(1), float(single[first])
    penalty = COUPLING * 0.5 * math.log(max(total, 2))
    while len(chosen) < p.shape[1]:
        gain = (n / (q[:, chosen] @ share)) @ q - total  # bounds what a language can add
        gain[chosen] = -1
        new = int(gain.argmax())
        if gain[new] <= penalty:
            break
        wider = [*chosen, new]
        trial, value = mixture(q[:, wider], n)
        if value - best <= penalty:
            break
        chosen, share, best = wider, trial, value
    return chosen, share, lead


def predicted(docs: DataFrame, langs: list[str], p: np.ndarray) -> DataFrame:
    """docs with lang_pred, score, lang_mix (language to proportion) and background (the share of trigrams that a
    uniform background explains better) added; columns of those names are replaced, all others stay as they are."""
    model = docs.sparkSession.sparkContext.broadcast(p)

    def one(text: str | None) -> tuple[str, float, str, float]:
        bins = trigram_bins(text)
        if not len(bins) or not langs:
            return "und", 0.0, "", 1.0
        chosen, share, lead = languages(bins, model.value)
        top = int(np.lexsort((chosen, -share))[0])
        mix = ",".join(f"{langs[chosen[i]]}:{share[i]:.3f}" for i in np.argsort(-share, kind="stable"))
        strange = float((model.value[bins][:, chosen] @ share < 1 / BINS).mean())
        return langs[chosen[top]], float(min(1.0, share[top]) * (lead if len(chosen) == 1 else 1.0)), mix, strange

    added = "lang_pred string, score double, lang_mix string, background double"
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "lang_mix", "background")]
    return mapped(docs, "text", kept, added, lambda texts: list(zip(*map(one, texts))))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, lang_mix of every document; learnt from rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    langs, p = learned(docs.where(~F.coalesce(held_out(), F.lit(False))))
    return predicted(rows, langs, p).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "lang_mix", "background")
