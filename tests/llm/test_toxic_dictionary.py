"""The dictionary holds what zstd trained and every selected window, however many there are."""

from __future__ import annotations

import random
import zlib

import zstandard

from trackwell.llm import toxicity


def test_trained_content_and_all_windows_stay():
    rng = random.Random(3)
    words = {"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(4, 11))): 2000 // (i + 1) + 3 for i in range(3000)}
    samples = [f" {w} ".encode() for w, n in words.items() for _ in range(min(n, 40))]
    content = zstandard.train_dictionary(4096, samples, k=32, d=6).as_bytes().decode("utf-8", "ignore")
    made = toxicity.dictionary(words, 4096)
    assert made.endswith(content)
    assert all(f" {w} " in made for w in words)


def test_a_term_of_few_toxic_texts_is_learned(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(4, 9))) for _ in range(300)]
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5][:1200]  # none is held out
    texts = [" ".join(rng.choices(words, k=30) + ["vilebadword"] * (k < 600) + ["rareslurword"] * (k < 8)) for k in range(1200)]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k < 600)) for k, i in enumerate(ids)], "doc_id long, toxic int")
    model = toxicity.learned(docs, labels)
    assert " vilebadword " in model.toxic
    assert " rareslurword " in model.toxic
    assert model.distance("rareslurword") >= model.threshold


def test_all_of_a_large_dictionary_is_searched():
    """The ordinary dictionary of a large vocabulary is beyond the usual search tables; what it holds isn't new, nor toxic."""
    digits = lambda i: "".join("bdfgklmnprstvz"[i // 14**k % 14] + "aeiou"[(i * 7 + k) % 5] for k in range(5))
    words = [digits(i * 7919 + 11) for i in range(60_000)]
    model = toxicity.Model(toxic=" grumpf  zworx ", ordinary="".join(f" {w} " for w in words))
    some = words[::100]
    assert not any(model.is_new(w) for w in some) and max(map(model.distance, some)) < toxicity.GRID[0]
    assert model.is_new("grumpf") and min(model.distance("grumpf"), model.distance("zworx")) > 0.9
