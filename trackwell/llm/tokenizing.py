"""Token counts and ids of whole texts, exactly as a tokenizers file gives them.

Ordinary documents are cut at spaces and line ends, which no token of this vocabulary's pre-tokeniser crosses, and
the pieces go through a bounded memo, so a repeated word is encoded once per worker. Huge documents are encoded in
overlapping chunks with offsets; neighbouring chunks are spliced where both have a token that starts at the same
place right after a space (a proven boundary: the split pattern has no look-behind and normalisation does not reach
across a space), and the overlap widens, up to the rest of the text, when they don't agree.

The vocabulary path is a parameter. Null texts count as empty: no tokens. Repeated rows are counted like others, null ids
stay; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwell.llm.common import mapped

# The vocabulary's split pattern; Latin-1 letters with ASCII marks (no apostrophe) after them.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_SPACES = " \t\n\r"
_OTHER_SPACES = str.maketrans({c: " " for c in _SPACES})
_loaded: dict = {}


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """A vocabulary file with a memo of the ids of space-free pieces, in two generations of at most `memo` pieces."""

    def __init__(self, path: str, memo: int = 300_000, chunk: int = 32_768, overlap: int = 512):
        from tokenizers import Tokenizer

        self.tok, self.memo, self.chunk, self.overlap = Tokenizer.from_file(path), memo, chunk, overlap
        self.ids, self.old = {"": b""}, {}
        self.tok.no_truncation()
        self.tok.no_padding()
        self.stems, self.bare = {}, self._bare()
        self.mark = next(((i, t.content) for i, t in self.tok.get_added_tokens_decoder().items() if t.special), None)

    def _bare(self):
        """The vocabulary's model alone, for words of Latin letters, where normalising is lower-casing and the split
        pattern takes the letters whole; None for files that normalise or split otherwise."""
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(self.tok.to_str())
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        pattern = split[0].get("pattern", {}).get("Regex", "")
        if normal != ["NFC", "Replace", "Lowercase"] or pattern != SPLIT or [x.get("type") for x in split] != ["Split", "ByteLevel"] or len(self.tok.encode(",", add_special_tokens=False).ids) != 1:
            return None
        bare = Tokenizer(self.tok.model)
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return bare

    def _encode_groups(self, tok, words: list[str], by: str, mark: int) -> Iterator[tuple[str, bytes]]:
        """Each word's ids; words go many to a call, parted by `by`, a word that is the one token `mark`."""
        for i in range(0, len(words), 12_800):
            part = [words[j : j + 128] for j in range(i, min(len(words), i + 12_800), 128)]
            for own, e in zip(part, tok.encode_batch_fast([by.join(w) for w in part], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                raw, at = ids.tobytes(), 0
                for w, end in zip(own, [*np.flatnonzero(ids == mark).tolist(), len(ids)]):
                    yield w, raw[4 * at : 4 * end]
                    at = end + 1

    def _one(self, piece: str) -> bytes:
        return np.array(self.tok.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: set[str]) -> None:
        """Take pieces into the memo. They are encoded many to a call, parted by a special token."""
        if len(self.ids) + len(pieces) > self.memo:
            self.old, self.ids = self.ids, {"": b""}
        known = pieces & self.old.keys()
        self.ids.update(zip(known, map(self.old.__getitem__, known)))
        rest = pieces - known
        if self.bare:
            words = [p for p in rest if p.isascii() and p.isalpha()]
            rest.difference_update(words)
            parts = {p: (m[1].lower(), m[2]) for p in rest if (m := LATIN.fullmatch(p))}
            rest.difference_update(parts)
            low = list(map(str.lower, words))
            if len(self.stems) > self.memo:
                self.stems = {}
            unknown = list({stem for stem, _ in parts.values()}.union(low).difference(self.stems))
            self.stems.update(self._encode_groups(self.bare, unknown, " , ", self.tok.encode(",", add_special_tokens=False).ids[0]))
            self.ids.update(zip(words, map(self.stems.__getitem__, low)))
            for p, (stem, tail) in parts.items():
                if tail and tail not in self.ids:
                    self.ids[tail] = self._one(tail)
                self.ids[p] = self.stems[stem] + self.ids[tail]
        plain = [p for p in rest if self.mark and self.mark[1] not in p]
        if plain:
            self.ids.update(self._encode_groups(self.tok, plain, f" {self.mark[1]} ", self.mark[0]))
        for p in rest.difference(plain):
            self.ids[p] = self._one(p)

    def encode_many(self, texts: list[str | None], splice: bool = True, group: int = 256) -> Iterator[bytes]:
        """The ids of each text, as little-endian 32-bit numbers. Spaces and line ends part a text into pieces; with
        splice, texts over a chunk are encoded in overlapping chunks instead."""
        for i in range(0, len(texts), group):
            part = [t or "" for t in texts[i : i + group]]
            cut = [None if splice and len(t) > self.chunk else t.translate(_OTHER_SPACES).split(" ") if "\t" in t or "\r" in t else t.replace("\n", " ").split(" ") for t in part]
            found = [c and list(map(self.ids.get, c)) for c in cut]
            gaps = [[k for k, x in enumerate(f) if x is None] if f else [] for f in found]
            unknown = {c[k] for c, own in zip(cut, gaps) for k in own}
            if unknown:
                self._learn(unknown)  # what a new generation leaves behind is in `found` already
            for t, c, f, own in zip(part, cut, found, gaps):
                for k in own:
                    f[k] = self.ids[c[k]]
                yield b"".join(x.tobytes() for x in self.spliced(t)) if c is None else b"".join(f)

    def spliced(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a huge text, chunk by chunk, spliced where neighbouring encodings agree."""
        start, n = 0, len(text)
        while start < n:
            end, overlap = min(n, start + self.chunk), self.overlap
            left = self.tok.encode(text[start:end], add_special_tokens=False)
            while end < n:
                at = self._common(text, start, end, left, overlap)
                if at is not None:
                    break
                if overlap < end - start:
                    overlap = min(end - start, overlap * 4)  # look for a boundary farther to the left
                else:
                    end = min(n, end + (end - start))  # none in the whole chunk: widen it to the right
                    left = self.tok.encode(text[start:end], add_special_tokens=False)
                    overlap = self.overlap
            if end >= n:
                yield np.array(left.ids, "<u4")
                return
            yield np.array([i for i, (a, _) in zip(left.ids, left.offsets) if start + a < at], "<u4")
            start = at

    def _common(self, text: str, start: int, end: int, left, overlap: int) -> int | None:
        """The last offset in the overlap where the left chunk and a chunk from there both start a token after a space."""
        low = max(start + 1, end - overlap)
        right = self.tok.encode(text[low:end], add_special_tokens=False)
        ours = {start + a for a, _ in left.offsets if start + a >= low}
        theirs = {low + a for a, _ in right.offsets}
        for at in sorted(ours & theirs, reverse=True):
            if text[at - 1] in _SPACES and self._agree(left, right, start, low, at):
                return at
        return None

    @staticmethod
    def _agree(left, right, start: int, low: int, at: int) -> bool:
        mine = [i for i, (a, _) in zip(left.ids, left.offsets) if start + a >= at]
        return mine == [i for i, (a, _) in zip(right.ids, right.offsets) if low + a >= at]


def encoder(path: str, memo: int = 300_000) -> Encoder:
    """One per worker process and size of memo."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    if (path, memo) not in _loaded:
        _loaded[path, memo] = Encoder(path, memo)
    return _loaded[path, memo]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens) of every whole text."""
    path = path or default_path()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = mapped(rows, "text", ["doc_id", "n_bytes"], "n_tokens long", lambda texts: [[len(i) // 4 for i in encoder(path).encode_many(texts)]], group=2048)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
