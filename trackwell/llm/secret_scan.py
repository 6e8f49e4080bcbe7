"""Secret scans: three base patterns and a battery of randomness tests with false-discovery control.

Base kinds: `assign`, `access`, `hex` (fixed patterns below). The battery looks at other unbroken runs of encoding
characters that hold a digit and a letter. The encoding is the smallest alphabet that has all of a run's characters
(hex, base32 and base36 in either case, base62, base64), and three tests of uniform, independent symbols are made:
chi-squared over the alphabet (neighbouring symbols in classes that expect three or more, eight classes at least), runs
about the middle of the alphabet, and serial correlation at lag one. The smallest of the three p-values, times three,
says how well a run passes for random.

What is reported is controlled, not what is passed over: a report is false if the run is an ordinary one (a name, a
path, a numbered word). How random ordinary runs look is learned from the corpus: each document gives one for each band
of length, its own words from a place set by its checksum, joined as names and paths are, with a number. A run's
p-value is the share of ordinary runs of its band that look at least as random, and Benjamini-Hochberg reports the runs
of a band of which at most `rate` are expected to be ordinary, if they pass the battery (at 3 in 100) at all. So short runs, whose tests have less power, need better
evidence, and a band without random runs reports nothing. What is reported is kind `random`.

Both kinds of runs are gathered as histograms (bands times 1,000 bins), so what reaches the driver has a fixed size.
Null texts count as empty: no spans. Very long texts are scanned whole. Repeated rows are scanned like others. An empty
table gives no rows; other columns are ignored, and redacted() passes them on, whatever their names."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwell.llm.common import mapped, scratch

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

WORDS = re.compile(r"[A-Za-z0-9]+")
JOINS = ("-", "_", "/", "")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
BANDS = (32, 48, 80)  # lengths under 32, under 48, under 80, the rest
BINS, PER_BIN = 1000, 0.02  # bins of -log10(p)
PASSES = 76  # the last bin in which a run still passes for random: 3 in 100 random ones don't

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
# Alphabets, smallest first; - and _ are the last two of base64 as well.
ALPHABETS = [{c: i for i, c in enumerate(x)} for x in (
    "0123456789abcdef", "0123456789ABCDEF", _UPPER + "234567", _LOWER + "234567",
    _UPPER + _DIGITS, _LOWER + _DIGITS, _UPPER + _LOWER + _DIGITS, _UPPER + _LOWER + _DIGITS + "+/",
)]
ALPHABETS[-1] |= {"-": 62, "_": 63}


def chi_squared_tail(x: float, dof: int) -> float:
    """P(chi-squared > x), by the cube-root normal approximation."""
    if x <= 0:
        return 1.0
    z = ((x / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof))
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(run: str) -> float:
    """The battery's p-value of a run of encoding characters: small if it is not like uniform symbols."""
    run = run.rstrip("=")
    used = set(run)
    code = next(x for x in ALPHABETS if used <= x.keys())
    size = max(code.values()) + 1
    v = np.array([code[c] for c in run], float)
    n = len(v)
    classes = min(size, max(8, n // 3))
    seen = np.bincount((v * classes // size).astype(int), minlength=classes)
    expected = np.bincount(np.arange(size) * classes // size, minlength=classes) * (n / size)
    p_chi = chi_squared_tail(float(((seen - expected) ** 2 / expected).sum()), classes - 1)
    high = v * 2 >= size
    a = int(high.sum())
    b = n - a
    if not a or not b:
        p_runs = 0.0
    else:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean, var = 1 + 2 * a * b / n, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        p_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * var)) if var > 0 else 0.0
    d = v - v.mean()
    p_serial = math.erfc(abs(float((d[1:] * d[:-1]).sum() / (d * d).sum()) * n + 1) / math.sqrt(2 * n)) if d.any() else 0.0
    return min(1.0, 3 * min(p_chi, p_runs, p_serial))


_EXPECTED = {(size, k): np.bincount(np.arange(size) * k // size, minlength=64) / size for size in (16, 32, 36, 62, 64) for k in range(8, size + 1)}


def randomness_of(runs: list[str]) -> list[float]:
    """randomness() of many runs at once: sums over all their symbols, parted by run."""
    out = [0.0] * len(runs)
    by_code: dict[int, list[int]] = {}
    plain = [r.rstrip("=") for r in runs]
    for i, r in enumerate(plain):
        used = set(r)
        by_code.setdefault(next(k for k, x in enumerate(ALPHABETS) if used <= x.keys()), []).append(i)
    for k, rows in by_code.items():
        code, size = ALPHABETS[k], max(ALPHABETS[k].values()) + 1
        n = np.array([len(plain[i]) for i in rows])
        v = np.array([code[c] for i in rows for c in plain[i]], np.int64)
        ends = np.cumsum(n)
        starts = ends - n
        of = np.repeat(np.arange(len(rows)), n)
        classes = np.minimum(size, np.maximum(8, n // 3))
        seen = np.bincount(of * 64 + v * classes[of] // size, minlength=64 * len(rows)).reshape(-1, 64)
        expected = np.array([_EXPECTED[size, c] for c in classes.tolist()]) * n[:, None]
        chi = np.divide((seen - expected) ** 2, expected, out=np.zeros(seen.shape), where=expected > 0).sum(1)
        high = v * 2 >= size
        a = np.add.reduceat(high.astype(np.int64), starts)
        inner = np.ones(len(v), bool)
        inner[starts] = False  # a symbol with one before it in its run
        before = np.concatenate([[0], np.arange(len(v) - 1)])
        changes = np.add.reduceat((inner & (high != high[before])).astype(np.int64), starts)
        d = v - (np.add.reduceat(v, starts) / n)[of]
        lag, own = np.add.reduceat(np.where(inner, d * d[before], 0.0), starts), np.add.reduceat(d * d, starts)
        for j, i in enumerate(rows):
            m, x = int(n[j]), int(a[j])
            y = m - x
            var = 2 * x * y * (2 * x * y - m) / (m * m * (m - 1)) if m > 1 else 0
            p_runs = math.erfc(abs(1 + changes[j] - 1 - 2 * x * y / m) / math.sqrt(2 * var)) if x and y and var > 0 else 0.0
            p_serial = math.erfc(abs(lag[j] / own[j] * m + 1) / math.sqrt(2 * m)) if own[j] > 0 else 0.0
            out[i] = min(1.0, 3 * min(chi_squared_tail(float(chi[j]), int(classes[j]) - 1), p_runs, p_serial))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted."""
    spans = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def placed(runs: list[str]) -> list[tuple[int, int]]:
    """(band of length, bin of the battery's p-value) of each run."""
    return [(sum(len(r) >= n for n in BANDS), min(BINS - 1, int(-math.log10(max(p, 1e-300)) / PER_BIN))) for r, p in zip(runs, randomness_of(runs))]


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the runs with a digit and a letter that meet no base span."""
    out = []
    for m in RUN.finditer(text):
        run = m[0]
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and not any(s < m.end() and m.start() < e for s, _, e in spans):
            out.append((m.start(), m.end()))
    return out


def ordinary_runs(text: str) -> list[str]:
    """A run of a text's own words for each band of length: words from a place that the text's checksum sets, joined as
    a name or a path is, up to the band's length, with a number at the end. Long unbroken runs, which may be keys, give
    no words; a text without words gives none."""
    seed = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    rest = RUN.sub(" ", text)
    at, out = seed % (len(rest) + 1), []
    for band, least in enumerate((20, *BANDS)):
        join, words = JOINS[(seed >> 8 * band) % len(JOINS)], []
        for m in itertools.chain(WORDS.finditer(rest, at), WORDS.finditer(rest, 0, at)):  # to the end, then from the start
            words.append(m[0] if join else m[0][:1].upper() + m[0][1:])
            if sum(map(len, words)) + len(join) * (len(words) - 1) >= least:
                break
        run = join.join(words)
        if run:
            out.append((run + join) * max(1, -(-least // len(run))) + str(seed % 1000))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def thresholds(runs: dict[tuple[int, int], int], ordinary: dict[tuple[int, int], int], rate: float) -> list[int]:
    """For each band the largest bin that Benjamini-Hochberg reports (-1: none). Low bins look random."""
    out = []
    for band in range(len(BANDS) + 1):
        found, plain = (np.array([h.get((band, b), 0) for b in range(BINS)], float).cumsum() for h in (runs, ordinary))
        p = (plain + 1) / (plain[-1] + 1)
        good = np.flatnonzero((p * found[-1] <= rate * found) & (found > 0))
        out.append(min(int(good[-1]), PASSES) if len(good) else -1)
    return out


def _found(texts: list[str]) -> list[tuple[list, list, list]]:
    """Base spans, runs (start, end, band, bin) and the places of the ordinary runs of each text."""
    spans = [base_spans(t) for t in texts]
    runs = [candidates(t, s) for t, s in zip(texts, spans)]
    plain = [ordinary_runs(t) for t in texts]
    where = iter(placed([t[s:e] for t, own in zip(texts, runs) for s, e in own] + [r for own in plain for r in own]))
    runs = [[(s, e, *next(where)) for s, e in own] for own in runs]
    return list(zip(spans, runs, [[next(where) for _ in own] for own in plain]))


FOUND = """n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>,
    runs array<struct<start:int,end:int,band:int,bin:int>>, plain array<struct<band:int,bin:int>>"""


def scanned(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, base counts and digest, base spans, its runs and its ordinary runs with their bands and bins."""

    def run(texts: list[str]) -> list[list]:
        rows = []
        for spans, runs, plain in _found(texts):
            n = [sum(k == kind for _, k, _ in spans) for kind in range(3)]
            rows.append((*n, hashlib.sha256(joined(spans).encode()).hexdigest(), [dict(zip(("start", "kind", "end"), s)) for s in spans], [dict(zip(("start", "end", "band", "bin"), r)) for r in runs], [dict(zip(("band", "bin"), p)) for p in plain]))
        return [[r[i] for r in rows] for i in range(7)]

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return mapped(rows, "text", ["doc_id"], FOUND, run)


def fitted_thresholds(found: DataFrame, rate: float) -> list[int]:
    """The bins up to which each band's runs are reported. found: what scanned() gives."""

    def tagged(c: str) -> F.Column:
        return F.transform(c, lambda r: F.struct(F.lit(c).alias("of"), r["band"].alias("band"), r["bin"].alias("bin")))

    each = found.select(F.explode(F.concat(tagged("runs"), tagged("plain"))).alias("r"))
    hist = each.groupBy("r.of", "r.band", "r.bin").count().collect()  # at most 8,000 rows
    return thresholds(*({(r["band"], r["bin"]): r["count"] for r in hist if r["of"] == c} for c in ("runs", "plain")), rate)


def secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans (kind:start:end, by start)."""
    found = scratch(scanned(docs), "secrets")
    most = F.array(*[F.lit(t) for t in fitted_thresholds(found, rate)])
    added = F.transform(F.filter("runs", lambda r: r["bin"] <= F.element_at(most, r["band"] + 1)), lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))
    names = F.array(*[F.lit(k) for k in KINDS])
    every = F.array_sort(F.concat("base", added))
    spans = F.transform(every, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.size(added).cast("long").alias("n_random"), "base_sha256", F.array_join(spans, ",").alias("spans"))


def redacted(docs: DataFrame, rate: float = 0.05, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every found span replaced by mark (overlapping spans by one), n_chars set anew."""
    most = fitted_thresholds(scanned(docs), rate)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        spans = base_spans(text)
        runs = candidates(text, spans)
        cut = sorted([(s, e) for s, _, e in spans] + [(s, e) for (s, e), (band, b) in zip(runs, placed([text[s:e] for s, e in runs])) if b <= most[band]])
        if not cut:
            return text
        out, at = [], 0
        for s, e in cut:
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join([*out, text[at:]])

    others = [c for c in docs.columns if c != "text"]
    out = mapped(docs.withColumn("text", F.col("text").cast("string")), "text", others, "text string", lambda texts: [[clean(t) for t in texts]]).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
