"""Secrets: fixed grammars, and a battery of randomness tests for tokens that no grammar names.

A candidate is a long run of encoding characters, padding behind it included. A run that no single alphabet holds gives its
parts between the characters that don't fit, by either base64 alphabet. Its encoding is inferred from its characters (hex,
base32, base36, base62, base64), and under "uniform over that alphabet" three tests give p-values: a chi-squared test of
uniformity (symbols binned so that each bin expects at least two), a Wald-Wolfowitz runs test about the middle of the alphabet,
and lag-one serial correlation. A token that any test rejects at ``REJECT`` isn't random.

Against it stands the null "ordinary text": each character follows from the one before it, by the corpus's own counts of
neighbours in short runs, mixed with a share that knows classes (digit, lower, upper, sign) alone (the larger, the fewer were
counted). What uniform symbols of the
inferred encoding gain over that is a log likelihood ratio, whose exponential has a mean of at most 1 under the null; so
1 / ratio, times the number of encodings that were looked at, is a p-value for any length and any ordinary text.

These p-values, each divided by its token's length over the mean length, go through one Benjamini-Hochberg step-up over all
candidates of the corpus at level ``FDR``. Evidence is rounded down to steps of 1 / ``STEPS``, so the corpus is counted by length
and steps; the step-up's cut is the fixed point of t = FDR * (p-values up to t) / (all), met from above, and a round of that is
one sum over the counts. Only the neighbours' counts, the cut and the mean length come to the driver.

Defined cases: a null or empty text has no spans; repeated rows are each scanned, and each counts in the step-up; equal
p-values are taken or left together; very long texts and tokens are tested whole; a corpus without candidates takes none; an
empty table gives an empty result; columns other than the key and the text are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import slices, text_bytes, word_spans
from .scratch import Tables, small_batches

KINDS = ["assign", "access", "hex", "random"]
_CUE = re.compile(r"(?i:password|passwd|secret|token|api_?key)", re.ASCII)
_ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = 20
#: '=' belongs to a candidate only as padding behind it: NAME=value is two.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{14,}(?:={1,6}(?![A-Za-z0-9+/_=-]))?")
#: What a candidate with signs of both base64 alphabets is split at: the signs of one, those of the other.
_PARTS = [re.compile(r"[A-Za-z0-9_-]+=*"), re.compile(r"[A-Za-z0-9+/]+=*")]

#: Alphabets of the encodings, smallest first.
ENCODINGS = [
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
_INDEX = [(n, {c: i for i, c in enumerate(a)}) for n, a in ENCODINGS]
#: Characters of any encoding, and the code of each byte among them (-1: none).
CHARACTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_"
CODE = np.full(256, -1, np.int64)
CODE[np.frombuffer(CHARACTERS.encode(), np.uint8)] = np.arange(len(CHARACTERS))
#: Of ordinary tokens, words in capitals, names in mixed case and numbers behind names included: the chance of each class after
#: each class, in the order digit, upper, lower, sign.
CLASSES = np.array([[0.74, 0.06, 0.10, 0.10], [0.04, 0.42, 0.50, 0.04], [0.02, 0.06, 0.88, 0.04], [0.20, 0.15, 0.60, 0.05]])
#: The share of the null that knows classes alone, at last.
CLASS_SHARE = 0.3
#: As many neighbours of a character must have been counted for their shares to weigh half of what they weigh at last.
SEEN = 100
REJECT = 0.001
FDR = 0.001
#: Steps of evidence in a unit of the logarithm.
STEPS = 64
#: Pairs of length and evidence that a task holds before it passes their counts on.
HELD = 200_000


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared by the Wilson-Hilferty cube root."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token: str) -> tuple[str, float, float, float] | None:
    """Inferred encoding and the three p-values; None where no encoding has all characters."""
    body = token.rstrip("=")
    known = next(((n, ix) for n, ix in _INDEX if all(c in ix for c in body)), None)
    if known is None or len(body) < 8:
        return None
    name, ix = known
    x, size, n = [ix[c] for c in body], len(ix), len(body)
    bins = max(2, min(size, n // 2))
    got = Counter(v * bins // size for v in x)
    width = Counter(v * bins // size for v in range(size))
    chi = sum((got[b] - n * width[b] / size) ** 2 / (n * width[b] / size) for b in range(bins))
    up = [v >= size / 2 for v in x]
    a = sum(up)
    b = n - a
    if a and b:
        runs = 1 + sum(p != q for p, q in zip(up, up[1:]))
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 0.0
    m = sum(x) / n
    v0 = sum((v - m) ** 2 for v in x)
    r = sum((p - m) * (q - m) for p, q in zip(x, x[1:])) / v0 if v0 else 1.0
    return name, chi2_tail(chi, bins - 1), p_runs, two_sided(r * math.sqrt(n))


def by_class() -> np.ndarray:
    """Chance of each character after each other one, by class changes alone."""
    kinds = np.array([0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in CHARACTERS])
    return CLASSES[kinds][:, kinds] / np.bincount(kinds)[kinds]


class Ordinary:
    """The null: the logarithm of each character's chance after the one before it."""

    def __init__(self, counts: np.ndarray | None = None):
        """``counts``: how often each character follows each other one; without, classes alone are known."""
        q = by_class()
        if counts is not None and counts.sum():
            n = counts.sum(axis=1, keepdims=True)
            known = (1 - CLASS_SHARE) * n / (n + SEEN)
            q = known * counts / np.maximum(n, 1) + (1 - known) * q
        self.log = np.log(q)

    def evidence(self, token: str) -> int:
        """Steps of evidence against the null: ``STEPS`` times -log of the p-value, rounded down."""
        body = token.rstrip("=")
        size = next((len(ix) for _, ix in _INDEX if all(c in ix for c in body)), 0)
        if not size:
            return 0
        x = CODE[np.frombuffer(body.encode(), np.uint8)]
        ratio = -float(self.log[x[:-1], x[1:]].sum()) - (len(x) - 1) * math.log(size)
        return max(0, math.floor(STEPS * (ratio - math.log(len(ENCODINGS)))))


def ordinary_text(docs: DataFrame, text: str = "text") -> Ordinary:
    """The null of a corpus: counts of neighbours in runs of encoding characters too short to be candidates."""
    outside = CODE < 0
    size = len(CHARACTERS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size * size, np.int64)
        for b in batches:
            for part in slices(b, b.schema.names[0]):
                raw, at = text_bytes(part.column(0))
                s, e, _ = word_spans(raw, at, outside)
                short = np.zeros(len(raw) + 1, np.int64)
                few = e - s < LEAST
                short[s[few] + 1] += 1  # from a run's second character on
                short[e[few]] -= 1
                second = np.flatnonzero(np.cumsum(short[:-1]) > 0)
                n += np.bincount(CODE[raw[second - 1]] * size + CODE[raw[second]], minlength=size * size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(n)], ["pair", "n"])

    small_batches(docs.sparkSession)
    sums = docs.select(text).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size * size)
    for r in sums:
        counts[r.pair] = r.n
    return Ordinary(counts.reshape(size, size))


@dataclass(frozen=True)
class Cut:
    """The step-up's result: p-values up to ``p`` pass, after their division by length over ``mean``."""

    p: float
    mean: float
    ordinary: Ordinary = field(default_factory=Ordinary, compare=False)

    def passes(self, size: int, steps: int) -> bool:
        return weighted_p(size, steps, self.mean) <= self.p


def weighted_p(size: int, steps: int, mean: float) -> float:
    return min(1.0, math.exp(-steps / STEPS) * mean / size)


def candidates(t: str) -> list[tuple[int, int]]:
    """Spans to test; parts of one run by the two alphabets may overlap."""
    found: list[tuple[int, int]] = []
    for m in _CANDIDATE.finditer(t):
        if m.end() - m.start() < LEAST:
            continue
        c = m[0]
        if ("+" in c or "/" in c) and ("-" in c or "_" in c):
            found += sorted({(m.start() + x.start(), m.start() + x.end()) for p in _PARTS for x in p.finditer(c) if x.end() - x.start() >= LEAST})
        else:
            found.append((m.start(), m.end()))
    return found


def joined(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def step_up(counts: DataFrame, ordinary: Ordinary, fdr: float = FDR) -> Cut:
    """The cut of the step-up over rows (size, seen, n): ``n`` candidates of that length with so much evidence."""
    total, chars = counts.agg(F.sum("n"), F.sum(F.col("n") * F.col("size"))).first()
    if not total:
        return Cut(0.0, 1.0, ordinary)
    mean = chars / total

    @F.arrow_udf("double")
    def p_of(size: pa.Array, seen: pa.Array) -> pa.Array:
        return pa.array([weighted_p(a, b, mean) for a, b in zip(size.to_pylist(), seen.to_pylist())], pa.float64())

    with Tables(counts.sparkSession, "secrets") as tables:
        by_p = tables.put(counts.select(p_of("size", "seen").alias("p"), "n"), "p-values")
        cut = fdr
        while True:
            below = by_p.where(F.col("p") <= cut).agg(F.sum("n")).first()[0] or 0
            if fdr * below / total >= cut:
                return Cut(cut, mean, ordinary)
            cut = fdr * below / total
            if not below:
                return Cut(0.0, mean, ordinary)


def corpus_cut(docs: DataFrame, text: str = "text") -> Cut:
    """The cut of the step-up over all candidates of all texts. Tasks count by length and evidence before anything moves."""
    ordinary = ordinary_text(docs, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[int, int]] = Counter()

        def out() -> pa.RecordBatch:
            rows = [(a, b, n) for (a, b), n in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)], ["size", "seen", "n"])

        for b in batches:
            for v in b.column(0):
                t = v.as_py() or ""
                held.update((e - s, ordinary.evidence(t[s:e])) for s, e in candidates(t))
            if len(held) > HELD:
                yield out()
        yield out()

    small_batches(docs.sparkSession)
    with Tables(docs.sparkSession, "secrets") as tables:
        return step_up(tables.put(docs.select(F.col(text)).mapInArrow(count, "size long, seen long, n long").groupBy("size", "seen").agg(F.sum("n").alias("n")), "candidates"), ordinary)


def random_tokens(t: str, cut: Cut) -> list[tuple[int, int]]:
    """Spans of tokens that pass the step-up and the battery."""
    return joined([(s, e) for s, e in candidates(t) if cut.passes(e - s, cut.ordinary.evidence(t[s:e])) and (b := battery(t[s:e])) and min(b[1:]) >= REJECT])


def base_spans(t: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(t) if len(m[2]) >= 12] if _CUE.search(t) else []
    if "AKIA" in t:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(t) if m.end() - m.start() >= 18]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(t)]


def find(t: str, cut: Cut) -> list[tuple[str, int, int]]:
    """All spans (code points), by start, then kind as listed. A random token that meets a fixed span isn't told again."""
    base = base_spans(t)
    taken = joined([(s, e) for _, s, e in base])
    ends = [e for _, e in taken]
    more = []
    for s, e in random_tokens(t, cut):
        k = bisect_right(ends, s)  # the first fixed part that ends behind the token's start
        if k == len(taken) or taken[k][0] >= e:
            more.append(("random", s, e))
    return sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0])))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: counts, a digest of the fixed grammars' spans, and all spans."""
    cut = corpus_cut(docs, text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                found = find(t.as_py() or "", cut)
                base = ",".join(f"{a}:{s}:{e}" for a, s, e in found if a != "random")
                n = [sum(f[0] == kind for f in found) for kind in KINDS]
                rows.append((k, *n[:3], hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{a}:{s}:{e}" for a, s, e in found), n[3]))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(key), F.col(text)).mapInArrow(scan, SCHEMA)


def redact(t: str, cut: Cut) -> str:
    """The text with ``[secret]`` in place of each span, overlapping ones together."""
    out, done = [], 0
    for _, s, e in find(t, cut):
        if s >= done:
            out += [t[done:s], "[secret]"]
        done = max(done, e)
    return "".join([*out, t[done:]])


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with secrets replaced in ``text``; null stays null and every document is kept."""
    cut = corpus_cut(docs, text)

    @F.arrow_udf("string")
    def swap(x: pa.Array) -> pa.Array:
        return pa.array((None if (t := v.as_py()) is None else redact(t, cut) for v in x), pa.string())

    return docs.withColumn(text, swap(F.col(text)))
