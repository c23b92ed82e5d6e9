"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes and identifier cues. Small
parsers then grow each anchor to its bounds and validate it. Four kinds follow fixed grammars (email, ip, card, phone):
each kind is read left to right without overlaps, and a candidate that fails its check is dropped without a retry. Two
kinds are added by the method: ``url`` (a scheme whose authority carries user information) and ``account`` (an
identifier after a cue; one after an IBAN cue must pass the mod-97 check).

Defined cases: a null or empty text has no spans; very long texts are scanned whole; of equal starts the longer span stays in
:func:`redact`, and spans of different kinds may overlap; repeated rows are each scanned; an empty table gives an empty result;
columns other than the key and the text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches

KINDS = ["email", "ip", "card", "phone", "url", "account"]
BASE_KINDS = KINDS[:4]
#: Fixed words before an identifier.
CUES = ["iban", "account", "acct", "konto", "compte", "cuenta", "passport", "ssn"]
SCHEMES = ["http://", "https://", "ftp://", "ssh://"]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
DIGIT = frozenset("0123456789")
PHONE = frozenset(" ().0123456789-")
_AFTER_CUE = re.compile(r"(?i)(?:[ \t]*(?:number|no\.?|nr\.?|#|:|=|is))*[ \t]*([A-Za-z0-9][A-Za-z0-9-]{5,33})")
_IBAN = re.compile(r"[ \t:#=]*([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30})(?![A-Za-z0-9])")
_USERINFO = re.compile(r"[^\s/@?#<>\"']+@[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s<>\"']*)?")

_automaton = None


def automaton():
    """The anchors' automaton; built once per worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for c in "0123456789":
            _automaton.add_word(c, ("digit", 1))
        _automaton.add_word("@", ("at", 1))
        _automaton.add_word("+", ("plus", 1))
        for kind, words in (("scheme", SCHEMES), ("cue", CUES)):
            for s in words:
                for v in map("".join, product(*({c, c.upper()} for c in s))):  # in any case
                    _automaton.add_word(v, (kind, len(v)))
        _automaton.make_automaton()
    return _automaton


def emails(t: str, ats: list[int]) -> Iterator[tuple[int, int]]:
    done, n = 0, len(t)
    for p in ats:
        s = p
        while s > done and t[s - 1] in LOCAL:
            s -= 1
        if s == p:
            continue
        e, labels = p + 1, 0
        while True:
            x = e
            while e < n and t[e] in LABEL:
                e += 1
            if e == x:
                e -= labels > 0  # the dot before an empty label isn't part of it
                break
            labels += 1
            if e < n and t[e] == ".":
                e += 1
            else:
                break
        if labels >= 2:
            yield s, e
            done = e


def digit_runs(digits: list[int]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for p in digits:
        if runs and runs[-1][1] == p:
            runs[-1] = (runs[-1][0], p + 1)
        else:
            runs.append((p, p + 1))
    return runs


def chains(t: str, runs: list[tuple[int, int]], seps: str) -> Iterator[list[tuple[int, int]]]:
    """Runs that are joined by a single separator each."""
    now: list[tuple[int, int]] = []
    for r in runs:
        if now and now[-1][1] + 1 == r[0] and t[now[-1][1]] in seps:
            now.append(r)
        else:
            if now:
                yield now
            now = [r]
    if now:
        yield now


def ips(t: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for c in chains(t, runs, "."):
        for i in range(0, len(c) - 3, 4):
            if all(len(x := t[a:b].lstrip("0")) <= 3 and int(x or 0) <= 255 for a, b in c[i : i + 4]):
                yield c[i][0], c[i + 3][1]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(t: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for c in chains(t, runs, " -"):
        if 13 <= sum(b - a for a, b in c) <= 19 and luhn("".join(t[a:b] for a, b in c)):
            yield c[0][0], c[-1][1]


def phones(t: str, pluses: list[int]) -> Iterator[tuple[int, int]]:
    n, done = len(t), 0
    for p in pluses:
        if p < done or p + 1 >= n or t[p + 1] not in DIGIT:
            continue
        e = p + 2
        while e < n and t[e] in PHONE:
            e += 1
        while e > p + 2 and t[e - 1] not in DIGIT:
            e -= 1
        if e >= p + 4:
            done = e
            if 9 <= sum(c in DIGIT for c in t[p:e]) <= 15:
                yield p, e


def iban_ok(x: str) -> bool:
    x = x.replace(" ", "").replace("-", "").upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", x):
        return False
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def accounts(t: str, cues: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    done = 0
    for s, e in cues:
        iban = t[s:e].lower() == "iban"
        if s < done or s and t[s - 1].isalnum() or not (m := (_IBAN if iban else _AFTER_CUE).match(t, e)) or m.start(1) == e:
            continue
        x = m[1]
        while iban and not iban_ok(x) and " " in x:  # words may follow
            x = x.rpartition(" ")[0]
        if iban_ok(x) if iban else sum(c in DIGIT for c in x) >= 6:
            done = m.start(1) + len(x)
            yield m.start(1), done


def find(t: str) -> list[tuple[str, int, int]]:
    """All spans of a text (code points), by kind as listed, then start."""
    ats, pluses, digits, schemes, cues = [], [], [], [], []
    for end, (what, n) in automaton().iter(t):
        if what == "digit":
            digits.append(end)
        elif what == "at":
            ats.append(end)
        elif what == "plus":
            pluses.append(end)
        elif what == "scheme":
            schemes.append(end + 1)
        else:
            cues.append((end + 1 - n, end + 1))
    out: list[tuple[str, int, int]] = []
    if ats:
        out += (("email", *x) for x in emails(t, ats))
    if digits:
        runs = digit_runs(digits)
        out += (("ip", *x) for x in ips(t, runs))
        out += (("card", *x) for x in cards(t, runs))
        out += (("phone", *x) for x in phones(t, pluses))
    if schemes:
        out += (("url", p, m.end()) for p in schemes if (m := _USERINFO.match(t, p)))
    if cues:
        out += (("account", *x) for x in accounts(t, cues))
    return out


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: counts of the fixed kinds, a digest of their spans, and all spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                found = find(t.as_py() or "")
                told = [f"{a}:{s}:{e}" for a, s, e in found]
                base = [x for x, f in zip(told, found) if f[0] in BASE_KINDS]
                n = [sum(f[0] == kind for f in found) for kind in BASE_KINDS]
                rows.append((k, *n, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(told), len(told) - len(base)))
            kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], NAMES)

    small_batches(docs.sparkSession)
    return docs.select(F.col(key), F.col(text)).mapInArrow(scan, SCHEMA)


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def redact(t: str) -> str:
    """The text with ``[kind]`` in place of each span; of spans that overlap, the first and longest counts."""
    out, done = [], 0
    for kind, s, e in sorted(find(t), key=lambda x: (x[1], -x[2])):
        if s >= done:
            out += [t[done:s], f"[{kind}]"]
            done = e
    return "".join([*out, t[done:]])


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in ``text``; null stays null."""

    small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def swap(x: pa.Array) -> pa.Array:
        return pa.array((None if (t := v.as_py()) is None else redact(t) for v in x), pa.string())

    return docs.withColumn(text, swap(F.col(text)))
