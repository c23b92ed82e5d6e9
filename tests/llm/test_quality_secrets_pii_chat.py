import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoframe.llm import chat, pii, quality_rules, secret_scan

W = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def neighbours(texts):
    """How often each character follows each other one in short runs."""
    n = Counter(p for t in texts for run in re.findall(r"[A-Za-z0-9+/_-]+", t or "") if len(run) < secret_scan.LEAST for p in zip(run, run[1:]))
    return np.array([[n[a, b] for b in secret_scan.CHARACTERS] for a in secret_scan.CHARACTERS])


PLAIN = (secret_scan.__doc__ + quality_rules.__doc__ + chat.__doc__ + pii.__doc__) * 5
#: The cut of a corpus of plain text in which one candidate in a thousand is a secret.
CUT = secret_scan.Cut(1e-6, 30.0, secret_scan.Ordinary(neighbours([PLAIN])))


def docs_of(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or {}).get(i, "h"), len(t or "")) for i, t in enumerate(texts)], DOCS)


def repeats(text):
    w = W.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return len({j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)})


def test_measures_equal_plain_loops(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "one", "a b c", "a b c a b c", "é# ñ$ | \n\x0b x\x0cy"] + ["".join(rng.choice(["a ", "b ", "cé ", "# ", "\n", "\t", "a b c ", "  "]) for _ in range(rng.randrange(90))) for _ in range(60)]
    got = {r.doc_id: r for r in quality_rules.judged(docs_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, r = t or "", got[i]
        w = W.findall(t)
        lines = [x for x in t.split("\n") if W.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t))), repr(t)
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == repeats(t), repr(t)
        assert r.base_failed == (len(w) < 50 or 100 * r.n_repeat_words > 50 * len(w)) and (not r.base_failed or not r.kept)


def test_hosts_are_shrunk_and_judged(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, good if i % 10 else "bad", "en", "fine", 0) for i in range(200)] + [(1000 + i, good if i % 10 == 0 else "bad", "en", "awful", 0) for i in range(200)] + [(2000, "bad", "en", "tiny", 0), (3000, good, "en", None, 0)]
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].kept and not got[1000].kept and not got[1000].base_failed and got[3000].kept and got[3000].host_rate is None
    assert 0 < got[2000].host_rate < 1  # one failure doesn't make a rate of 1
    kept = quality_rules.passing(spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "n_words"))
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept} and kept.columns[-1] == "n_words"
    assert quality_rules.judged(spark.createDataFrame([], DOCS)).count() == 0


def test_random_tokens_behind_names_and_in_paths():
    key = "Zk3x9QmR7bLw2TfVuY8sPdHc4NaJ6eGi"
    for t in (f"SIGNING_KEY={key}", f"a https://h.example/x?sig={key}&n=1", f"see path/with-dash/{key} there", f"some_name-x/{key}", f"K={key}==", f"k={key}"):
        at = t.index(key)
        got = [(s, e) for k, s, e in secret_scan.find(t, CUT) if k == "random"]
        assert len(got) == 1 and got[0][0] <= at and got[0][1] >= at + len(key), t
        assert key not in secret_scan.redact(t, CUT) and "[secret]" in secret_scan.redact(t, CUT)
    assert secret_scan.redact(f"SIGNING_KEY={key}", CUT) == "SIGNING_KEY=[secret]" and secret_scan.redact(f"K={key}==", CUT) == "K=[secret]"
    assert secret_scan.find("the/usual-path/to_some/2024-report/with-many_words/inside-it/2023", CUT) == []


def plain_ordinary(texts):
    """The null by counting, as a function of two characters."""
    n = dict(zip(((a, b) for a in secret_scan.CHARACTERS for b in secret_scan.CHARACTERS), neighbours(texts).ravel().tolist()))
    kind = lambda c: "d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s"
    sizes = {"d": 10, "u": 26, "l": 26, "s": 4}
    after = {a: dict(zip("duls", row)) for a, row in zip("duls", [[0.74, 0.06, 0.10, 0.10], [0.04, 0.42, 0.50, 0.04], [0.02, 0.06, 0.88, 0.04], [0.20, 0.15, 0.60, 0.05]])}

    def chance(a, b):
        q = after[kind(a)][kind(b)] / sizes[kind(b)]
        total = sum(v for (x, _), v in n.items() if x == a)
        known = 0.7 * total / (total + 100)
        return known * n[a, b] / max(1, total) + (1 - known) * q

    return chance


def plain_evidence(token, chance):
    body = token.rstrip("=")
    size = next((len(a) for _, a in secret_scan.ENCODINGS if set(body) <= set(a)), 0)
    if not size:
        return 0
    ratio = sum(-math.log(chance(a, b)) - math.log(size) for a, b in zip(body, body[1:])) - math.log(8)
    return max(0, math.floor(64 * ratio))


def test_evidence_by_plain_formulas(spark):
    rng = random.Random(21)
    texts = ["The q-uick brown_fox 12 of 2024", None, "", "é/usr/bin/a9 " * 3, "x" * 19 + " " + "y" * 20] + [" ".join("".join(rng.choice("abcDEF019-") for _ in range(rng.randrange(1, 25))) for _ in range(40)) for _ in range(5)]
    null, chance = secret_scan.ordinary_text(docs_of(spark, texts)), plain_ordinary(texts)
    for a in secret_scan.CHARACTERS:
        for b in secret_scan.CHARACTERS:
            assert math.isclose(math.exp(null.log[secret_scan.CODE[ord(a)], secret_scan.CODE[ord(b)]]), chance(a, b), rel_tol=1e-9), (a, b)
    for name, alphabet in [*secret_scan.ENCODINGS, ("words", "etaoin")]:
        token = "".join(rng.choice(alphabet) for _ in range(30)) + "=" * (name == "base64")
        assert abs(null.evidence(token) - plain_evidence(token, chance)) <= 1
    assert np.allclose(np.exp(null.log).sum(axis=1), 1) and np.allclose(np.exp(secret_scan.Ordinary().log).sum(axis=1), 1)


def test_battery_by_plain_formulas():
    rng = random.Random(11)
    for name, alphabet in secret_scan.ENCODINGS:
        for n in (20, 33, 64):
            token = "".join(rng.choice(alphabet) for _ in range(n))
            got, chi, runs, serial = secret_scan.battery(token)
            size = dict(secret_scan.ENCODINGS)[got]
            x = [size.index(c) for c in token]
            bins = max(2, min(len(size), n // 2))
            want = [sum(v * bins // len(size) == b for v in range(len(size))) * n / len(size) for b in range(bins)]
            seen = [sum(v * bins // len(size) == b for v in x) for b in range(bins)]
            assert math.isclose(chi, secret_scan.chi2_tail(sum((s - w) ** 2 / w for s, w in zip(seen, want)), bins - 1), rel_tol=1e-9)
            up = "".join("1" if v >= len(size) / 2 else "0" for v in x)
            a, b = up.count("1"), up.count("0")
            mean = 2 * a * b / n + 1
            z = (len(re.findall("1+|0+", up)) - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1))
            assert math.isclose(runs, math.erfc(abs(z) / math.sqrt(2)), rel_tol=1e-9)
            mid = sum(x) / n
            r = sum((x[i] - mid) * (x[i + 1] - mid) for i in range(n - 1)) / sum((v - mid) ** 2 for v in x)
            assert math.isclose(serial, math.erfc(abs(r) * math.sqrt(n / 2)), rel_tol=1e-9)
    assert secret_scan.battery("a" * 40)[2] == 0 and secret_scan.battery("ab+_" * 10) is None


def plain_cut(texts):
    """The step-up by sorting all p-values; the largest that passes."""
    null = secret_scan.Ordinary(neighbours(texts))
    found = [(e - s, null.evidence(t[s:e])) for t in texts for s, e in secret_scan.candidates(t or "")]
    mean = sum(n for n, _ in found) / len(found) if found else 1.0
    p = sorted(secret_scan.weighted_p(n, k, mean) for n, k in found)
    return max((x for i, x in enumerate(p, 1) if x <= secret_scan.FDR * i / len(p)), default=-1.0), mean


def test_step_up_over_the_corpus(spark):
    rng = random.Random(12)
    alphabet = secret_scan.ENCODINGS[5][1]
    words = ["internationalisation2024", "configuration_manager_v12", "getElementsByTagNameOf", "sha256ofthewholedirectory"]
    texts = [None, ""] + [" ".join(rng.choice(words) for _ in range(5)) for _ in range(80)] + ["key " + "".join(rng.choice(alphabet) for _ in range(rng.randrange(20, 60))) for _ in range(40)] + [PLAIN]
    cut, (p, mean) = secret_scan.corpus_cut(docs_of(spark, texts * 2)), plain_cut(texts * 2)
    assert math.isclose(cut.mean, mean)
    pairs = {(e - s, cut.ordinary.evidence(t[s:e])) for t in texts if t for s, e in secret_scan.candidates(t)}
    assert {x for x in pairs if cut.passes(*x)} == {x for x in pairs if secret_scan.weighted_p(*x, mean) <= p} and 0 < len(pairs)
    assert secret_scan.corpus_cut(docs_of(spark, [None, "", "no candidates"])).p == 0
    hit = [any(k == "random" for k, _, _ in secret_scan.find(t or "", cut)) for t in texts]
    assert not any(hit[:82]) and sum(hit[82:122]) >= 36


def test_recall_by_encoding():
    """Shares of random keys of 32 characters that are found at a corpus's cut of 1e-6 (a key in a million tokens or fewer), by
    the null of plain English, and of ordinary long tokens."""
    rng = random.Random(13)
    for name, alphabet in secret_scan.ENCODINGS:
        keys = ["".join(rng.choice(alphabet) for _ in range(32)) for _ in range(400)]
        assert sum(bool(secret_scan.random_tokens(k, CUT)) for k in keys) >= 0.9 * len(keys), name
    words = re.findall(r"[A-Za-z]{3,}", PLAIN)
    tokens = [rng.choice("_-/").join(rng.choice(words) for _ in range(5)) for _ in range(1000)] + ["".join(rng.choice(words).title() for _ in range(4)) + str(rng.randrange(100)) for _ in range(1000)]
    assert sum(bool(secret_scan.random_tokens(t, CUT)) for t in tokens) <= 1
    assert not secret_scan.random_tokens("a1b2c3d4e5f6g7h8i9j0k1", CUT) or min(secret_scan.battery("a1b2c3d4e5f6g7h8i9j0k1")[1:]) >= secret_scan.REJECT


def test_secret_scan_cases(spark):
    long = "word " * 50_000 + "AKIA" + "Q" * 16 + " " + "0123456789abcdef" * 4000
    rows = [(1, None, 0), (1, long, 1), (None, "hex 0123456789abcdef0", 2), (2, "password=abcdef123456", 3), (2, "password=abcdef123456", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans long").withColumn("n_hex", F.lit("x"))
    got = sorted(((r.doc_id or 0), r.n_assign, r.n_access, r.n_hex) for r in secret_scan.spans(df).collect())
    assert got == [(0, 0, 0, 1), (1, 0, 0, 0), (1, 0, 1, 1), (2, 1, 0, 0), (2, 1, 0, 0)]
    assert secret_scan.spans(df.limit(0)).count() == 0 and secret_scan.redacted(df.limit(0)).count() == 0
    out = secret_scan.redacted(df)
    assert out.columns == df.columns and out.count() == 5 and out.where("n_hex = 'x'").count() == 5
    many = " ".join(f"password=abcdef{i:06d}" for i in range(40_000))
    began = time.time()
    assert len(secret_scan.find(many, CUT)) == 40_000 and time.time() - began < 20


PII_BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii_plain(t):
    out = []
    for kind, pattern in PII_BASE.items():
        for m in re.finditer(pattern, t):
            d = re.sub(r"\D", "", m[0], flags=re.A)
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_anchors_find_what_the_grammars_find():
    rng = random.Random(8)
    bits = ["a@b.c", "@", ".", "x", " ", "-", "1", "22", "255", "256", "4111111111111111", "4111-1111 1111 1111", "+1", "(654) ", "555-6156", "é", "\n", "1.2.3.4", "..", "+", "a.b", "@b", "0000000000000"]
    for _ in range(20000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert [x for x in pii.find(t) if x[0] in pii.BASE_KINDS] == pii_plain(t), repr(t)


def test_added_kinds_and_redaction(spark):
    t = "see https://joe:pw@host.example.com/x and IBAN: GB82 WEST 1234 5698 7654 32 or account no. 12345678, not account holder"
    kinds = [k for k, _, _ in pii.find(t)]
    assert kinds.count("account") == 2 and "url" in kinds
    assert pii.redact("mail a@b.co now") == "mail [email] now"
    df = docs_of(spark, [None, "", t, "x" * 300_000 + " a@b.co", "a@b.co"] + ["a@b.co"])
    got = pii.spans(df.withColumn("spans", df.text)).orderBy("doc_id").collect()
    assert [r.n_email for r in got] == [0, 0, 1, 1, 1, 1] and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.spans(df.limit(0)).count() == 0 and pii.redacted(df).where("text is null").count() == 1


def secrets_plain(t):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_secret_grammars_and_randomness(spark):
    rng = random.Random(9)
    bits = ["password", "Token", "api_key", "=", ": ", '"', "'", "abc123abc123", "AKIA", "ABCDEFGHIJKLMN", "0123456789abcdef", "f", " ", "\n", "é", "="]
    for _ in range(20000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
        assert [x for x in secret_scan.find(t, CUT) if x[0] != "random"] == secrets_plain(t), repr(t)
    alphabet = secret_scan.ENCODINGS[5][1]
    found = sum(bool(secret_scan.random_tokens("key " + "".join(rng.choice(alphabet) for _ in range(40)), CUT)) for _ in range(200))
    plain = sum(bool(secret_scan.random_tokens(" ".join(rng.choice(["internationalisation2024", "configuration_manager_v12", "http_request_handler_001"]) for _ in range(5)), CUT)) for _ in range(200))
    assert found > 180 and plain == 0
    df = docs_of(spark, [None, "", "password=abcdef123456", "clean words only"])
    assert [r.n_assign for r in secret_scan.spans(df).orderBy("doc_id").collect()] == [0, 0, 1, 0]
    assert [r.text for r in secret_scan.redacted(df).orderBy("doc_id").collect()] == [None, "", "[secret]", "clean words only"]


def test_chat_round_trip(spark):
    rng = random.Random(4)
    bits = ["[INST]", "[/INST]", " [/INST]", "</s>", "<s>", "\\", "]", "[ROLE ", "<<SYS>>", "a", " ", "\n", "é", "<", "[", "[/ROLE]"]
    t = chat.Template()
    turns = [("".join(rng.choice(bits) for _ in range(rng.randrange(8)))) for _ in range(4000)]
    for i in range(0, len(turns), 4):
        said = list(zip(rng.choices(["user", "assistant", "system", "tool", "x]y", "", "o\\"], k=4), turns[i : i + 4]))
        text = "".join(p for r, x in said for p, _ in chat.segments(r, x, t))
        assert list(chat.parse(text, t)) == said
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a</s>b"), (1, 2, "user", None), (1, 3, "assistant", "c"), (2, 0, "assistant", "x"), (None, 0, None, "n"), (3, 5, "user", "u"), (3, 5, "user", "u")]
    got = {r.conv_id: r for r in chat.round_trip(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].n_turns == 4 and got[1].valid and got[1].loss_chars == 7 and not got[2].valid and got[3].n_turns == 2 and not got[3].valid and got[None].n_turns == 1
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\na</s>b\nuser\n\nassistant\nc\n").hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"a</s>bc").hexdigest()


@pytest.mark.parametrize("p", [[0.0, 1.0]])
def test_chi_squared_tail(p):
    assert abs(secret_scan.chi2_tail(15.507, 8) - 0.05) < 0.002
