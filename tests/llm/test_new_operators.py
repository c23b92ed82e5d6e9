"""Toxicity, whitening and ranked search: brute force, held-out accuracy, and the cases that their docstrings state."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echoframe.llm import queries, ranked_search, toxicity, whitening
from echoframe.llm.scratch import Tables

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


# Ranked search


def by_hand(docs, items, k):
    rows = [(i, Counter(terms(t))) for i, t in docs]
    rows = [(i, c, sum(c.values())) for i, c in rows if c]
    n, total = len(rows), sum(x for _, _, x in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c, size in rows:
            m = 75 + (25 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                found.append((-s, -(2**63) if doc is None else doc, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(found, key=lambda x: x[:2])[:k])]
    return sorted(out, key=repr)


@pytest.fixture
def small_blocks(monkeypatch):
    for name, v in (("BLOCK_BYTES", 3000), ("SHORT", 4), ("WINDOW", 7), ("QUERIES_AT_ONCE", 5)):
        monkeypatch.setattr(ranked_search, name, v)
    monkeypatch.setattr(ranked_search.slices, "__defaults__", (500,))


def collected(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_search_equals_brute_force(spark, small_blocks):
    rng = random.Random(1)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 300}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(600)]
    docs += [(i + 1000, docs[3][1]) for i in range(30)]  # ties
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(17)]
    got = ranked_search.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), 10)
    assert collected(got) == by_hand(docs, items, 10)


def test_search_cases(spark, small_blocks):
    docs = [(1, None), (2, ""), (3, " .,!"), (None, "Äpfel ÄPFEL apfel"), (4, "Apfel-kuchen 2x"), (4, "Apfel-kuchen 2x"), (5, "apfel " * 20_000), (6, "kuchen\x00mit\x7fsahne")]
    items = [(1, None), (2, "..."), (3, "APFEL apfel Äpfel"), (3, "kuchen"), (None, "sahne"), (5, "nowhere")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(1), "rank": F.lit("x"), "term": F.lit(None).cast("string"), "block": F.lit(2)})
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "score": F.lit(0)})
    assert collected(ranked_search.ranked(d, q)) == by_hand(docs, items, 20)
    for a, b in ((d.limit(0), q), (d, q.limit(0)), (d.where("text is null"), q)):
        out = ranked_search.ranked(a, b)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_an_index_serves_many_searches(spark):
    docs = spark.createDataFrame([(i, f"common word{i % 7} x{i}") for i in range(50)], "doc_id long, text string")
    with Tables(spark, "t") as tables:
        found = ranked_search.index(docs, tables)
        for text, want in (("x7", [7]), ("word3", [3, 10, 17, 24, 31, 38, 45])):
            q = spark.createDataFrame([(1, text)], "item_id long, text string")
            assert [r.doc_id for r in ranked_search.search(found, q).orderBy("rank").collect()] == want


# Whitening


def unspark(got, k):
    return {c: got[got.component == c].sort_values(["vec_id", "whitened"]) for c in range(1, k + 1)}


def test_whitening_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 16)
    monkeypatch.setattr(whitening, "COLUMNS", 4)
    monkeypatch.setattr(whitening, "PANEL", 100)
    monkeypatch.setattr(whitening, "BLOCKS_A_TASK", 2)
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(250, 6)) @ rng.normal(size=(6, 6))).astype(np.float32)
    v = np.concatenate([v, v[:20], v[:1].repeat(40, 0)])
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(v)]
    odd = [(900, None), (901, [None] * 6), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (None, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"x": F.lit(1), "index": F.lit("i"), "n": F.lit(None).cast("int")})
    got = whitening.whitened(df.repartition(5), 3).toPandas()
    x = np.floor(256 * np.concatenate([v, v[:1]]).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    assert len(got) == 3 * len(x) and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-12
    deviation = ((n * x - s) ** 2).sum(1)
    for k, rows in unspark(got, 3).items():
        p = (x - s / n) @ u[:, -k] / np.sqrt(e[-k])
        assert any(np.allclose(rows.whitened, pd.DataFrame({"i": [*range(len(v)), None], "p": sign * p}).sort_values(["i", "p"]).p, atol=1e-9) for sign in (1, -1))
        assert sorted(rows.deviation) == sorted(deviation.tolist())
        assert np.allclose(rows.explained, e[-k] / e.sum())


def test_whitening_cases(spark):
    schema = "vec_id long, embedding array<float>"
    make = lambda rows: spark.createDataFrame(rows, schema)
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, []), (2, [])]):
        out = whitening.whitened(make(rows))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0
    line = whitening.whitened(make([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [-0.0, 1.0])])).orderBy("vec_id").collect()  # one component has a variance
    assert [r.component for r in line] == [1, 1, 1] and {r.n for r in line} == {2} and [abs(r.whitened) for r in line] == pytest.approx([1, 1, 1])
    assert [r.deviation for r in line] == [256**2] * 3
    with pytest.raises(ValueError, match="2 to 3 entries"):
        whitening.whitened(make([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])]))
    with pytest.raises(Exception, match="too large"):
        whitening.whitened(make([(1, [1e30, 2.0]), (2, [1.0, 2.0])]))


# Toxicity


def test_features_are_grams_and_skip_grams():
    raw, at = np.frombuffer(b"A b c a-B", np.uint8), np.array([0, 5, 5, 9])
    got, row = toxicity.features(raw, at)
    assert np.bincount(row, minlength=3).tolist() == [3 + 2 + 1, 0, 2 + 1]  # terms, pairs, pairs that skip one
    assert len(set(got[row == 0]) & set(got[row == 2])) == 3  # a, b and the pair a b
    again, _ = toxicity.features(np.frombuffer(b"x x x x x", np.uint8), np.array([0, 9]))
    assert len(again) == 3  # each once


def test_learner_follows_the_formulas():
    r = toxicity.Rates(alpha=0.5, beta=1.0, l1=0.2, l2=0.1)
    own = toxicity.Learner(np.zeros(toxicity.INTERCEPT + 1), np.zeros(toxicity.INTERCEPT + 1), r)
    z, n, rng = {}, {}, random.Random(2)
    for _ in range(60):
        at, y = sorted(rng.sample(range(12), 4)) + [toxicity.INTERCEPT], rng.randrange(2)

        def weight(i):
            l1 = 0 if i == toxicity.INTERCEPT else 0.2
            d = z.get(i, 0.0)
            return 0.0 if abs(d) <= l1 else -(d - math.copysign(l1, d)) / ((1 + math.sqrt(n.get(i, 0.0))) / 0.5 + 0.1)

        w = {i: weight(i) for i in at}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in at:
            z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / 0.5 * w[i]
            n[i] = n.get(i, 0.0) + g * g
        own.learn(np.array(at), y)
    assert all(abs(own.z[i] - z[i]) < 1e-9 and abs(own.n[i] - n[i]) < 1e-9 for i in z)


def test_toxicity_on_held_out_rows(spark):
    got = queries.op11_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all() and (got.predicted == (got.score >= 0.5)).all()
    m = got[got.held_out].merge(labels, on="doc_id")
    bad, good = m[m.toxic == 1].score.to_numpy(), m[m.toxic == 0].score.to_numpy()
    assert (bad[:, None] > good).mean() > 0.97 and (good >= 0.5).mean() < 0.01 and (bad >= 0.5).mean() > 0.75


def test_toxicity_cases(spark):
    rng = random.Random(3)
    text = lambda bad: " ".join([f"w{rng.randrange(200)}" for _ in range(20)] + ["Vile?"] * bad)
    rows = [(i, text(i % 3 == 0)) for i in range(300)] + [(3, text(1)), (None, text(0)), (400, None), (401, ""), (402, "... !"), (403, "vile " * 100_000)]
    labels = [(i, int(i % 3 == 0)) for i in range(300)] + [(3, 0), (3, None), (9999, 1), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"label": F.lit("x"), "place": F.lit(1), "score": F.lit(2), "at": F.lit(3)})
    known = spark.createDataFrame(labels, "doc_id long, label int")
    with Tables(spark, "t") as tables:
        model = toxicity.learn(docs, known, tables)
        assert model.equals(toxicity.learn(docs.repartition(7), known.repartition(3), tables))  # the same for any partitions
        none = toxicity.learn(docs, known.limit(0), tables)
        few = toxicity.learn(docs, known, tables, sample=40)
    got = {(r.doc_id, r.score, r.predicted) for r in toxicity.score(docs, model).collect()}
    score = {d: s for d, s, _ in got}
    assert toxicity.score(docs, model).count() == len(rows) and score[400] == score[401] == score[402] and score[403] > 0.5
    assert sum(score[i] >= 0.5 for i in range(300) if i % 3 == 0) == 100 and not any(score[i] >= 0.5 for i in range(300) if i % 3)
    assert len(none) == 0 and {r.score for r in toxicity.score(docs, none).collect()} == {0.5} and not few.equals(model)
    assert toxicity.score(docs.limit(0), model).count() == 0
