"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for operators and the pipeline."""

import hashlib
import random
import time

import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from echoframe.llm import bpe, chat, decontaminate, minhash, pii, quality_rules, secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, of=5000):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def test_quality_rules(spark):
    rng = random.Random(1)
    long = words(rng, 200_000, 10**9)
    at_bound = " ".join(["a b c"] * 9 + [f"x{i}" for i in range(27)])  # 27 of 54 words stand in windows that repeat
    rows = [(1, None, "en", "h", 0), (1, None, "en", "h", 0), (2, "", None, None, None), (3, long, "en", "h", 0), (4, long + " " + long, "en", "h", 0), (None, at_bound, "en", None, 0)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"_m": F.lit(1), "_row": F.lit(2), "kept": F.lit("x")})
    got = quality_rules.judged(df.drop("kept")).collect()
    assert len(got) == 6 and [r.n_words for r in got if r.doc_id == 3] == [200_000]
    assert [r.n_repeat_words for r in got if r.doc_id == 4][0] >= 399_990 and [r.base_failed for r in got if r.doc_id is None] == [False]
    kept = quality_rules.passing(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {None} and kept.where("kept <> 'x'").count() == 0
    assert quality_rules.passing(df.limit(0)).columns == df.columns and quality_rules.passing(df.limit(0)).count() == 0


def test_personal_data(spark):
    long = "word " * 100_000 + "a@b.co " + "1.2.3.4 " * 20_000
    rows = [(None, "a@b.co", 1), (1, None, 2), (1, "", 3), (2, long, 4), (3, "IBAN GB82WEST12345698765432 aCCount No. 12345678 hTTPs://u:p@h.org/x", 5), (3, "mail a@b.co", 6), (3, "mail a@b.co", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_ip long").withColumn("spans", F.lit("x"))
    got = pii.spans(df).collect()
    assert len(got) == 7 and [r.n_ip for r in got if r.doc_id == 2] == [20_000]
    kinds = [[x.split(":")[0] for x in r.spans.split(",")] for r in got if r.doc_id == 3]
    assert kinds[0].count("account") == 2 and "url" in kinds[0] and kinds[1:] == [["email"]] * 2
    out = pii.redacted(df)
    assert out.columns == df.columns and out.count() == 7 and out.where("text like '%@b.co%'").count() == 0
    assert pii.redacted(df.limit(0)).count() == 0
    for t, want in (
        ("https://user:pw@host.org/a?b see", "url"),
        ("http://host.org/no@sign", None),
        ("ftp://x@h", "url"),
        ("iban: DE89 3704 0044 0532 0130 00 and", "account"),
        ("iban: DE88 3704 0044 0532 0130 00 and", None),
        ("ssn 123-45-6789", "account"),
        ("account holder", None),
        ("account 12345", None),
        ("discount 1234567", None),
        ("konto nr. AB-123456", "account"),
    ):
        assert [k for k, _, _ in pii.find(t) if k in ("url", "account")] == ([want] if want else []), t


def test_decontamination(spark):
    rng = random.Random(2)
    stem = words(rng, 6)
    items = [stem + " " + words(rng, 30) for _ in range(200)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(900, items[3]), (901, None), (902, ""), (903, "one")], "item_id long, text string")
    edited = items[7].split()
    edited[10], edited[20] = "x1", "x2"
    rows = [(1, words(rng, 60_000) + " " + items[3] + " " + words(rng, 50)), (1, items[3]), (1, items[3]), (None, "see " + " ".join(edited).upper()), (2, None), (3, ""), (4, " ".join([stem] * 800))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit(5), "distance": F.lit("d")})
    began = time.time()
    got = sorted((r.doc_id or 0, r.item_id, r.distance) for r in decontaminate.matches(df, bench).collect())
    assert got == [(0, 7, 2)] + sorted([(1, 3, 0), (1, 900, 0)] * 3) and time.time() - began < 60
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4]


def test_repeats_follow_the_length_of_items():
    rng = random.Random(3)
    hashes = lambda n: [rng.randrange(1 << 62) for _ in range(n)]
    few = [(i, hashes(20)) for i in range(50)]
    short, mixed = (decontaminate.Index(x, decontaminate.Search()) for x in (few, [*few, (99, hashes(300))]))
    repeats = {n: len(t) for n, (_, t) in mixed.keys.items()}
    assert repeats[20] == len(short.keys[20][1]) and repeats[300] >= 1
    import numpy as np

    found = 0
    for k in range(60):  # copies of the long item with as many edits as it allows
        w = list(mixed.words[50])
        for _ in range(45):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            if kind == 0:
                w[at] = rng.randrange(1 << 62)
            elif kind == 1:
                w.insert(at, rng.randrange(1 << 62))
            else:
                del w[at]
        h = np.array(hashes(40) + [int(x) for x in w] + hashes(40), np.uint64)
        found += (0, 50) in mixed.search(h, np.zeros(len(h), np.int64))
    assert found >= 57


def test_encoding_of_repeated_rows(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = [(1, "a b", 1), (1, "a b", 1), (None, "漢字" * 3000, 2), (2, "x" * 200_000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long").withColumn("n_tokens", F.lit("n"))
    got = bpe.encoded(df, path).collect()
    assert len(got) == 4 and all(r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for r, (_, t, _) in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(rows, key=lambda r: str(r[0]))))
    assert bpe.encoded(df.limit(0), path, ids=True).count() == 0


def test_conversations(spark):
    long = "</s>[INST] word " * 50_000
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(3000)] + [(2, 0, "user", long), (2, 1, "assistant", long), (3, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"seq": F.lit(1), "formatted": F.lit("x"), "valid": F.lit(7)})
    got = {r.conv_id: r for r in chat.round_trip(df).collect()}
    assert got[1].n_turns == 3000 and got[1].valid and got[2].loss_sha256 == hashlib.sha256(long.encode()).hexdigest() and got[2].loss_chars == len(long)
    assert got[3].n_turns == 1 and got[3].loss_chars == 0 and chat.round_trip(df.limit(0)).count() == 0


def documents(tmp_path, spark, rows):
    spark.createDataFrame(rows, DOCS + ", _near_id string, kept boolean, doc struct<a: int>").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))


def test_pipeline_on_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").first().text
    a, b, c = (words(rng, 120, 10**6) for _ in range(3))
    near = a.replace(a.split()[60], "changed")
    texts = [(1, None), (2, ""), (3, a), (4, a), (5, near), (6, b), (6, b), (7, words(rng, 60_000, 10**6)), (8, c + " " + item), (9, c + " password=abcdef123456 end"), (None, words(rng, 90, 10**6))]
    documents(tmp_path, spark, [(i, t, "en", f"h{k}", len(t or ""), "x", True, (1,)) for k, (i, t) in enumerate(texts)])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    enc = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"))
    assert sorted((r.doc_id or 0) for r in got) == [0, 3, 6, 7, 9]
    ids = {r.doc_id: r.ids for r in got}
    assert ids[3] == enc.encode_ordinary(a) and ids[9] == enc.encode_ordinary(c + " [secret] end")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.where("_near_id <> 'x' or not kept or doc.a <> 1").count() == 0, name


def test_pipeline_on_no_rows(spark, tmp_path):
    documents(tmp_path, spark, [])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "ids" in out.columns


def test_scratch_needs_a_shared_folder():
    import pytest

    from echoframe.llm import scratch

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Cluster)
    assert secret_scan.Cut(0.0, 1.0).passes(30, 0) is False and minhash.Bands().threshold == 0.8
