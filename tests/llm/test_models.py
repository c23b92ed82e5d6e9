import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
from pyspark.sql import functions as F

from echoframe.llm import bpe, components, decontaminate, huffman_ids, katz, kernels, language_id, minhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
W = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "h", 0) for i, t in enumerate(texts)], DOCS)


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(300, 299)]
    nodes = sorted({x for l in links for x in l} | {500})
    got = {r.node: r.label for r in components.components(spark.createDataFrame([(n, n) for n in nodes], "node long, label long"), spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 160)) and got[300] == 299 and got[500] == 500


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", "x y", "x y", "x  y\n"]
    for _ in range(12):
        base = sentence(rng, rng.randrange(30, 200))
        texts.append(base)
        for _ in range(rng.randrange(1, 9)):
            w = base.split()
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    line = sentence(rng, 12)
    texts += [line + "\n" + line + "\n" + sentence(rng, 6), line + "\n" + line + "\n" + sentence(rng, 6)]
    runs = [minhash.runs_of(t or "", 5) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(runs[i][0]) and minhash.similarity(runs[i], runs[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    df = docs_of(spark, texts)
    got = {r.doc_id: r.class_id for r in minhash.classes(df).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    kept = minhash.deduplicated(df.withColumn("label", df.doc_id))
    assert {r.doc_id for r in kept.collect()} == {find(i) for i in range(len(texts))} and kept.columns[-1] == "label"
    twice = minhash.deduplicated(df.unionByName(df))
    assert twice.count() == kept.count()
    assert minhash.classes(df.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs just above 0.8, by words changed and by a line repeated 2 and 60 times: nearly all are found."""
    rng = random.Random(10)
    new = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    texts, pairs = [], []
    for _ in range(60):
        w = new(300)
        x = list(w)
        for at in (20, 80, 140, 200, 260, 290):
            x[at] = new(1)[0]
        line = new(12)
        pairs += [(len(texts), len(texts) + 1), (len(texts) + 2, len(texts) + 3)]
        v = new(300)
        texts += [" ".join(w), " ".join(x), " ".join(v + line * 2), " ".join(v + line * 60)]
    for a, b in pairs[:2]:
        assert 0.8 <= minhash.similarity(minhash.runs_of(texts[a], 5), minhash.runs_of(texts[b], 5)) <= 1
    got = {r.doc_id: r.class_id for r in minhash.classes(docs_of(spark, texts)).collect()}
    for kind in (0, 1):
        own = pairs[kind::2]
        assert sum(got[a] == got[b] for a, b in own) >= 0.95 * len(own)
    assert len(set(got.values())) >= len(pairs)


def test_a_large_group_around_the_threshold(spark):
    """Copies of one text with few to many words changed: components equal those of all pairs."""
    rng = random.Random(14)
    base = sentence(rng, 150, 10**6).split()
    texts = []
    for k in range(500):
        w = list(base)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**8)}" if k % 5 else f"y{rng.randrange(3)}"
        texts.append(" ".join(w[: rng.randrange(140, 151)]))
    runs = [minhash.runs_of(t, 5) for t in texts]
    label = list(range(len(texts)))
    links = {i: [j for j in range(len(texts)) if i != j and minhash.similarity(runs[i], runs[j]) >= 0.8] for i in range(len(texts))}
    for i in range(len(texts)):
        if label[i] == i:
            todo = [i]
            while todo:
                for j in links[todo.pop()]:
                    if label[j] > i:
                        label[j] = i
                        todo.append(j)
    got = {r.doc_id: r.class_id for r in minhash.classes(docs_of(spark, texts)).collect()}
    assert sum(got[i] != label[i] for i in label) <= 2 and len(set(label)) > 20


def test_ids_with_several_texts(spark):
    a, b = sentence(random.Random(1), 80), sentence(random.Random(2), 80)
    first, second = sorted((a, b))
    rows = [(1, second), (1, first), (1, None), (2, second), (3, first), (None, first), (4, ""), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_near_id", F.lit(7))
    got = sorted((r.doc_id or 0, r.class_id) for r in minhash.classes(df).collect() if r.doc_id)
    assert got == [(1, 1)] * 3 + [(2, 2), (3, 1)] + [(4, 4)] * 2
    kept = minhash.deduplicated(df)
    assert kept.columns == df.columns and sorted(((r.doc_id or 0), r.text) for r in kept.collect()) == [(0, first), (1, first), (2, second), (4, "")]


def test_sets_of_runs_alone_make_links(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(8):
        w = [f"u{rng.randrange(10**9)}" for _ in range(104)]
        texts += [" ".join(w), " ".join(w[:40] + w[40:64] * 20 + w[64:]), " ".join(w[:40] + w[40:64] * 5 + w[64:])]
    one, many = (minhash.runs_of(t, 5) for t in texts[:2])
    assert minhash.similarity(one, many) > 0.9
    got = {r.doc_id: r.class_id for r in minhash.classes(docs_of(spark, texts)).collect()}
    assert got == {i: i - i % 3 for i in range(len(texts))}


def test_probability_jaccard_is_estimated():
    rng = np.random.default_rng(2)
    a = {int(h): int(n) for h, n in zip(rng.integers(1, 1 << 60, 60), rng.integers(1, 6, 60))}
    b = {h: int(rng.integers(1, 6)) for h in list(a)[:45]} | {int(h): 2 for h in rng.integers(1, 1 << 60, 10)}
    side = lambda d: (np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)]))
    exact = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in {*a, *b}) for i in a if i in b)
    plain = len({*a} & {*b}) / len({*a} | {*b})
    assert abs(minhash.similarity(side(a), side(b)) - max(exact, plain)) < 1e-9
    agree = []
    for seed in range(20):
        g = np.concatenate([side(a)[0], side(b)[0]])
        sig = minhash.prob_minhash(np.repeat([0, 1], [len(a), len(b)]), g, np.concatenate([side(a)[1], side(b)[1]]), 2, 224, seed)
        agree.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(agree) - exact) < 0.03


def test_huffman_codes_and_files(spark):
    path = P.path("byte_bpe_50k.json")
    t = huffman_ids.tokenizer(path)
    rng = random.Random(2)
    bits = ["a", "the", " ", "  ", "\n", "don't", "é", "漢", "1", "!", "\t", "'s", " ", "　", " ", "<|endoftext|>", "\u0085", "\x1c", "à"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(1500)] + [None, "", "x" * 5000, " word" * 4000]
    want = [[*x.ids, 2] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    df = docs_of(spark, texts).repartition(5)
    got = huffman_ids.round_trip(df, path).orderBy("doc_id").collect()
    start = 0
    for r, ids in zip(got, want):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(texts) and huffman_ids.round_trip(df.limit(0), path).count() == 0
    counts = (np.random.default_rng(1).pareto(0.4, 500) * 5).astype(np.int64) + 1
    for limit in (9, 12, 16):
        n = huffman_ids.code_lengths(counts, limit)
        assert n.max() <= limit and abs((2.0 ** -n.astype(float)).sum() - 1) < 1e-9


def thue_morse(n, a, b):
    return [a if bin(i).count("1") % 2 == 0 else b for i in range(n)]


def test_hashes_of_texts_that_polynomials_confuse():
    for a, b in (("a", "b"), ("0", "1")):
        x, y = "".join(thue_morse(1024, a, b)), "".join(thue_morse(1024, b, a))
        h, _ = kernels.word_hashes(*kernels.text_bytes(pa.array([x, y])))
        assert h[0] != h[1]
    x, y = " ".join(thue_morse(4096, "a", "b")), " ".join(thue_morse(4096, "b", "a"))
    h, row = kernels.word_hashes(*kernels.text_bytes(pa.array([x, y])))
    keys = kernels.sequence_hashes(h, np.bincount(row), 1)
    assert keys[0] != keys[1] and len(np.unique(kernels.windows(h, row, 64)[0])) == len({tuple(t[i : i + 64]) for t in (x.split(), y.split()) for i in range(4096 - 63)})
    rng = random.Random(3)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 200))) for _ in range(3000)]
    h, _ = kernels.word_hashes(*kernels.text_bytes(pa.array([" ".join(words)])))
    assert len(np.unique(h)) == len(set(words)) and len({*zip(words, h.tolist())}) == len(set(words))


def test_units_with_equal_hashes_keep_their_own_ids(spark, monkeypatch):
    path = P.path("byte_bpe_50k.json")
    t = huffman_ids.tokenizer(path)
    long = ["".join(thue_morse(1024, *ab)) for ab in ("ab", "ba", "01", "10")]
    rng = random.Random(5)
    texts = [*long, *(sentence(rng, 40) for _ in range(60)), "x" * 70 + "y", "x" * 70 + "z"]
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]

    def check():
        huffman_ids._units[path] = huffman_ids.Units()
        for part in (texts[:30], texts[30:], texts):  # the later ones meet what the first has left
            ids, n = huffman_ids.encode_texts(pa.array(part), path)
            own = [want[texts.index(x)] for x in part]
            assert ids.tolist() == [i for x in own for i in x] and n.tolist() == list(map(len, own))

    check()
    hashes = huffman_ids.span_hashes
    monkeypatch.setattr(huffman_ids, "span_hashes", lambda *a: hashes(*a) % np.uint64(5))
    check()
    huffman_ids._units[path] = huffman_ids.Units()


def test_code_lengths_are_optimal():
    def best(counts, limit):
        """Least total of limited lengths, over all ways to fill the Kraft sum."""
        counts = sorted(counts, reverse=True)
        from functools import lru_cache

        @lru_cache(None)
        def go(i, room):
            if i == len(counts):
                return 0
            least = math.inf
            for n in range(1, limit + 1):
                if (need := 1 << (limit - n)) <= room:
                    least = min(least, counts[i] * n + go(i + 1, room - need))
            return least

        return go(0, 1 << limit)

    rng = random.Random(8)
    for _ in range(30):
        counts = np.array([rng.randrange(1, 3 ** rng.randrange(1, 7)) for _ in range(rng.randrange(2, 9))])
        for limit in (3, 4, 6):
            if len(counts) <= 1 << limit:
                assert int((counts * huffman_ids.code_lengths(counts, limit)).sum()) == best(counts.tolist(), limit)


def test_file_cases(spark):
    path = P.path("byte_bpe_50k.json")
    rows = [(None, "a b", 1), (3, "c", 2), (3, "c", 3), (3, "a much longer text", 4), (1, None, 5), (2, "word " * 100_000, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long").withColumns({"n": F.lit(1), "n_tokens": F.lit(2)})
    got = huffman_ids.round_trip(df, path).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 3] and sum(r.n_tokens for r in got) == got[-1].start + got[-1].n_tokens
    assert got[2].n_tokens == len(huffman_ids.tokenizer(path).encode("word " * 100_000, add_special_tokens=False).ids) + 1


def test_special_strings_are_as_the_library_has_them(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    texts = ["a <|endoftext|> b", "x  \n <|endoftext|>\n\n y", "<|endoftext|><|endoftext|>", "it's<|endoftext|>.  ", "plain"]
    want = [[*x.ids, 2] for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert sum(50256 in x for x in want) == 4
    got = huffman_ids.round_trip(docs_of(spark, texts), path).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in want]


def test_tree_encoding_equals_the_library(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.encoding(path)
    rng = random.Random(1)
    tree = bpe.Tree(enc.encode_ordinary, size=16, window=4)
    bits = ["a", "the", " ", "  ", "\n", "don't", "é", "漢", "1", "!", "\t", "'s", " x", "　"]
    for _ in range(4000):
        s = "".join(rng.choice(bits) for _ in range(rng.randrange(120)))
        assert tree.encode(s) == enc.encode_ordinary(s) and tree.decode(tree.encode(s), enc.decode_bytes) == s.encode(), repr(s)
    texts = [None, "", "word " * 5000, "a" * 9000, "x\n" * 6000]
    for r, s in zip(bpe.encoded(docs_of(spark, texts), path, ids=True).orderBy("doc_id").collect(), texts):
        want = enc.encode_ordinary(s or "")
        assert r.ids == want and r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((s or "").encode()).hexdigest() and r.n_tokens == len(want)
    assert base64 and bpe.encoded(docs_of(spark, []), path).count() == 0


def test_language_profiles(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.held_out(docs.doc_id, 3, 1)
    profiles = language_id.learn(docs.where(~out))
    got = {r.doc_id: r for r in language_id.predict(docs, profiles).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.lang]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.98
    odd = {r.doc_id: r for r in language_id.predict(docs_of(spark, [None, "", "12 34!", "der und die", "漢字"]), profiles).collect()}
    assert [odd[i].lang_pred for i in range(3)] == ["und"] * 3 and odd[3].lang_pred == "de" and odd[4].score == 0
    assert language_id.predict(docs_of(spark, ["der"]), {}).first().lang_pred == "und"
    text = "abba ab"
    count = collections.Counter(x for w in text.split() for p in [f" {w} "] for n in (1, 2, 3) for i in range(len(p) - n + 1) for x in [p[i : i + n]] if x.strip() and not (n == 3 and x[1] == " "))
    u, n = language_id.counted(language_id.grams(text))
    assert sorted(n.tolist()) == sorted(count.values())


def test_language_of_a_text_is_the_nearest_profile(spark):
    """Brute force over text: profiles, ranks and out-of-place distances by plain counting."""
    top = 40

    def plain(texts):
        count = collections.Counter()
        for t in texts:
            for w in re.findall(r"[^\W\d_]+", t.lower()):
                p = f" {w} "
                count.update(w)
                count.update(p[i : i + 2] for i in range(len(p) - 1))
                count.update(p[i : i + 3] for i in range(len(p) - 2) if p[i + 1] != " ")
        return count

    def number(g):
        a = [0 if c == " " else ord(c) for c in g]
        return a[0] | 3 << 62 if len(g) == 1 else a[0] << 21 | a[1] | 1 << 63 if len(g) == 2 else a[0] << 42 | a[1] << 21 | a[2]

    def first(count):
        return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], number(x[0])))[:top]]

    rng = random.Random(4)
    said = {k: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(60)] for k, letters in (("xa", "abcde "), ("xb", "bcdef "), ("xc", "éèàab "))}
    rows = [(i, " ".join(rng.choices(said[k], k=20)) + " 12. A-B", k, "h", 0) for i, k in enumerate(["xa", "xb", "xc"] * 8)]
    docs = spark.createDataFrame(rows, DOCS)
    profiles = {k: first(plain(t for _, t, l, *_ in rows if l == k)) for k in said}
    learnt = language_id.learn(docs, top=top)
    assert {k: v.tolist() for k, v in learnt.items()} == {k: [number(g) for g in v] for k, v in profiles.items()}
    tests = [t for _, t, *_ in rows] + ["abc", "é", "f f f", " ".join(said["xb"]), "x" * 200_000]
    for r, t in zip(language_id.predict(docs_of(spark, tests), learnt, top=top).orderBy("doc_id").collect(), tests):
        own = first(plain([t]))
        far = {k: sum(abs(i - v.index(g)) if g in v else top for i, g in enumerate(own)) for k, v in profiles.items()}
        k = min(sorted(far), key=far.get)
        assert (r.lang_pred, r.score) == (k, 1 - far[k] / (top * len(own))), t[:40]
    assert language_id.predict(docs.limit(0), learnt, top=top).count() == 0 and language_id.learn(docs.limit(0)) == {}
    twice = language_id.predict(docs.unionByName(docs), learnt, top=top).groupBy("doc_id").agg(F.count_distinct("lang_pred", "score").alias("n"), F.count("*").alias("m"))
    assert twice.where("n <> 1 or m <> 2").count() == 0


def test_contamination_equals_brute_force(spark):
    rng = random.Random(12)
    items = [sentence(rng, rng.randrange(8, 60)) for _ in range(25)] + [None, ""]
    texts = [None, "", sentence(rng, 2000)]
    for k in range(150):
        w = items[k % 25].split()
        for _ in range(rng.randrange(0, 2 + int(len(w) * 0.2))):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            if kind == 0:
                w[at] = f"q{rng.randrange(10**6)}"
            elif kind == 1:
                w.insert(at, f"q{rng.randrange(10**6)}")
            elif len(w) > 1:
                del w[at]
        texts.append(sentence(rng, rng.randrange(60)) + " " + " ".join(w).upper() + "\n" + sentence(rng, rng.randrange(60)))
    df = docs_of(spark, texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    p = decontaminate.Search()
    want = {}
    hashed = [decontaminate.words(pa.array([t], pa.string()))[0] for t in texts]
    for i, t in enumerate(items):
        if t:
            x = decontaminate.words(pa.array([t]))[0]
            for d, h in enumerate(hashed):
                n, _ = decontaminate.edit_distance(x, h)
                if n <= math.floor(len(x) * p.max_edit + 1e-9):
                    want[d, i] = n
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.matches(df, bench, p).collect()}
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got) and len(got) >= 0.97 * len(want) > 60
    assert {r.doc_id for r in decontaminate.clean(df, bench, p).collect()} == set(range(len(texts))) - {d for d, _ in got}
    assert decontaminate.matches(df, bench.limit(0)).count() == 0 and decontaminate.clean(df, bench.limit(0)).count() == len(texts)
    blocks = decontaminate.matches(df, bench, decontaminate.Search(block_items=7))
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} >= {k for k, n in want.items() if n == 0}


def test_katz_equals_direct_computation(spark, monkeypatch):
    monkeypatch.setattr(katz, "BUCKET_BYTES", 60_000)
    monkeypatch.setattr(katz, "HELD_TOKENS", 30_000)
    monkeypatch.setattr(katz, "FILES", 3)
    monkeypatch.setattr(katz, "BUCKETS_OF_FILE", 4)
    monkeypatch.setattr(katz, "FREQUENT", (200, 200))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 4, "the the the"), (10**6 + 5, "hot pair " * 9000), (10**6 + 6, "Hot unseen" * 3), (10**6 + 7, "one"), (10**6 + 7, "one")], "doc_id long, text string"))
    docs = docs.withColumns({"w": docs.doc_id, "grp": docs.doc_id, "kind": docs.text})
    got = {r.doc_id: r for r in katz.scored(docs.withColumn("held_out", language_id.held_out(docs.doc_id, 5, 1))).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = {r.doc_id: [*W.findall((r.text or "").translate(lower)), None] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in text}
    one, two, before = collections.Counter(), collections.Counter(), collections.Counter()
    for i, w in [*text.items(), (10**6 + 7, text[10**6 + 7])]:  # repeated rows each count
        if not held[i]:
            one.update(w)
            for v, x in zip(["<s>", *w], w):
                two[v, x] += 1
                before[v] += 1
    total = sum(one.values())
    of = lambda c: np.array([sum(n == r for n in c.values()) for r in range(1, katz.K + 2)])
    d1, d2 = katz.good_turing(of(one)), katz.good_turing(of(two))
    cut = lambda c, d: float(katz.discounted(np.array([c]), d)[0])
    p = {w: cut(c, d1) / total for w, c in one.items()}
    unknown = 1 - sum(p.values())
    left, seen = collections.Counter(), collections.Counter()
    for (v, w), c in two.items():
        left[v] += (c - cut(c, d2)) / before[v]
        seen[v] += p[w]
    for i, w in text.items():
        score = base = 0.0
        for v, x in zip(["<s>", *w], w):
            base += math.log10((one[x] + 0.5) / (total + 0.5 * (len(one) + 1)))
            if (v, x) in two:
                score += math.log10(cut(two[v, x], d2) / before[v])
            else:
                score += math.log10(p.get(x, unknown)) + (math.log10(left[v] / (1 - seen[v])) if v in before else 0)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.held_out, r.train_tokens) == (len(w), sum(one[x] > 0 for x in w), held[i], total)
        assert abs(r.base_score - base) <= 1e-11 * abs(base) and abs(r.score - score) <= 1e-11 * abs(score)
    v = "the"
    assert abs(sum(cut(two[v, w], d2) / before[v] if (v, w) in two else left[v] / (1 - seen[v]) * p[w] for w in one) + left[v] / (1 - seen[v]) * unknown - 1) < 1e-9
    assert katz.scored(docs.limit(0).withColumn("held_out", docs.doc_id > 0)).count() == 0
    none = katz.scored(docs.limit(3).withColumn("held_out", docs.doc_id >= 0)).collect()
    assert all(r.score == 0 and r.train_tokens == 0 for r in none)
