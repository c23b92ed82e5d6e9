import pyarrow as pa
import public_tokenizers as P

import corpus_pipeline
from echoframe.llm import bpe, decontaminate, minhash, queries, secret_scan

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    judged = {r.doc_id: r.kept for r in queries.op1_quality_rules(spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if judged[r.doc_id]}
    runs = {i: minhash.runs_of(t, 5) for i, t in docs.items()}
    label = {i: i for i in docs}
    for a in sorted(docs):
        for b in sorted(docs):
            if a < b and label[a] != label[b] and minhash.similarity(runs[a], runs[b]) >= 0.8:
                lo, hi = sorted((label[a], label[b]))
                label = {i: lo if x == hi else x for i, x in label.items()}
    docs = {i: t for i, t in docs.items() if label[i] == i}
    p = decontaminate.Search()
    items = decontaminate.item_words(spark.read.parquet(f"{SF}/benchmark.parquet"), "item_id", "text")
    import numpy as np

    index = [np.array(w, np.uint64) for _, w in items]
    clean = {}
    for i, t in docs.items():
        h, _ = decontaminate.words(pa.array([t], pa.string()))
        if not any(np.isin(w, h).sum() >= len(w) - int(len(w) * p.max_edit) and decontaminate.edit_distance(w, h)[0] <= int(len(w) * p.max_edit) for w in index):
            clean[i] = t
    import re
    from collections import Counter

    near = Counter(p for t in clean.values() for run in re.findall(r"[A-Za-z0-9+/_-]+", t) if len(run) < secret_scan.LEAST for p in zip(run, run[1:]))
    null = secret_scan.Ordinary(np.array([[near[a, b] for b in secret_scan.CHARACTERS] for a in secret_scan.CHARACTERS]))
    found = [(e - s, null.evidence(t[s:e])) for t in clean.values() for s, e in secret_scan.candidates(t)]
    mean = sum(n for n, _ in found) / len(found) if found else 1.0
    ps = sorted(secret_scan.weighted_p(n, k, mean) for n, k in found)
    cut = secret_scan.Cut(max((p for j, p in enumerate(ps, 1) if p <= secret_scan.FDR * j / len(ps)), default=-1.0), mean, null)
    clean = {i: secret_scan.redact(t, cut) for i, t in clean.items()}
    enc = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(clean) and 0 < len(got) < len(judged)
    assert all(got[i].ids == enc.encode_ordinary(t) for i, t in clean.items())


def test_stages_return_document_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "near duplicates" and len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(40), SF)
        assert out.columns == docs.columns and out.count() <= 40
    assert corpus_pipeline.STAGES[3][1](spark, docs, SF).count() == docs.count()


def test_op1_equals_its_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = c.execute(queries.ORACLES["op1_quality_rules"]).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.op1_quality_rules(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    for n in want.columns:
        assert ((got[n] - want[n]).abs() < 1e-8).all() if n == "host_rate" else (got[n] == want[n]).all(), n


def test_nothing_but_the_last_stage_s_input_is_left(spark):
    from echoframe.llm import scratch

    start = len(scratch._OPENED)
    out = corpus_pipeline.run(spark, SF)
    left = [p for p in scratch._OPENED[start:] if spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
    assert len(left) == 1 and "pipeline-secret-scans" in left[0] and out.count() > 0
