import random

from echoframe.operators import matching, series, trains
from echoframe.params import Fusion, Trains


def test_anchor_groups_are_not_sessions(spark):
    df = spark.createDataFrame([(1, i, float(t), c) for i, (t, c) in enumerate([(0, 1.0), (8, 2.0), (12, 3.0), (30, 1.0)])], "src int, idx int, t double, v double")
    got = sorted(r.idx for r in series.refractory(df, "t", "v", ["src"], ["t", "idx"], 10.0).collect())
    assert got == [1, 2, 3]


def greedy(rows, period):
    kept, anchor = [], None
    for t, i, v in sorted(rows):
        if anchor is not None and t - anchor < period:
            if v > kept[-1][2]:
                kept[-1] = (t, i, v)
        else:
            anchor = t
            kept.append((t, i, v))
    return {i for _, i, _ in kept}


def suppress(rows, width):
    kept = []
    for t, i, v in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if all(abs(t - k) >= width for k, _ in kept):
            kept.append((t, i))
    return {i for _, i in kept}


def test_merge_and_suppression_equal_plain_loops(spark):
    rng = random.Random(5)
    rows = [(s, i, float(rng.randrange(200)), float(rng.randrange(5))) for i, s in enumerate([0, 1, 2] * 60)]
    df = spark.createDataFrame(rows, "src int, idx int, t double, v double").repartition(3)
    merged = {r.idx for r in series.refractory(df, "t", "v", ["src"], ["t", "idx"], 7.0).collect()}
    alone = {r.idx for r in series.suppressed(df, "t", "v", ["src"], ["t", "idx"], 7.0).collect()}
    by = {s: [(t, i, v) for q, i, t, v in rows if q == s] for s in (0, 1, 2)}
    assert merged == set().union(*(greedy(x, 7.0) for x in by.values()))
    assert alone == set().union(*(suppress(x, 7.0) for x in by.values()))


def test_islands_in_small_buckets(spark, monkeypatch):
    """Groups that go through many buckets of time, and sources with one row."""
    monkeypatch.setattr(series, "BUCKET_GAPS", 2)
    rng = random.Random(6)
    rows = [(s, i, float(rng.randrange(900)), float(rng.randrange(5))) for i, s in enumerate([0, 0, 0, 1, 2] * 120)] + [(9, 5000, 3.0, 1.0), (10, 5001, None, 1.0)]
    df = spark.createDataFrame(rows, "src int, idx int, t double, v double").repartition(3)
    by = {s: [(t, i, v) for q, i, t, v in rows if q == s and t is not None] for s in (0, 1, 2, 9)}
    for period in (2.0, 5.0):
        assert {r.idx for r in series.refractory(df, "t", "v", ["src"], ["t", "idx"], period).collect()} == set().union(*(greedy(x, period) for x in by.values()))
        assert {r.idx for r in series.suppressed(df, "t", "v", ["src"], ["t", "idx"], period).collect()} == set().union(*(suppress(x, period) for x in by.values()))
    assert series.refractory(df.limit(0), "t", "v", ["src"], ["t", "idx"], 2.0).count() == 0


def test_a_dense_recording_takes_time_in_proportion(spark):
    df = spark.range(400_000).selectExpr("1 as src", "id as idx", "id * 0.5 as t", "cast(id % 7 as double) as v")
    assert series.refractory(df, "t", "v", ["src"], ["t", "idx"], 10.0).count() == 20_000
    assert series.suppressed(df, "t", "v", ["src"], ["t", "idx"], 10.0).count() > 15_000


def test_train_bounds_are_inclusive(spark):
    gaps = [0, 5.0, 150.0, 4.99, 5.0, 150.01, 200.0]
    t, rows = 0.0, []
    for i, g in enumerate(gaps):
        t = round(t + g, 2)
        rows.append((1, i, t, 0.9))
    df = spark.createDataFrame(rows, "src int, idx int, t double, v double")
    got = {r.idx: r.train_id for r in trains.build_trains(df, "t", ["src"], ["t", "idx"], Trains(4.995, 150.005, 2)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: None, 6: None}


def test_fusion_reasons(spark):
    rows = [(1, i, i * 0.02, s) for i, s in enumerate([0.99, 0.7, 0.5])] + [(1, 10, 9.0, 0.7)] + [(1, 20 + i, 20 + i * 0.05, 0.9) for i in range(2)] + [(1, 30 + i, 30 + i * 0.1, 0.7) for i in range(2)]
    df = trains.build_trains(spark.createDataFrame(rows, "src int, idx int, t double, v double"), "t", ["src"], ["t", "idx"], Trains())
    got = {r.idx: r.reason for r in trains.fused(df, "t", "v", ["src"], Fusion()).collect()}
    assert got[0] == "high_confidence_direct" and got[1] == "medium_confidence_consistent_train" and got[2] == "low_confidence_reject"
    assert got[10] == "medium_confidence_not_in_train" and got[20] == "medium_confidence_consistent_doublet" and got[30] == "medium_confidence_inconsistent_doublet"
    empty = trains.fusion_summary(trains.fused(df.limit(0), "t", "v", ["src"], Fusion()), "v", ["src"], Fusion()).first()
    assert empty.total == 0 and empty.n_trains == 0


def test_matching_tries_only_the_nearest(spark):
    rng = random.Random(2)
    pred = [(0, i, rng.randrange(300) / 10) for i in range(60)]
    truth = [(0, i, rng.randrange(300) / 10) for i in range(40)]
    p = spark.createDataFrame(pred, "src int, pid int, t double")
    g = spark.createDataFrame(truth, "src int, gid int, g double")
    used, want = set(), set()
    for _, i, t in pred:
        near = min(truth, key=lambda x: (abs(x[2] - t), x[1]))
        if abs(near[2] - t) <= 0.5 and near[1] not in used:
            used.add(near[1])
            want.add((i, near[1]))
    got = {(r.pid, r.gid) for r in matching.event_matches(p, g, ["src"], 0.5).collect()}
    assert got == want
    m = matching.event_metrics(p.limit(0), g, ["src"], 0.5).first()
    assert (m.tp, m.fp, m.fn, m.f1) == (0, 0, 40, 0.0)


def test_chunks_cover_and_stop(spark):
    df = spark.createDataFrame([(0, 0), (1, 5), (2, 10), (3, 11), (4, 28)], "id int, n long")
    got = {}
    for r in series.chunk_ranges(df, "n", 10, 2).collect():
        got.setdefault(r.id, []).append((r.start_sample, r.end_sample))
    assert got == {1: [(0, 5)], 2: [(0, 10)], 3: [(0, 10), (8, 11)], 4: [(0, 10), (8, 18), (16, 26), (24, 28)]}


def test_spaced_peaks_equal_a_plain_loop(spark):
    rng = random.Random(7)
    rows = [(s, i, rng.randrange(10) / 2) for s in (0, 1) for i in range(150)]
    df = spark.createDataFrame(rows, "src int, idx int, v double")
    want = set()
    for s in (0, 1):
        v = [x for q, _, x in rows if q == s]
        i = 0
        while i < len(v):
            if v[i] > 2:
                e = i
                while e < len(v) and v[e] > 2:
                    e += 1
                want.add((s, max(range(i, e), key=lambda k: (v[k], -k))))
                i = e + 3
            else:
                i += 1
    assert {(r.src, r.peak_pos) for r in series.spaced_peaks(df, "v", ["src"], ["idx"], 2.0, 3).collect()} == want


def test_emphasis_is_undone_and_capacity_told(spark):
    from echoframe.functions import waves
    from echoframe.operators import datasets

    x = [0.5, -1.0, 2.0, 0.25]
    df = spark.createDataFrame([(x, [])], "x array<double>, e array<double>")
    got = df.select(waves.de_emphasis(waves.pre_emphasis(df.x)).alias("y"), waves.de_emphasis(df.e).alias("e")).first()
    assert all(abs(a - b) < 1e-12 for a, b in zip(got.y, x)) and got.e == []
    clean = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "p string, id int")
    got = {r.p: (r.wanted, r.available, r.reuse) for r in datasets.capacity(clean, clean.where("id > 1"), ["p"]).collect()}
    assert got == {"a": (4, 1, True), "b": (2, 1, True)}
    assert datasets.strategy(clean, 1, 0.7, "id").where("strategy is null").count() == 0
