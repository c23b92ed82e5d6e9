import random

import numpy as np
from pyspark.sql import functions as F

from echoframe.operators import checks, datasets, matching, metrics
from echoframe.plans import catalog


def test_quantiles_equal_numpy(spark):
    rng = random.Random(1)
    rows = [(p, rng.choice([float(rng.randrange(9)), rng.gauss(0, 1e6), rng.random() * 1e-9])) for p in ("a", "b") for _ in range(3000)] + [("c", 5.0), ("c", None), ("d", 1.0), ("d", 2.0), (None, 1.0), (None, 4.0)]
    probs = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q9": 0.93, "q10": 1.0}
    got = {r.p: r for r in metrics.quantiles(spark.createDataFrame(rows, "p string, v double"), "v", ["p"], probs).collect()}
    for p in (*"abcd", None):
        x = np.array([v for q, v in rows if q == p and v is not None])
        for n, share in probs.items():
            assert np.isclose(got[p][n], np.quantile(x, share), rtol=1e-12, atol=1e-12), (p, n)


def test_curves_at_any_scale(spark):
    rng = random.Random(2)
    for scale in (1.0, 1e-7, 1e9):
        rows = [(i, int(rng.random() < 0.4), round(rng.random(), 2) * scale) for i in range(3000)]
        df = spark.createDataFrame(rows, "id int, y int, s double")
        pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
        want = sum((np.array(neg) < p).sum() + 0.5 * (np.array(neg) == p).sum() for p in pos) / len(pos) / len(neg)
        assert abs(metrics.roc_auc(df, "y", "s").first()[0] - want) < 1e-9
        r0, p0, area = 0.0, 1.0, 0.0
        for t in sorted({s for *_, s in rows}, reverse=True):
            tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
            area += (tp / len(pos) - r0) * (tp / (tp + fp) + p0) / 2
            r0, p0 = tp / len(pos), tp / (tp + fp)
        assert abs(metrics.pr_auc(df, "y", "s").first()[0] - area) < 1e-9


def test_ranks_of_large_and_null_parts(spark):
    rows = [(i, None if i % 10 == 0 else i % 3) for i in range(3000)]
    got = datasets.ranked(spark.createDataFrame(rows, "id int, p int"), ["p"], 4, "id").collect()
    for p in (None, 0, 1, 2):
        own = sorted(r._r for r in got if r.p == p)
        assert own == list(range(len(own))) and all(r._n == len(own) for r in got if r.p == p) and len(own) == sum(q == p for _, q in rows)


def test_greedy_matching_equals_a_plain_loop(spark):
    rng = random.Random(3)
    span = lambda: (a := rng.random() * 300, a + rng.random() * 20)
    p, g = [(s, i, *span()) for s in (1, 2) for i in range(60)], [(s, i, *span()) for s in (1, 2) for i in range(60)]
    pairs = matching.overlap_pairs(spark.createDataFrame(p, "src int, pid int, s double, e double"), spark.createDataFrame(g, "src int, gid int, gs double, ge double"), ["src"], 7.0)
    want = set()
    for s in (1, 2):
        taken = set()
        for _, i, a, b in [x for x in p if x[0] == s]:
            best = []
            for _, j, c, d in [x for x in g if x[0] == s]:
                o = max(0.0, min(b, d) - max(a, c)) / min(b - a, d - c)
                if o >= 0.5 and j not in taken:
                    best.append((-o, j))
            if best:
                taken.add(min(best)[1])
                want.add((s, i, min(best)[1]))
    assert {(r.src, r.pid, r.gid) for r in matching.train_matches(pairs, ["src"]).collect()} == want


def most_read(spark, query):
    """The rows of ``query()`` and the most rows that one of its stages read from shuffles."""
    context = spark.sparkContext
    no_quantiles, no_states = context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList()

    def stages():
        context._jsc.sc().listenerBus().waitUntilEmpty(10000)
        found = context._jsc.sc().statusStore().stageList(None, False, False, no_quantiles, no_states)
        return {(s := found.apply(i)).stageId(): s.shuffleReadRecords() for i in range(found.size())}

    known, rows = stages(), query()
    return rows, max(n for i, n in stages().items() if i not in known)


def test_no_stage_reads_the_samples_of_all_signals(spark):
    """values are nearly all distinct, so collapsing them holds them all; only those by the median may move."""
    x = np.random.default_rng(4).normal(size=(400, 100))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(8)
    (s,), most = most_read(spark, checks.sample_stats(df, "x").collect)
    assert np.allclose((s.n, s.min, s.max, s.mean, s.std, s.median), (x.size, x.min(), x.max(), x.mean(), x.std(), np.median(x)), rtol=1e-12, atol=1e-12)
    assert most < x.size / 20


def test_quantiles_move_few_rows_of_any_part(spark, monkeypatch):
    """a part of distinct values, one where most are equal, one of few values, and one of null keys."""
    rng = np.random.default_rng(5)
    own = {"a": rng.normal(size=30000), "b": np.where(rng.random(30000) < 0.7, 2.5, rng.normal(size=30000) + 2.5), "c": rng.integers(0, 4, 20000) * 1.0, None: rng.random(20000)}
    df = spark.createDataFrame([(p, float(v)) for p, x in own.items() for v in x], "p string, v double").repartition(8).localCheckpoint()
    probs = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q10": 1.0}
    for parts in (metrics.PARTS, 0):  # bounds sent to all tasks, or joined by shuffles
        monkeypatch.setattr(metrics, "PARTS", parts)
        rows, most = most_read(spark, lambda: metrics.quantiles(df, "v", ["p"], probs).collect())
        assert {r.p for r in rows} == set(own) and len(rows) == 4
        for r in rows:
            assert np.allclose([r[n] for n in probs], np.quantile(own[r.p], list(probs.values())), rtol=1e-12, atol=1e-12), r.p
        assert not parts or most < 100000 / 20


def test_dataset_describe_moves_few_prices(spark, tmp_path):
    """the query itself, over prices that are all distinct."""
    rng = np.random.default_rng(6)
    own = {flag: rng.permutation(40000) * 0.25 + k * 0.0625 for k, flag in enumerate("ANR")}
    rows = [(flag, float(v)) for flag, x in own.items() for v in x]
    spark.createDataFrame(rows, "l_returnflag string, l_extendedprice double").repartition(4).write.parquet(f"{tmp_path}/lineitem.parquet")
    found, most = most_read(spark, catalog.QUERIES["dataset_describe"](spark, str(tmp_path)).collect)
    for r in found:
        x = own.pop(r.l_returnflag)
        assert np.allclose([r.n, r.mean, r.std, r.min, r.q25, r.q50, r.q75, r.max], [x.size, x.mean(), x.std(ddof=1), *np.quantile(x, [0, 0.25, 0.5, 0.75, 1])], rtol=0, atol=1e-4), r
    assert not own and most < len(rows) / 20


def test_sketches_of_many_tasks_merge_in_little_time(spark):
    """each part's sketches meet in one task, which held the values of all of them and copied them at each merge."""
    context = spark.sparkContext
    store, no_quantiles, no_states = context._jsc.sc().statusStore(), context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList()

    def times():
        context._jsc.sc().listenerBus().waitUntilEmpty(10000)
        found = store.stageList(None, False, False, no_quantiles, no_states)
        return {(s := found.apply(i)).stageId(): (s.numTasks(), s.executorRunTime()) for i in range(found.size())}

    n, tasks = 4000000, 160
    df = spark.range(0, n, 1, tasks).select(F.lit(1).alias("k"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    known = times()
    (r,) = metrics.quantiles(df, "v", ["k"], {"q25": 0.25, "q50": 0.5}).collect()
    took = [x for i, x in times().items() if i not in known]
    assert (r.q25, r.q50) == ((n - 1) * 0.25, (n - 1) * 0.5)
    assert max(ms / m for m, ms in took) < sum(ms for _, ms in took) / 4


def test_quantiles_of_values_that_are_no_numbers_or_infinite(spark):
    """a sketch takes no NaN; NaN is the largest value, as in Spark's order."""
    nan, inf = float("nan"), float("inf")
    own = {"a": [nan] * 3, "b": [1.0, nan, 2.0, nan, 3.0], "c": [-inf, 1.0, 2.0, 3.0, inf], None: [4.0]}
    df = spark.createDataFrame([(p, v) for p, x in own.items() for v in x] + [("a", None), ("d", None)], "p string, v double")
    found = {r.p: (r.q25, r.q50) for r in metrics.quantiles(df, "v", ["p"], {"q25": 0.25, "q50": 0.5}).collect()}
    assert set(found) == set(own) and np.isnan(found["a"]).all()
    assert (found["b"], found["c"], found[None]) == ((2.0, 3.0), (1.0, 2.0), (4.0, 4.0))
