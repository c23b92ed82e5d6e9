"""Queries over the event stream: series, candidates, trains, fusion, matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import matching as M
from ..operators import metrics
from ..operators import series as R
from ..operators import trains as T
from ..operators.detect import fits, passes
from ..params import Detection, Fusion, Trains
from ..stages import cut
from .base import CLICKS, QUARTILES, clicks, table

WEEK = 604800.0
REFRACTORY = 3600.0
TRAINS = Trains(600.0, 43200.0, 2)
FUSION = Fusion(high=0.9, medium=0.3, max_cv=0.6, doublet_ici_ms=(3600.0, 30000.0), doublet_confidence=0.5)
ORDER = ["t", "idx"]
r6 = lambda c: F.round(F.col(c), 6).alias(c)

Z = f""", weeks AS (SELECT *, CAST(floor(t / {WEEK}) AS BIGINT) AS chunk FROM clicks),
m AS (SELECT src, chunk, median(v) AS m FROM weeks GROUP BY ALL),
d AS (SELECT w.src, w.chunk, any_value(m.m) AS m, median(abs(v - m.m)) AS d FROM weeks w JOIN m USING (src, chunk) GROUP BY ALL),
zs AS (SELECT w.*, CASE WHEN d.d > 0 THEN (v - d.m) / (1.4826 * d.d) ELSE 0.0 END AS z FROM weeks w JOIN d USING (src, chunk))"""


def z_scores(spark, sf):
    df = clicks(spark, sf).withColumn("chunk", F.floor(F.col("t") / WEEK).cast("long"))
    return R.robust_z(df, "v", ["src", "chunk"])


def robust_zscore(spark, sf):
    return z_scores(spark, sf).select("idx", "src", "chunk", r6("z"))


ROBUST_Z_SQL = f"WITH {CLICKS}{Z} SELECT idx, src, chunk, round(z, 6) AS z FROM zs"


def tkeo_series(spark, sf):
    return R.tkeo(clicks(spark, sf), "v", ["src"], ORDER).select("idx", r6("tkeo"))


TKEO = """, nb AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS n FROM clicks WINDOW w AS (PARTITION BY src ORDER BY t, idx)),
tk AS (SELECT *, v * v - p * n AS tkeo FROM nb WHERE p IS NOT NULL AND n IS NOT NULL)"""


def tkeo_smooth(spark, sf):
    df = R.tkeo(clicks(spark, sf), "v", ["src"], ORDER)
    return R.smoothed(df, "tkeo", ["src"], ORDER).select("idx", r6("smooth"))


def local_peaks(spark, sf):
    df = R.local_peaks(z_scores(spark, sf), "z", ["src"], ORDER, 3.0)
    return df.select("idx", "src", r6("z"))


PEAKS = """, zn AS (SELECT *, lag(z) OVER w AS p, lead(z) OVER w AS n FROM zs WINDOW w AS (PARTITION BY src ORDER BY t, idx)),
peaks AS (SELECT * FROM zn WHERE z > 3.0 AND z > p AND z > n)"""

#: Stand-ins for the features of a candidate.
FEATURES = {
    "tkeo_z": "z",
    "ste_z": "z * 0.8",
    "hfc_z": "k / 10",
    "high_low": "k / 50",
    "width": "k / 60",
    "centroid": "v * 1000",
}


def features(df):
    return df.withColumns({n: F.expr(f"CAST({e} AS DOUBLE)") for n, e in FEATURES.items()})


FEATURES_SQL = ", f AS (SELECT *, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in FEATURES.items()) + " FROM zs)"


def rule_filter(spark, sf):
    """The detector's own rules, with lower thresholds for two of the stand-ins."""
    f = features(z_scores(spark, sf))
    c = {n: F.col(n) for n in FEATURES}
    p = Detection(tkeo_z=1.0, ste_z=1.0)
    kept = f.where(passes(c, p) & fits(c["width"], p))
    return kept.select("idx", F.round(S.rule_confidence(c["tkeo_z"], c["ste_z"], c["hfc_z"], c["high_low"], c["width"]), 6).alias("confidence"))


CONFIDENCE = "0.3 * least(1, tkeo_z / 10) + 0.25 * least(1, ste_z / 10) + 0.2 * least(1, hfc_z / 8) + 0.15 * least(1, high_low / 2) + 0.1 * least(1, greatest(0, 1 - abs(width - 0.8)))"
RULE_SQL = f"""WITH {CLICKS}{Z}{FEATURES_SQL} SELECT idx, round({CONFIDENCE}, 6) AS confidence FROM f
WHERE tkeo_z > 1 AND ste_z >= 1 AND (hfc_z >= 4 OR high_low >= 1.2) AND width BETWEEN 0.2 AND 1.8 AND centroid >= 8500"""


def rule_confidence(spark, sf):
    f = features(z_scores(spark, sf))
    return f.select("idx", F.round(S.rule_confidence(*[F.col(n) for n in ("tkeo_z", "ste_z", "hfc_z", "high_low", "width")]), 6).alias("confidence"))


#: Stand-ins for transient features.
TRANSIENT = {
    "peak_sharpness": "k / 4",
    "attack_time_ms": "v / 2",
    "energy_concentration": "k / 100",
    "envelope_symmetry": "v / 10",
    "spectral_centroid": "v * 1500",
    "high_low_ratio": "k / 40",
    "rise_slope": "v / 40",
}


def likelihood_score(spark, sf):
    cols = {n: F.expr(e) for n, e in TRANSIENT.items()}
    return clicks(spark, sf).select("idx", F.round(S.likelihood(cols), 6).alias("likelihood"), F.round(S.likelihood(cols, S.TRANSIENT_ONLY), 6).alias("transient_likelihood"))


def _ladder(names):
    def case(n):
        e = f"({TRANSIENT[n]})"
        holds = {">": lambda a: f"{e} > {a}", "<": lambda a: f"{e} < {a}", "in": lambda a: f"{e} BETWEEN {a[0]} AND {a[1]}"}
        return "CASE " + " ".join(f"WHEN {holds[op](a)} THEN CAST({f} AS DOUBLE)" for op, a, f in S.LIKELIHOOD_STEPS[n]) + " ELSE 1.0 END"

    return f"greatest(0.1, least(2.0, {' * '.join(map(case, names))}))"


LIKELIHOOD_SQL = f"WITH {CLICKS} SELECT idx, round({_ladder(S.WITH_SPECTRUM)}, 6) AS likelihood, round({_ladder(S.TRANSIENT_ONLY)}, 6) AS transient_likelihood FROM clicks"


def event_quality(spark, sf):
    q = S.event_quality(F.col("v"), F.col("k") / 40, F.col("k") / 60, F.col("v") * 1000, F.col("k") / 50)
    return clicks(spark, sf).select("idx", F.round(q, 6).alias("quality"))


_clip = lambda e: f"greatest(0, least(1, {e}))"
QUALITY_SQL = f"""WITH {CLICKS} SELECT idx, round(0.25 * {_clip('(v - 10) / 20')} + 0.25 * {_clip('k / 40 / 3')} + 0.2 * (1 - {_clip('abs(k / 60 - 0.8) / 1.5')})
 + 0.15 * {_clip('(v * 1000 - 5000) / 10000')} + 0.15 * {_clip('k / 50 / 2')}, 6) AS quality FROM clicks"""


def greedy(source: str, period: float, t: str = "t") -> str:
    """Anchor groups by recursion over each source's rows."""
    return f""", o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY t, idx) AS rn FROM {source}),
 g AS (SELECT src, rn, {t} AS tt, {t} AS anchor FROM o WHERE rn = 1 UNION ALL
  SELECT o.src, o.rn, o.{t}, CASE WHEN o.{t} - g.anchor < {period} THEN g.anchor ELSE o.{t} END FROM g JOIN o ON o.src = g.src AND o.rn = g.rn + 1),
 kept AS (SELECT arg_max(o.idx, (o.v, -o.rn)) AS idx, max(o.v) AS v, src FROM o JOIN g USING (src, rn) GROUP BY src, g.anchor)"""


def refractory_merge(spark, sf):
    return R.refractory(clicks(spark, sf), "t", "v", ["src"], ORDER, REFRACTORY).select("idx", "src", "v")


REFRACTORY_SQL = f"WITH RECURSIVE {CLICKS}{greedy('clicks', REFRACTORY)} SELECT idx, src, v FROM kept"


def chunk_dedup(spark, sf):
    """Detections of overlapping chunks: those in an overlap come twice, the second time with more confidence."""
    c = clicks(spark, sf).select("src", "idx", "t", "v")
    again = c.where(F.col("idx") % 3 == 0).select("src", (F.col("idx") + 10_000_000).alias("idx"), (F.col("t") + 2.0).alias("t"), (F.col("v") * 1.5).alias("v"))
    return R.refractory(c.unionByName(again), "t", "v", ["src"], ORDER, 10.0).select("idx", "src", F.round("v", 6).alias("v"))


DEDUP_SQL = f"""WITH RECURSIVE {CLICKS}, u AS (SELECT src, idx, t, v FROM clicks UNION ALL SELECT src, idx + 10000000, t + 2.0, v * 1.5 FROM clicks WHERE idx % 3 = 0)
{greedy('u', 10.0)} SELECT idx, src, round(v, 6) AS v FROM kept"""


def peak_merge_samples(spark, sf):
    """The same merge over whole sample numbers."""
    c = clicks(spark, sf).withColumn("sample", F.floor("t").cast("long"))
    return R.refractory(c, "sample", "v", ["src"], ["t", "idx"], 7200).select("idx", "src", "sample")


MERGE_SQL = f"""WITH RECURSIVE {CLICKS}, s AS (SELECT *, CAST(floor(t) AS BIGINT) AS sample FROM clicks){greedy('s', 7200, 'sample')}
SELECT kept.idx, kept.src, s.sample FROM kept JOIN s USING (idx)"""


def nms_suppress(spark, sf):
    return R.suppressed(clicks(spark, sf), "t", "v", ["src"], ORDER, REFRACTORY).select("idx", "src")


#: By falling score, with the times of the rows that stay.
NMS_SQL = f"""WITH RECURSIVE {CLICKS}, o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY v DESC, t, idx) AS rn FROM clicks),
w AS (SELECT src, rn, true AS stays, [t] AS kept FROM o WHERE rn = 1 UNION ALL
 SELECT o.src, o.rn, len(list_filter(w.kept, lambda x: abs(x - o.t) < {REFRACTORY})) = 0,
  CASE WHEN len(list_filter(w.kept, lambda x: abs(x - o.t) < {REFRACTORY})) = 0 THEN list_append(w.kept, o.t) ELSE w.kept END FROM w JOIN o ON o.src = w.src AND o.rn = w.rn + 1)
SELECT o.idx, o.src FROM o JOIN w USING (src, rn) WHERE stays"""


def threshold_runs(spark, sf):
    return R.threshold_runs(clicks(spark, sf), "v", ["src"], ORDER, 10.0)


RUNS_SQL = f"""WITH {CLICKS}, p AS (SELECT src, v, row_number() OVER (PARTITION BY src ORDER BY t, idx) - 1 AS pos FROM clicks),
a AS (SELECT *, pos - row_number() OVER (PARTITION BY src ORDER BY pos) AS run FROM p WHERE v > 10.0)
SELECT src, min(pos) AS start_pos, max(pos) AS end_pos, count(*) AS n_rows, arg_max(pos, (v, -pos)) AS peak_pos FROM a GROUP BY src, run"""


def trained(spark, sf):
    return T.build_trains(clicks(spark, sf).withColumn("conf", F.least(F.lit(1.0), F.col("v") / 20)), "t", ["src"], ORDER, TRAINS)


TRAIN_SQL = f""", c AS (SELECT *, least(1.0, v / 20) AS conf, t - lag(t) OVER w AS gap FROM clicks WINDOW w AS (PARTITION BY src ORDER BY t, idx)),
n AS (SELECT *, CASE WHEN gap BETWEEN {TRAINS.min_ici} AND {TRAINS.max_ici} THEN 0 ELSE 1 END AS new FROM c),
gr AS (SELECT *, sum(new) OVER (PARTITION BY src ORDER BY t, idx ROWS UNBOUNDED PRECEDING) AS grp FROM n),
sz AS (SELECT *, count(*) OVER (PARTITION BY src, grp) AS size FROM gr),
tr AS (SELECT *, CASE WHEN size >= {TRAINS.min_clicks} THEN sum(CASE WHEN new = 1 AND size >= {TRAINS.min_clicks} THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY t, idx ROWS UNBOUNDED PRECEDING) - 1 END AS train_id,
  CASE WHEN new = 0 THEN gap END AS ici FROM sz)"""
STATS_SQL = TRAIN_SQL + """, st AS (SELECT src, CAST(train_id AS BIGINT) AS train_id, min(t) AS start_time, max(t) AS end_time, max(t) - min(t) AS duration, count(*) AS n_clicks,
 median(ici) AS ici_median, avg(ici) AS ici_mean, stddev_pop(ici) AS ici_std, min(ici) AS ici_min, max(ici) AS ici_max, avg(conf) AS mean_confidence,
 CASE WHEN avg(ici) > 0 THEN stddev_pop(ici) / avg(ici) ELSE 0 END AS ici_cv FROM tr WHERE train_id IS NOT NULL GROUP BY src, train_id)"""
STATS = ["start_time", "end_time", "duration", "ici_median", "ici_mean", "ici_std", "ici_min", "ici_max", "mean_confidence", "ici_cv"]
#: Means are rounded, as sums may come in any order; what is picked or subtracted is the same double everywhere.
MEANS = ["ici_mean", "ici_std", "mean_confidence", "ici_cv"]
_rounded = ", ".join(f"round({c}, 6) AS {c}" if c in MEANS else c for c in STATS)


def build_trains(spark, sf):
    return trained(spark, sf).select("idx", "src", "train_id", "ici")


def train_stats(spark, sf):
    s = T.train_stats(trained(spark, sf), "t", "conf", ["src"])
    return s.select("src", F.col("train_id").cast("long").alias("train_id"), "n_clicks", *[F.round(c, 6).alias(c) if c in MEANS else F.col(c) for c in STATS])


def filter_trains(spark, sf):
    s = T.train_stats(trained(spark, sf), "t", "conf", ["src"])
    return s.where(T.consistent(Fusion(min_clicks=3, max_cv=0.6))).select("src", "train_id", "n_clicks")


def doublets(spark, sf):
    s = T.train_stats(trained(spark, sf), "t", "conf", ["src"])
    return s.where(T.doublet(FUSION, F.col("mean_confidence"), 1.0)).select("src", "train_id", F.round("mean_confidence", 6).alias("mean_confidence"))


def fusion_decisions(spark, sf):
    return T.fused(trained(spark, sf), "t", "conf", ["src"], FUSION, 1.0).select("idx", "train_id", "reason", "accept")


FUSED_SQL = STATS_SQL + f""", fu AS (SELECT tr.idx, tr.conf, tr.src, tr.train_id, CASE WHEN conf >= {FUSION.high} THEN 'high_confidence_direct' WHEN conf < {FUSION.medium} THEN 'low_confidence_reject'
 WHEN tr.train_id IS NULL THEN 'medium_confidence_not_in_train' WHEN n_clicks >= {FUSION.min_clicks} AND ici_cv <= {FUSION.max_cv} THEN 'medium_confidence_consistent_train'
 WHEN n_clicks = 2 AND ici_median BETWEEN {FUSION.doublet_ici_ms[0]} AND {FUSION.doublet_ici_ms[1]} AND conf >= {FUSION.doublet_confidence} THEN 'medium_confidence_consistent_doublet'
 WHEN n_clicks = 2 THEN 'medium_confidence_inconsistent_doublet' ELSE 'medium_confidence_inconsistent_train' END AS reason
 FROM tr LEFT JOIN st ON tr.src = st.src AND tr.train_id = st.train_id),
fd AS (SELECT *, reason IN ({', '.join(repr(x) for x in T.ACCEPTING)}) AS accept FROM fu)"""


def fusion_summary(spark, sf):
    return T.fusion_summary(T.fused(trained(spark, sf), "t", "conf", ["src"], FUSION, 1.0), "conf", ["src"], FUSION)


SUMMARY_SQL = f"""WITH {CLICKS}{FUSED_SQL} SELECT count(*) AS total, count(*) FILTER (accept) AS accepted, count(*) FILTER (NOT accept) AS rejected,
 count(*) FILTER (conf >= {FUSION.high}) AS high_confidence, count(*) FILTER (conf >= {FUSION.medium} AND conf < {FUSION.high}) AS medium_confidence,
 count(*) FILTER (conf < {FUSION.medium}) AS low_confidence, count(DISTINCT CASE WHEN train_id IS NOT NULL THEN (src, train_id) END) AS n_trains FROM fd"""

def fusion_text(spark, sf):
    """The summary as text, one line a row."""
    out = T.fusion_text(T.fusion_summary(T.fused(trained(spark, sf), "t", "conf", ["src"], FUSION, 1.0), "conf", ["src"], FUSION))
    return out.select(F.posexplode(F.split("text", "\n")).alias("line", "text")).select(F.col("line").cast("long").alias("line"), "text")


TEXT_SQL = f"""WITH s AS ({SUMMARY_SQL}) SELECT CAST(line AS BIGINT) AS line, text FROM (SELECT 0 AS line, printf('Total candidates: %d', total) AS text FROM s UNION ALL SELECT 1, printf('Accepted: %d (%.1f%%)', accepted, 100.0 * accepted / total) FROM s
 UNION ALL SELECT 2, printf('Rejected: %d (%.1f%%)', rejected, 100.0 * rejected / total) FROM s UNION ALL SELECT 3, printf('High confidence: %d', high_confidence) FROM s UNION ALL SELECT 4, printf('Medium confidence: %d', medium_confidence) FROM s
 UNION ALL SELECT 5, printf('Low confidence: %d', low_confidence) FROM s UNION ALL SELECT 6, printf('Trains detected: %d', n_trains) FROM s)"""

TOLERANCE = 1800.0


def sides(spark, sf):
    c = clicks(spark, sf)
    return c.where("kind = 'click'").select("src", F.col("idx").alias("pid"), "t"), c.where("kind = 'view'").select("src", F.col("idx").alias("gid"), F.col("t").alias("g"))


def event_match(spark, sf):
    return M.event_matches(*sides(spark, sf), ["src"], TOLERANCE).select("src", "pid", "gid", r6("error"))


def event_metrics(spark, sf):
    out = M.event_metrics(*sides(spark, sf), ["src"], TOLERANCE)
    return out.select("tp", "fp", "fn", r6("precision"), r6("recall"), r6("f1"))


MATCH = f""", pr AS (SELECT src, idx AS pid, t FROM clicks WHERE kind = 'click'), gt AS (SELECT src, idx AS gid, t AS g FROM clicks WHERE kind = 'view'),
ne AS (SELECT src, pid, t, gid, g, row_number() OVER (PARTITION BY src, pid ORDER BY abs(t - g), gid) AS rn FROM pr JOIN gt USING (src) WHERE abs(t - g) <= {TOLERANCE}),
ma AS (SELECT *, row_number() OVER (PARTITION BY src, gid ORDER BY pid) AS first FROM ne WHERE rn = 1)"""
MATCH_SQL = f"WITH {CLICKS}{MATCH} SELECT src, pid, gid, round(abs(t - g), 6) AS error FROM ma WHERE first = 1"
MATCH_METRICS_SQL = f"""WITH {CLICKS}{MATCH}, q AS (SELECT (SELECT count(*) FROM ma WHERE first = 1) AS tp, (SELECT count(*) FROM pr) AS np, (SELECT count(*) FROM gt) AS ng),
q2 AS (SELECT tp, np - tp AS fp, ng - tp AS fn, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS p, CASE WHEN ng > 0 THEN tp / ng ELSE 0 END AS r FROM q)
SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM q2"""


def intervals(spark, sf):
    """Trains of all clicks against trains of two thirds of them."""
    stats = lambda df: T.train_stats(T.build_trains(df, "t", ["src"], ORDER, TRAINS), "t", "v", ["src"])
    c = clicks(spark, sf)
    p, g = stats(c), stats(c.where("idx % 3 <> 0"))
    return (
        p.select("src", F.col("train_id").alias("pid"), F.col("start_time").alias("s"), F.col("end_time").alias("e"), F.col("ici_median").alias("ici"), "n_clicks"),
        g.select("src", F.col("train_id").alias("gid"), F.col("start_time").alias("gs"), F.col("end_time").alias("ge"), F.col("ici_median").alias("g_ici"), F.col("n_clicks").alias("g_clicks")),
    )


def _pairs(p, g):
    return M.overlap_pairs(p, g, ["src"], 86400.0)


def train_overlap_pairs(spark, sf):
    return _pairs(*intervals(spark, sf)).select("src", F.col("pid").cast("long").alias("pid"), F.col("gid").cast("long").alias("gid"), r6("overlap"))


def _trains_of(src: str, tag: str) -> str:
    return f"""{tag}c AS (SELECT *, t - lag(t) OVER (PARTITION BY src ORDER BY t, idx) AS gap FROM {src}),
{tag}n AS (SELECT *, CASE WHEN gap BETWEEN {TRAINS.min_ici} AND {TRAINS.max_ici} THEN 0 ELSE 1 END AS new FROM {tag}c),
{tag}g AS (SELECT *, sum(new) OVER (PARTITION BY src ORDER BY t, idx ROWS UNBOUNDED PRECEDING) AS grp FROM {tag}n),
{tag}s AS (SELECT src, grp, min(t) AS s, max(t) AS e, count(*) AS n, median(CASE WHEN new = 0 THEN gap END) AS ici FROM {tag}g GROUP BY ALL HAVING count(*) >= {TRAINS.min_clicks}),
{tag} AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY s, grp) - 1 AS id, s, e, n, ici FROM {tag}s)"""


OVERLAPS = f"""{CLICKS}, two AS (SELECT * FROM clicks WHERE idx % 3 <> 0), {_trains_of('clicks', 'ap')}, {_trains_of('two', 'ag')},
ov AS (SELECT ap.src, ap.id AS pid, ag.id AS gid, CASE WHEN least(ap.e - ap.s, ag.e - ag.s) > 0 THEN greatest(0, least(ap.e, ag.e) - greatest(ap.s, ag.s)) / least(ap.e - ap.s, ag.e - ag.s) ELSE 0 END AS overlap, ap.ici AS pi, ag.ici AS gi, ap.n AS pn, ag.n AS gn FROM ap JOIN ag USING (src)),
ok AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY pid, overlap DESC, gid) AS rn FROM ov WHERE overlap >= 0.5)"""
OVERLAP_SQL = f"WITH {OVERLAPS} SELECT src, pid, gid, round(overlap, 6) AS overlap FROM ok"
#: Greedy by recursion over each source's pairs, with the last prediction that was served and the truths that are taken.
GREEDY_PAIRS = f"""{OVERLAPS}, walk AS (SELECT src, rn, true AS take, pid AS served, [gid] AS taken FROM ok WHERE rn = 1 UNION ALL
 SELECT k.src, k.rn, k.pid <> w.served AND NOT list_contains(w.taken, k.gid), CASE WHEN k.pid <> w.served AND NOT list_contains(w.taken, k.gid) THEN k.pid ELSE w.served END,
  CASE WHEN k.pid <> w.served AND NOT list_contains(w.taken, k.gid) THEN list_append(w.taken, k.gid) ELSE w.taken END FROM walk w JOIN ok k ON k.src = w.src AND k.rn = w.rn + 1),
mt AS (SELECT ok.* FROM ok JOIN walk USING (src, rn) WHERE take)"""
TRAIN_MATCH_SQL = f"WITH RECURSIVE {GREEDY_PAIRS} SELECT src, pid, gid, round(overlap, 6) AS overlap FROM mt"
TRAIN_METRICS_SQL = f"""WITH RECURSIVE {GREEDY_PAIRS}, q AS (SELECT (SELECT count(*) FROM mt) AS tp, (SELECT count(*) FROM ap) AS np, (SELECT count(*) FROM ag) AS ng,
 (SELECT coalesce(avg(abs(pi - gi)), 0) FROM mt) AS ie, (SELECT coalesce(avg(abs(pn - gn)), 0) FROM mt) AS ce),
q2 AS (SELECT *, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS p, CASE WHEN ng > 0 THEN tp / ng ELSE 0 END AS r FROM q)
SELECT tp, np - tp AS fp, ng - tp AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1,
 round(ie, 6) AS ici_error, round(ce, 6) AS count_error FROM q2"""


def train_metrics(spark, sf):
    p, g = intervals(spark, sf)
    out = M.train_metrics(M.train_matches(_pairs(p, g), ["src"]), p, g)
    return out.select("tp", "fp", "fn", r6("precision"), r6("recall"), r6("f1"), r6("ici_error"), r6("count_error"))


def train_matching(spark, sf):
    """Which train of all clicks is taken for which of two thirds of them."""
    return M.train_matches(_pairs(*intervals(spark, sf)), ["src"]).select("src", F.col("pid").cast("long").alias("pid"), F.col("gid").cast("long").alias("gid"), r6("overlap"))


def chunk_ranges(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return R.chunk_ranges(d, "n_chars", 600, 50).select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "start_sample", "end_sample")


CHUNK_SQL = """SELECT doc_id, i AS chunk_id, i * 550 AS start_sample, least(i * 550 + 600, n_chars) AS end_sample
FROM (SELECT doc_id, n_chars, unnest(range(0, n_chars // 550 + 2)) AS i FROM documents) WHERE n_chars > 0 AND i * 550 < n_chars AND (i = 0 OR (i - 1) * 550 + 600 < n_chars)"""


def train_report(spark, sf):
    """Exact summary of train durations and gaps: count, mean, deviation, quartiles."""
    s = cut(T.train_stats(trained(spark, sf), "t", "conf", ["src"]).select("duration"))  # sums and quantiles are read from it
    g = s.agg(F.count("*").alias("n"), F.round(F.avg("duration"), 5).alias("mean"), F.round(F.stddev_samp("duration"), 5).alias("std"), F.round(F.max("duration"), 5).alias("max"))
    q = metrics.quantiles(s.withColumn("_k", F.lit(1)), "duration", ["_k"], QUARTILES)
    return g.withColumn("_k", F.lit(1)).join(q, "_k").drop("_k").withColumns({n: F.round(n, 5) for n in QUARTILES})


REPORT_SQL = f"""WITH {CLICKS}{STATS_SQL} SELECT count(*) AS n, round(avg(duration), 5) AS mean, round(stddev_samp(duration), 5) AS std, round(quantile_cont(duration, 0.25), 5) AS q25,
 round(quantile_cont(duration, 0.5), 5) AS q50, round(quantile_cont(duration, 0.75), 5) AS q75, round(max(duration), 5) AS max FROM st"""

PLANS = {
    "robust_zscore": (robust_zscore, ROBUST_Z_SQL),
    "tkeo_series": (tkeo_series, f"WITH {CLICKS}{TKEO} SELECT idx, round(tkeo, 6) AS tkeo FROM tk"),
    "tkeo_smooth": (tkeo_smooth, f"WITH {CLICKS}{TKEO} SELECT idx, round(sum(tkeo) OVER (PARTITION BY src ORDER BY t, idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM tk"),
    "local_peaks": (local_peaks, f"WITH {CLICKS}{Z}{PEAKS} SELECT idx, src, round(z, 6) AS z FROM peaks"),
    "rule_filter": (rule_filter, RULE_SQL),
    "rule_confidence": (rule_confidence, f"WITH {CLICKS}{Z}{FEATURES_SQL} SELECT idx, round({CONFIDENCE}, 6) AS confidence FROM f"),
    "likelihood_score": (likelihood_score, LIKELIHOOD_SQL),
    "event_quality": (event_quality, QUALITY_SQL),
    "refractory_merge": (refractory_merge, REFRACTORY_SQL),
    "chunk_dedup": (chunk_dedup, DEDUP_SQL),
    "peak_merge_samples": (peak_merge_samples, MERGE_SQL),
    "nms_suppress": (nms_suppress, NMS_SQL),
    "threshold_runs": (threshold_runs, RUNS_SQL),
    "build_trains": (build_trains, f"WITH {CLICKS}{TRAIN_SQL} SELECT idx, src, CAST(train_id AS BIGINT) AS train_id, ici FROM tr"),
    "train_stats": (train_stats, f"WITH {CLICKS}{STATS_SQL} SELECT src, train_id, n_clicks, {_rounded} FROM st"),
    "filter_trains": (filter_trains, f"WITH {CLICKS}{STATS_SQL} SELECT src, train_id, n_clicks FROM st WHERE n_clicks >= 3 AND ici_cv <= 0.6"),
    "doublets": (doublets, f"WITH {CLICKS}{STATS_SQL} SELECT src, train_id, round(mean_confidence, 6) AS mean_confidence FROM st WHERE n_clicks = 2 AND ici_median BETWEEN {FUSION.doublet_ici_ms[0]} AND {FUSION.doublet_ici_ms[1]} AND mean_confidence >= {FUSION.doublet_confidence}"),
    "fusion_decisions": (fusion_decisions, f"WITH {CLICKS}{FUSED_SQL} SELECT idx, CAST(train_id AS BIGINT) AS train_id, reason, accept FROM fd"),
    "fusion_summary": (fusion_summary, SUMMARY_SQL),
    "fusion_text": (fusion_text, TEXT_SQL),
    "event_match": (event_match, MATCH_SQL),
    "event_metrics": (event_metrics, MATCH_METRICS_SQL),
    "train_overlap_pairs": (train_overlap_pairs, OVERLAP_SQL),
    "train_matching": (train_matching, TRAIN_MATCH_SQL),
    "train_metrics": (train_metrics, TRAIN_METRICS_SQL),
    "train_report": (train_report, REPORT_SQL),
    "chunk_ranges": (chunk_ranges, CHUNK_SQL),
}
