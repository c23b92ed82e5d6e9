"""Queries over manifests, labels and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import datasets as D
from ..operators import evaluate as E
from ..operators import metrics as M
from ..operators import model as N
from ..sources import audio as A
from ..sources import labels as L
from .base import QUARTILES, SCORES, scores, table

r6 = lambda c: F.round(F.col(c), 6).alias(c)
SEED = 17


def _parts(spark, sf):
    return table(spark, sf, "part").select((F.col("p_partkey") % 5 + 1).cast("int").alias("parent"), F.col("p_partkey").cast("int").alias("seg"), F.format_string("noise/purenoise_%d_%05d.wav", F.col("p_partkey") % 5 + 1, F.col("p_partkey")).alias("path"))


PARTS = "parts AS (SELECT CAST(p_partkey % 5 + 1 AS INT) AS parent, CAST(p_partkey AS INT) AS seg, printf('noise/purenoise_%d_%05d.wav', p_partkey % 5 + 1, p_partkey) AS path FROM part)"
SPLIT = "CASE parent WHEN 4 THEN 'val' WHEN 5 THEN 'test' ELSE 'train' END"


def manifest_split(spark, sf):
    return _parts(spark, sf).withColumn("split", D.parent_split(F.col("parent"))).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("parent").alias("n_parents"))


def manifest_halves(spark, sf):
    return D.noise_halves(_parts(spark, sf), "parent", "seg", "path")


HALVES_SQL = f"""WITH {PARTS} SELECT printf('%d_%05d_%s', parent, seg, half) AS segment_id, parent AS parent_id, seg AS original_seg_id, {SPLIT} AS split, half, path,
 CAST(CASE half WHEN 'a' THEN 0 ELSE 22050 END AS INT) AS start, CAST(CASE half WHEN 'a' THEN 22050 ELSE 44100 END AS INT) AS "end", CAST(500.0 AS DOUBLE) AS duration_ms FROM parts, (VALUES ('a'), ('b')) h(half)"""


def manifest_names(spark, sf):
    n = D.noise_names(_parts(spark, sf), "path")
    return n.groupBy("parent_id").agg(F.count("*").alias("n"), F.min("original_seg_id").alias("first_seg"))


def manifest_scan(spark, sf):
    """Paths of two listings as one: every path once, with its name, stem and kind."""
    p = table(spark, sf, "pages").select(F.regexp_replace("url", r"^https?://|[?].*$", "").alias("filepath"))
    d = p.unionByName(p.where(F.length("filepath") % 2 == 0)).distinct()
    parts = F.split("filepath", "/")
    return d.select("filepath", F.element_at(parts, -1).alias("filename"), F.element_at(parts, 1).alias("root"), F.lower("filepath").contains("en").alias("is_en"))


def collect_rename(spark, sf):
    p = table(spark, sf, "pages").select(F.concat(F.regexp_replace("url", r"^https?://|[?].*$", ""), F.lit("/"), F.lit("clip.wav")).alias("path")).distinct()
    return D.collected_names(p, "path").select("path", "new_name")


RENAME_SQL = r"""WITH p AS (SELECT DISTINCT regexp_replace(url, '^https?://|[?].*$', '', 'g') || '/clip.wav' AS path FROM pages),
n AS (SELECT path, list_extract(string_split(path, '/'), -2) || '_' || list_extract(string_split(path, '/'), -1) AS name FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path) - 1 AS i FROM n) SELECT path, CASE WHEN i = 0 THEN name ELSE printf('%s_%03d', name, i) END AS new_name FROM r"""


def balance_classes(spark, sf):
    return D.balanced(scores(spark, sf), "y", SEED, "id").select("id", "y")


def upsample_classes(spark, sf):
    return D.upsampled(scores(spark, sf), "y", SEED, "id").groupBy("id", "y").agg(F.count("*").alias("copies"))


UPSAMPLE_SQL = f"""WITH {SCORES}, r AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY md5('{SEED}:' || id), id) - 1 AS r, count(*) OVER (PARTITION BY y) AS n FROM scores),
m AS (SELECT max(n) AS m FROM r) SELECT id, y, CAST(floor((m - r - 1) / n) AS BIGINT) + 1 AS copies FROM r, m"""


def train_val_split(spark, sf):
    return D.train_val(scores(spark, sf), SEED, 0.2, "id").select("id", "split")


def class_weights(spark, sf):
    return M.class_weights(scores(spark, sf), "y").select("y", "n", r6("weight"))


def confusion_metrics(spark, sf):
    out = M.confusion(scores(spark, sf).withColumn("p", (F.col("score") >= 0.3).cast("int")), "y", "p")
    return out.select("tn", "fp", "fn", "tp", *[r6(c) for c in ("accuracy", "precision", "recall", "f1")])


CONFUSION_SQL = f"""WITH {SCORES}, c AS (SELECT count(*) FILTER (y = 0 AND score < 0.3) AS tn, count(*) FILTER (y = 0 AND score >= 0.3) AS fp, count(*) FILTER (y = 1 AND score < 0.3) AS fn, count(*) FILTER (y = 1 AND score >= 0.3) AS tp FROM scores),
m AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c)
SELECT tn, fp, fn, tp, round(accuracy, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m"""


def class_report(spark, sf):
    out = M.class_report(scores(spark, sf).withColumn("p", (F.col("score") >= 0.3).cast("int")), "y", "p")
    return out.select("cls", "support", *[r6(c) for c in ("precision", "recall", "f1")])


REPORT_SQL = f"""WITH {SCORES}, s AS (SELECT y, CAST(score >= 0.3 AS INT) AS p FROM scores), c AS (SELECT y AS cls FROM s UNION SELECT p FROM s),
g AS (SELECT cls, (SELECT count(*) FROM s WHERE y = cls) AS support, (SELECT count(*) FROM s WHERE p = cls) AS np, (SELECT count(*) FROM s WHERE p = cls AND y = cls) AS b FROM c),
m AS (SELECT cls, support, CASE WHEN np > 0 THEN b / np ELSE 0 END AS p, CASE WHEN support > 0 THEN b / support ELSE 0 END AS r FROM g)
SELECT cls, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m"""

CURVE = f"""WITH {SCORES}, d AS (SELECT score, sum(y) AS p, count(*) - sum(y) AS q FROM scores GROUP BY score),
cv AS (SELECT score, p, q, sum(p) OVER (ORDER BY score DESC) AS tp, sum(q) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nn FROM d)"""


def roc_auc(spark, sf):
    return M.roc_auc(scores(spark, sf), "y", "score").select(r6("roc_auc"))


def pr_auc(spark, sf):
    return M.pr_auc(scores(spark, sf), "y", "score").select(r6("pr_auc"))


def optimal_threshold(spark, sf):
    return M.best_threshold(scores(spark, sf), "y", "score").select("threshold", r6("precision"), r6("recall"), r6("f1"))


def roc_curve(spark, sf):
    c = M.curve(scores(spark, sf), "y", "score")
    return c.select("threshold", F.round(F.col("tp") / F.col("n_pos"), 6).alias("tpr"), F.round(F.col("fp") / F.col("n_neg"), 6).alias("fpr"))


def label_counts(spark, sf):
    g = L.category_report(table(spark, sf, "documents").select(F.col("lang").alias("category")))
    return g.select(F.col("category").alias("lang"), "n", F.round("percent", 6).alias("percent"))


def file_amp_stats(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("max_value"), F.min_by("event_type", "event_id").alias("first_type"))


def top_outliers(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "value").orderBy(F.desc("value"), "event_id").limit(20)


def dataset_describe(spark, sf):
    v = table(spark, sf, "lineitem")
    g = v.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.stddev_samp("l_extendedprice"), 4).alias("std"), F.min("l_extendedprice").alias("min"), F.max("l_extendedprice").alias("max"))
    q = M.quantiles(v, "l_extendedprice", ["l_returnflag"], QUARTILES)
    return g.join(q, "l_returnflag").withColumns({n: F.round(n, 4) for n in QUARTILES})


def leakage_intersect(spark, sf):
    d = D.train_val(table(spark, sf, "documents").select("doc_id", "source"), SEED, 0.02, "doc_id")
    return D.leaked(d.where("split = 'train'"), d.where("split = 'val'"), "source")


def anti_labelled(spark, sf):
    return D.without_labelled(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id", (F.col("toxic") == 1) | (F.col("quality") == 0))


def audacity_labels(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("source_file"), (F.col("event_id") * 0.25).alias("peak_time"))
    return L.audacity_lines(e, "peak_time", 0.05)


def parse_labels(spark, sf):
    """Lines of the label format read back: times and names, blanks and comments left out."""
    e = table(spark, sf, "events")
    line = F.when(F.col("event_id") % 7 == 0, "# note").when(F.col("event_id") % 11 == 0, "").when(F.col("event_id") % 2 == 0, F.format_string("%d\t%d", "event_id", F.col("event_id") + 3)).otherwise(F.format_string("%d\t%d\t%s", "event_id", F.col("event_id") + 1, "event_type"))
    return L.parsed_labels(e.select(line.alias("value")))


PARSE_SQL = """SELECT CAST(event_id AS DOUBLE) AS start, CAST(event_id + CASE WHEN event_id % 2 = 0 THEN 3 ELSE 1 END AS DOUBLE) AS "end", CASE WHEN event_id % 2 = 0 THEN 'segment' ELSE event_type END AS label
FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0"""

def file_roles(spark, sf):
    """Pages as files of labelled folders: their part of the data set and the path of a copy."""
    p = table(spark, sf, "pages").select(F.concat(F.regexp_replace("url", r"^https?://|[?].*$", ""), F.when(F.col("page_id") % 3 == 0, "_HighSNR.wav").otherwise("_low.wav")).alias("path"))
    return A.labelled_roles(p).select("path", "snr", "role", "dst_path")


ROLES_SQL = r"""WITH p AS (SELECT regexp_replace(url, '^https?://|[?].*$', '', 'g') || CASE WHEN page_id % 3 = 0 THEN '_HighSNR.wav' ELSE '_low.wav' END AS path, page_id % 3 = 0 AS high FROM pages)
SELECT path, CASE WHEN high THEN 'high' ELSE 'low' END AS snr, CASE WHEN high THEN 'train' ELSE 'test' END AS role, CASE WHEN high THEN 'train/' ELSE 'test/' END || list_extract(string_split(path, '/'), -1) AS dst_path FROM p"""


def evaluation_report(spark, sf):
    out = E.report(scores(spark, sf), "y", "score", 0.3)
    return out.select("tn", "fp", "fn", "tp", *[r6(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")], "best_threshold", r6("best_f1"))


def misclassified(spark, sf):
    s = scores(spark, sf).select(F.col("id").cast("string").alias("path"), "y", "score")
    return E.wrong(N.predictions(s, "path", "y", 0.3)).withColumn("confidence", F.round("confidence", 6))


def balance_ratio(spark, sf):
    """Classes cut to one and a half times the smallest."""
    return D.balanced(scores(spark, sf), "y", SEED, "id", ratio=1.5).select("id", "y")


PLANS = {
    "file_roles": (file_roles, ROLES_SQL),
    "evaluation_report": (evaluation_report, None),
    "misclassified": (misclassified, f"WITH {SCORES}, p AS (SELECT CAST(id AS VARCHAR) AS file_path, y AS true_label, CAST(score >= 0.3 AS INT) AS predicted_label, CASE WHEN score >= 0.3 THEN score ELSE 1 - score END AS confidence FROM scores) SELECT file_path, true_label, predicted_label, round(confidence, 6) AS confidence, false AS correct FROM p WHERE true_label <> predicted_label"),
    "balance_ratio": (balance_ratio, f"WITH {SCORES}, r AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY md5('{SEED}:' || id), id) AS r FROM scores), m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM scores GROUP BY y)) SELECT id, y FROM r, m WHERE r <= floor(m * 1.5)"),
    "manifest_split_3_1_1": (manifest_split, f"WITH {PARTS} SELECT {SPLIT} AS split, count(*) AS n, count(DISTINCT parent) AS n_parents FROM parts GROUP BY ALL"),
    "manifest_halves": (manifest_halves, HALVES_SQL),
    "manifest_names": (manifest_names, f"WITH {PARTS} SELECT parent AS parent_id, count(*) AS n, min(seg) AS first_seg FROM parts GROUP BY parent"),
    "manifest_scan": (manifest_scan, r"WITH p AS (SELECT DISTINCT regexp_replace(url, '^https?://|[?].*$', '', 'g') AS filepath FROM pages) SELECT filepath, list_extract(string_split(filepath, '/'), -1) AS filename, list_extract(string_split(filepath, '/'), 1) AS root, contains(lower(filepath), 'en') AS is_en FROM p"),
    "collect_rename": (collect_rename, RENAME_SQL),
    "balance_classes": (balance_classes, f"WITH {SCORES}, r AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY md5('{SEED}:' || id), id) AS r FROM scores), m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM scores GROUP BY y)) SELECT id, y FROM r, m WHERE r <= m"),
    "upsample_classes": (upsample_classes, UPSAMPLE_SQL),
    "train_val_split": (train_val_split, f"WITH {SCORES} SELECT id, CASE WHEN CAST('0x' || substr(md5('{SEED}:' || id), 1, 8) AS BIGINT) / 4294967296.0 < 0.2 THEN 'val' ELSE 'train' END AS split FROM scores"),
    "class_weights": (class_weights, f"WITH {SCORES}, c AS (SELECT y, count(*) AS n FROM scores GROUP BY y) SELECT y, n, round((SELECT count(*) FROM c) / n, 6) AS weight FROM c"),
    "confusion_metrics": (confusion_metrics, CONFUSION_SQL),
    "class_report": (class_report, REPORT_SQL),
    "roc_curve": (roc_curve, f"{CURVE} SELECT score AS threshold, round(tp / np, 6) AS tpr, round(fp / nn, 6) AS fpr FROM cv"),
    "roc_auc": (roc_auc, f"{CURVE} SELECT round(sum(q * (tp - p / 2)) / any_value(np * nn), 6) AS roc_auc FROM cv"),
    "pr_auc": (pr_auc, f"{CURVE}, pts AS (SELECT score, tp, tp / np AS r, tp / (tp + fp) AS p FROM cv), st AS (SELECT (r - coalesce(lag(r) OVER w, 0)) * (p + coalesce(lag(p) OVER w, 1)) / 2 AS s FROM pts WINDOW w AS (ORDER BY tp, score DESC)) SELECT round(sum(s), 6) AS pr_auc FROM st"),
    "optimal_threshold": (optimal_threshold, f"{CURVE}, pts AS (SELECT score, tp / (tp + fp) AS p, tp / np AS r FROM cv), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pts) SELECT score AS threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, score DESC LIMIT 1"),
    "label_counts": (label_counts, "SELECT lang, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 6) AS percent FROM documents GROUP BY lang"),
    "file_amp_stats": (file_amp_stats, "SELECT user_id, count(*) AS n, max(value) AS max_value, arg_min(event_type, event_id) AS first_type FROM events GROUP BY user_id"),
    "top_outliers": (top_outliers, "SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 20"),
    "dataset_describe": (dataset_describe, "SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, max(l_extendedprice) AS max FROM lineitem GROUP BY l_returnflag"),
    "leakage_intersect": (leakage_intersect, f"WITH d AS (SELECT source, CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.02 AS v FROM documents) SELECT source FROM d WHERE v INTERSECT SELECT source FROM d WHERE NOT v"),
    "anti_labelled": (anti_labelled, "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)"),
    "audacity_labels": (audacity_labels, "SELECT user_id AS source_file, printf('%.6f\t%.6f\tcandidate', greatest(0.0, CAST(event_id AS DOUBLE) * 0.25 - 0.05), CAST(event_id AS DOUBLE) * 0.25 + 0.05) AS value FROM events"),
    "parse_labels": (parse_labels, PARSE_SQL),
}

_one = lambda sql, name: f"{name} AS MATERIALIZED (SELECT * FROM ({sql}))"
EVALUATION_SQL = "WITH " + ", ".join(_one(PLANS[n][1], f"e{i}") for i, n in enumerate(("confusion_metrics", "roc_auc", "pr_auc", "optimal_threshold"))) + " SELECT e0.*, roc_auc, pr_auc, threshold AS best_threshold, e3.f1 AS best_f1 FROM e0, e1, e2, e3"
PLANS["evaluation_report"] = (evaluation_report, EVALUATION_SQL)
