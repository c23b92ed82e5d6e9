"""Classification metrics of a table with a 0/1 label and a score. Exact: ties are one point of a curve."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.waves import let
from ..stages import cut
from .matching import ratio

#: Size of a sketch (390 KB at most, however many are merged), and the share of a part's rows by which a rank by it may be off.
SKETCH, OFF = 16384, 4e-4
#: Up to so many parts, their bounds are sent to all tasks.
PARTS = 10000


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: tn, fp, fn, tp, accuracy, precision, recall, f1; ratios are 0 where undefined."""
    y, p = F.col(label), F.col(predicted)
    out = df.agg(*[F.count_if((y == a) & (p == b)).alias(n) for a, b, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = out.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row per distinct score, falling: rows at or above it, cumulative tp and fp, totals.

    Rows collapse to distinct scores before anything is ordered, and the running sums go in two steps: within ranges of
    scores in parallel, then over the ranges' totals. Ranges are cut where the scores are, whatever their scale.
    """
    points = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(label)).alias("_p"), F.count("*").alias("_n"))
    points = in_ranges(points, "threshold", "_part")
    inner = Window.partitionBy("_part").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    parts = points.groupBy("_part").agg(F.sum("_p").alias("_pp"), F.sum("_n").alias("_pn"))
    before = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    parts = parts.select(
        "_part",
        F.coalesce(F.sum("_pp").over(before), F.lit(0)).alias("_p0"),
        F.coalesce(F.sum("_pn").over(before), F.lit(0)).alias("_n0"),
        F.sum("_pp").over(whole).alias("n_pos"),
        F.sum("_pn").over(whole).alias("_all"),
    )
    return points.join(parts, "_part").select(
        "threshold",
        (F.col("_p0") + F.sum("_p").over(inner)).alias("tp"),
        (F.col("_n0") + F.sum("_n").over(inner) - F.col("_p0") - F.sum("_p").over(inner)).alias("fp"),
        "n_pos",
        (F.col("_all") - F.col("n_pos")).alias("n_neg"),
        "_part",
    )


def in_ranges(df: DataFrame, value: str, out: str, n: int = 256) -> DataFrame:
    """Adds the number of the range, of about ``n`` of like size, that a value lies in. The bounds are approximate, and only
    deal rows to tasks: equal values are always in one range."""
    shares = [k / n for k in range(1, n)]
    bounds = df.agg(F.percentile_approx(value, shares, 10 * n).alias("_bounds"))
    # how many bounds lie below the value, found by halving: the place at which it would stand among them
    place = F.lit(0)
    step = 1 << max(0, (n - 1).bit_length() - 1)
    while step:
        place = let(place, lambda p, step=step: F.when(F.get("_bounds", p + step - 1) < F.col(value), p + step).otherwise(p))
        step //= 2
    place = F.when(F.col("_bounds").isNotNull(), place)
    both = df.withColumn("_k", F.lit(1)).join(F.broadcast(bounds.withColumn("_k", F.lit(1))), "_k")
    return both.withColumn(out, place).select(*df.columns, out)


def with_nulls(df: DataFrame, other: DataFrame, keys: list[str], everywhere: bool = False) -> DataFrame:
    """An inner join on equal keys, where null is a key like any other; ``everywhere`` sends ``other`` to all tasks."""
    named = other.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[c for c in other.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)])
    return df.join(F.broadcast(named) if everywhere else named, same).drop(*[f"_k{i}" for i in range(len(keys))])


def quantiles(df: DataFrame, value: str, part: list[str], probs: dict[str, float]) -> DataFrame:
    """Exact quantiles, interpolated between neighbours, of each part: one row with a column for each of ``probs``.

    A sketch says which values lie a little below and above each rank. How many rows lie between and at these bounds, which is
    counted, says in which range the rank is, whatever the sketch's error; only rows of those ranges move, collapse to
    distinct values and are ordered. ``df`` is read three times, so a plan that costs more than a scan should be cut before.
    """
    rows = df.where(F.col(value).isNotNull()).select(*part, F.col(value).alias("_v"))
    shares = sorted({min(1.0, max(0.0, p + d * OFF)) for p in probs.values() for d in (-2, 2)})
    # percentile_approx keeps the values of all merged sketches, and copies them at each merge
    sketch = rows.groupBy(*part).agg(F.kll_sketch_agg_double(F.col("_v").cast("double"), SKETCH).alias("_sketch"))
    held = F.kll_sketch_get_n_double("_sketch") > 0  # it takes no NaN
    bounds = cut(sketch.select(*part, F.when(held, F.kll_sketch_get_quantile_double("_sketch", F.array(*map(F.lit, shares)))).alias("_bounds")))
    few = bounds.count() <= PARTS
    # a bound is a range of its own, as many rows may have its value
    at_bounds = [F.get("_bounds", F.lit(i)) for i in range(len(shares))]
    place = reduce(lambda a, b: a + b, [(b < F.col("_v")).cast("int") + (b <= F.col("_v")).cast("int") for b in at_bounds])
    rows = with_nulls(rows, bounds, part, few).select(*part, "_v", place.alias("_range"))
    totals = rows.groupBy(*part, "_range").agg(F.count("*").alias("_m"))
    w = Window.partitionBy(*part)
    totals = totals.withColumns({"_before": F.coalesce(F.sum("_m").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_m").over(w)})
    at = {name: (F.col("_all") - 1) * p for name, p in probs.items()}
    ranks = [f(x) for x in at.values() for f in (F.floor, F.ceil)]
    here = F.exists(F.array(*ranks), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_m")))
    near = with_nulls(rows, totals.where(here).select(*part, "_range", "_before", "_all"), [*part, "_range"], few)
    near = near.groupBy(*part, "_range", "_before", "_all", "_v").agg(F.count("*").alias("_c"))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*part, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("_upto", upto)

    def value_at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto")), F.col("_v")))

    picked = [value_at(f(x)).alias(f"_{n}_{i}") for n, x in at.items() for i, f in enumerate((F.floor, F.ceil))]
    found = near.groupBy(*part).agg(F.max("_all").alias("_all"), *picked)
    between = {n: F.col(f"_{n}_0") + (F.col(f"_{n}_1") - F.col(f"_{n}_0")) * (x - F.floor(x)) for n, x in at.items()}
    return found.select(*part, *[x.alias(n) for n, x in between.items()])


def roc_auc(df: DataFrame, label: str, score: str, points: DataFrame | None = None) -> DataFrame:
    """Area under the ROC curve by pairs: the share of positive-negative pairs in order, ties as half; null for one class.

    Each distinct score adds its negatives times (positives above + half its own positives): the trapezoid rule, without
    ordering the curve again.
    """
    c = curve(df, label, score) if points is None else points
    own = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(label)).alias("_p"), (F.count("*") - F.sum(F.col(label))).alias("_q"))
    pairs = c.join(own, "threshold").agg(F.sum(F.col("_q") * (F.col("tp") - F.col("_p") / 2)).alias("a"), F.max("n_pos").alias("p"), F.max("n_neg").alias("n"))
    return pairs.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("a") / (F.col("p") * F.col("n"))).alias("roc_auc"))


def pr_points(df: DataFrame, label: str, score: str, points: DataFrame | None = None) -> DataFrame:
    """threshold, precision, recall and f1 at every distinct score."""
    c = (curve(df, label, score) if points is None else points).select("threshold", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("n_pos")).alias("recall"), "_part")
    p, r = F.col("precision"), F.col("recall")
    return c.withColumn("f1", ratio(2 * p * r, p + r))


def pr_auc(df: DataFrame, label: str, score: str, points: DataFrame | None = None) -> DataFrame:
    """Area under precision over recall by trapezoids, from the point (0, 1) on."""
    pts = pr_points(df, label, score, points).withColumn("point", F.struct("recall", "precision"))
    # trapezoids within each range of scores, whose first begins at the last point of the range above: one row a range
    ends = pts.groupBy("_part").agg(F.min_by("point", "threshold").alias("end"))
    start = F.struct(F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    ends = ends.select("_part", F.coalesce(F.lag("end").over(Window.orderBy(F.desc("_part"))), start).alias("begin"))
    before = F.coalesce(F.lag("point").over(Window.partitionBy("_part").orderBy(F.desc("threshold"))), F.col("begin"))
    pts = pts.join(ends, "_part").select("point", before.alias("before"))
    step = (F.col("point.recall") - F.col("before.recall")) * (F.col("point.precision") + F.col("before.precision")) / 2
    return pts.agg(F.sum(step).alias("pr_auc"))


def best_threshold(df: DataFrame, label: str, score: str, points: DataFrame | None = None) -> DataFrame:
    """The threshold with the largest f1, the highest of equals."""
    return pr_points(df, label, score, points).agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct("f1", "threshold")).alias("b")).select("b.*")


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """precision, recall, f1 and support of each class that occurs as a label or a prediction."""
    c = df.select(F.explode(F.array(F.struct(F.col(label).alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("b")), F.struct(F.col(predicted).alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("p"), (F.col(label) == F.col(predicted)).cast("int").alias("b")))).alias("r"))
    g = c.groupBy("r.cls").agg(F.sum("r.t").alias("support"), F.sum("r.p").alias("_p"), F.sum("r.b").alias("_b"))
    g = g.select("cls", "support", ratio(F.col("_b"), F.col("_p")).alias("precision"), ratio(F.col("_b"), F.col("support")).alias("recall"))
    return g.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """count and weight = classes / count of each class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("weight", F.count("*").over(Window.partitionBy()) / F.col("n"))
