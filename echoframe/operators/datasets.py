"""Building labelled sets: splits, halves, seeded ranks, balancing, mixing, leakage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import waves
from ..stages import cut
from .metrics import with_nulls

#: Which parents go to which split; any other parent trains.
PARENT_SPLIT = {4: "val", 5: "test"}


def seeded(seed: int, *keys: str) -> Column:
    """A hash of seed and keys as text; equal in any engine with md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def draw(seed: int, *keys: str) -> Column:
    """A number in [0, 1) from the first 8 hex digits of :func:`seeded`."""
    return F.conv(F.substring(seeded(seed, *keys), 1, 8), 16, 10).cast("double") / 4294967296.0


def parent_split(parent: Column) -> Column:
    out = F
    for k, v in PARENT_SPLIT.items():
        out = out.when(parent == k, v)
    return out.otherwise("train")


def noise_halves(df: DataFrame, parent: str, segment: str, path: str, rate: int = 44100) -> DataFrame:
    """Two half-second rows of every one-second noise file, with the split of its parent."""
    half = rate // 2
    halves = F.explode(F.array(*[F.struct(F.lit(h).alias("half"), F.lit(i * half).alias("start"), F.lit((i + 1) * half).alias("end")) for i, h in enumerate("ab")])).alias("_h")
    out = df.select(F.col(parent).alias("parent_id"), F.col(segment).alias("original_seg_id"), F.col(path).alias("path"), halves)
    return out.select(
        F.format_string("%d_%05d_%s", "parent_id", "original_seg_id", "_h.half").alias("segment_id"),
        "parent_id",
        "original_seg_id",
        parent_split(F.col("parent_id")).alias("split"),
        "_h.half",
        "path",
        "_h.start",
        "_h.end",
        F.lit(500.0).alias("duration_ms"),
    )


def noise_names(df: DataFrame, name: str) -> DataFrame:
    """parent_id and segment number of files named purenoise_<parent>_<segment>.wav; other names go."""
    found = lambda g: F.regexp_extract(name, r"purenoise_(\d+)_(\d+)\.wav", g)
    return df.where(found(1) != "").withColumns({"parent_id": found(1).cast("int"), "original_seg_id": found(2).cast("int")})


def ranked(df: DataFrame, part: list[str], seed: int, *key: str, rank: str = "_r", size: str = "_n") -> DataFrame:
    """Adds each row's seeded rank in its part, from 0, and the part's size.

    Rows are dealt by the first digits of their hash, ranked there, and moved on by the counts of the lower digits, so a part
    of any size is ranked by many tasks. A null is a part like any other.
    """
    rows = df.withColumn("_h", seeded(seed, *key)).withColumn("_d", F.substring("_h", 1, 3))
    w = Window.partitionBy(*part)
    counts = rows.groupBy(*part, "_d").agg(F.count("*").alias("_c"))
    counts = counts.withColumns({"_off": F.coalesce(F.sum("_c").over(w.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), size: F.sum("_c").over(w)})
    own = F.row_number().over(Window.partitionBy(*part, "_d").orderBy("_h", *key)) - 1
    return with_nulls(rows.withColumn("_own", own), counts.drop("_c"), [*part, "_d"]).withColumn(rank, F.col("_own") + F.col("_off")).select(*df.columns, rank, size)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``_i``, each row's place in the order given, from 0. Rows are sorted by ranges, and a range is moved on by the
    sizes of those before it: one number for each range is all that meets."""
    at = F.col("_m")
    rows = cut(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id())).withColumns({"_p": F.shiftright(at, 33), "_m": at.bitwiseAND((1 << 33) - 1)})
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_c"))
    starts = sizes.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    return rows.join(F.broadcast(starts), "_p").select(*df.columns, (F.col("_m") + F.col("_s")).alias("_i"))


def with_extreme(df: DataFrame, label: str, pick) -> DataFrame:
    """Adds ``_size``, the smallest or largest class's size: one row that is joined to all."""
    one = df.groupBy(label).agg(F.count("*").alias("_c")).agg(pick("_c").alias("_size")).withColumn("_k", F.lit(1))
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(one), "_k").drop("_k")


def balanced(df: DataFrame, label: str, seed: int, *key: str, ratio: float = 1.0) -> DataFrame:
    """Every class cut to ``ratio`` times the size of the smallest (from 1 on), by seeded rank."""
    out = with_extreme(ranked(df, [label], seed, *key), label, F.min)
    return out.where(F.col("_r") < F.floor(F.col("_size") * ratio)).select(*df.columns)


def upsampled(df: DataFrame, label: str, seed: int, *key: str) -> DataFrame:
    """Every class brought to the size of the largest by repeating rows in seeded order; ``copy`` numbers the copies."""
    out = with_extreme(ranked(df, [label], seed, *key), label, F.max)
    return out.select(*df.columns, F.explode(F.sequence(F.lit(0), F.floor((F.col("_size") - F.col("_r") - 1) / F.col("_n")).cast("int"))).alias("copy"))


def train_val(df: DataFrame, seed: int, val: float, *key: str) -> DataFrame:
    """``split`` by a draw of each key: the same row gets the same split whatever else is in the table."""
    return df.withColumn("split", F.when(draw(seed, *key) < val, "val").otherwise("train"))


def paired(clean: DataFrame, noise: DataFrame, clean_key: str, noise_key: str, seed: int, part: list[str]) -> DataFrame:
    """Each clean row with a noise row of its part, without replacement while noise lasts, then over again.

    Both sides' keys are ranked by a seeded hash, and ranks meet by an equi join; the rows, with their signals, are joined
    to the pairs of keys afterwards.
    """
    n = ranked(noise.select(*part, noise_key), part, seed + 1, noise_key)
    size = n.groupBy(*part).agg(F.max("_n").alias("_size"))
    c = ranked(clean.select(*part, clean_key), part, seed, clean_key).join(size, part).withColumn("_r", F.col("_r") % F.col("_size"))
    pairs = c.select(*part, clean_key, "_r").join(n.select(*part, noise_key, "_r"), [*part, "_r"]).drop("_r")
    return pairs.join(clean, [*part, clean_key]).join(noise, [*part, noise_key])


def mixed_samples(clean: DataFrame, noise: DataFrame, seed: int, part: list[str], snr: tuple[float, float] = (0.0, 20.0)) -> DataFrame:
    """Positives: clean (id, wave) plus noise (noise_id, noise) at a drawn SNR. Columns id, noise_id, snr_db, wave, clean."""
    pairs = paired(clean, noise, "id", "noise_id", seed, part).withColumn("snr_db", F.lit(snr[0]) + draw(seed + 2, "id") * (snr[1] - snr[0]))
    return pairs.select(*part, "id", "noise_id", "snr_db", waves.mixed(F.col("wave"), F.col("noise"), F.col("snr_db")).alias("wave"), F.col("wave").alias("clean"))


def negatives(clean: DataFrame, noise: DataFrame, noise_key: str, seed: int, part: list[str], per_clean: float = 1.0) -> DataFrame:
    """Noise rows of each part that no positive of :func:`paired` with this seed has, ``per_clean`` for each clean row.

    They go on in the ranks after the positives'; where noise is used up there are fewer, and :func:`capacity` tells so.
    """
    used = clean.groupBy(*part).agg(F.count("*").alias("_used"))
    keys = ranked(noise.select(*part, noise_key), part, seed + 1, noise_key).join(used, part)
    keys = keys.where((F.col("_r") >= F.col("_used")) & (F.col("_r") < F.col("_used") + F.floor(F.col("_used") * per_clean)))
    return noise.join(keys.select(*part, noise_key), [*part, noise_key], "left_semi")


def noise_crops(noise: DataFrame, key: str, samples: str, seed: int, n: int, length: int) -> DataFrame:
    """``n`` rows (crop, start, samples) of each noise: ``length`` samples from a drawn start, clipped to [-1, 1].

    Shorter noise is repeated up to ``length``; noise without samples has no crops.
    """
    size = F.size(samples)
    tiled = F.slice(F.flatten(F.array_repeat(samples, F.ceil(length / size).cast("int"))), 1, length)
    some = noise.where(size > 0).withColumn(samples, F.when(size < length, tiled).otherwise(F.col(samples)))
    some = some.withColumn("crop", F.explode(F.sequence(F.lit(1), F.lit(n)))) if n > 0 else some.withColumn("crop", F.lit(1)).limit(0)
    some = some.withColumn("start", F.floor(draw(seed, key, "crop") * (F.size(samples) - length + 1)).cast("int"))
    cut = F.slice(samples, F.col("start") + 1, length)
    return some.withColumn(samples, F.transform(cut, lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))))


def leaked(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    return train.select(key).intersect(test.select(key))


def without_labelled(events: DataFrame, labels: DataFrame, key: str, negative: Column) -> DataFrame:
    """Events whose key has no label for which ``negative`` holds."""
    return events.join(labels.where(negative).select(key).distinct(), key, "left_anti")


def collected_names(df: DataFrame, path: str) -> DataFrame:
    """parent_name for each path, with _000, _001, ... in path order where names meet more than once."""
    parts = F.split(path, "/")
    name = F.concat_ws("_", F.element_at(parts, -2), F.element_at(parts, -1))
    w = Window.partitionBy("name")
    out = df.withColumn("name", name).withColumns({"_i": F.row_number().over(w.orderBy(path)) - 1, "_n": F.count("*").over(w)})
    return out.withColumn("new_name", F.when(F.col("_i") == 0, F.col("name")).otherwise(F.format_string("%s_%03d", "name", "_i"))).drop("_i", "_n")


def capacity(clean: DataFrame, noise: DataFrame, part: list[str], per_clean: int = 2) -> DataFrame:
    """Per part: rows wanted, rows there, and whether noise must be used again."""
    want = clean.groupBy(*part).agg((F.count("*") * per_clean).alias("wanted"))
    have = noise.groupBy(*part).agg(F.count("*").alias("available"))
    return want.join(have, part, "left").na.fill(0, ["available"]).withColumn("reuse", F.col("wanted") > F.col("available"))


def strategy(df: DataFrame, seed: int, share: float, *key: str) -> DataFrame:
    """``strategy`` of each row: one random parent with probability ``share``, else any parent."""
    return df.withColumn("strategy", F.when(draw(seed, *key) < share, "one_parent").otherwise("any_parent"))
