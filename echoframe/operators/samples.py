"""A labelled training set: clean clips mixed with noise, noise alone as negatives, and a split.

Noise is given out by seeded ranks, so that no piece is used twice while there is enough: first to the positives that want
one noise source, from that source's pieces, then from what is left to the other positives, then to the negatives. Where
there is less noise than rows, ranks go over what is left again; where nothing is left, over all pieces. Keys and ranks are
computed once and cut from their plans; signals are joined to them at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import waves
from ..stages import cut
from .datasets import draw, numbered, ranked

ONE, ANY = "one_parent", "any_parent"


def spread(df: DataFrame, seed: int, *key: str) -> DataFrame:
    """Seeded ranks (_r, from 0) over the whole table, and its size (_n)."""
    return ranked(df.withColumn("_all", F.lit(0)), ["_all"], seed, *key).drop("_all")


def assigned(clean: DataFrame, noise: DataFrame, seed: int, share: float = 0.3, per_clean: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(file_id, strategy, segment_id, parent_id) of the positives and (segment_id, parent_id) of the negatives.

    ``clean`` has file_id; ``noise`` has segment_id and parent_id. Every clean row gets a piece, and there are ``per_clean`` times
    as many negatives, for any amount of noise but none, which gives no rows. With a single source there is nothing to choose.
    """
    spark = clean.sparkSession
    pool = noise.select("segment_id", "parent_id")
    parents = numbered(pool.select("parent_id").distinct(), "parent_id").withColumnRenamed("parent_id", "_parent")
    n_parents = parents.count()
    wants_one = (draw(seed, "file_id") < share) & F.lit(n_parents > 1)
    index = F.when(wants_one, F.floor(draw(seed + 1, "file_id") * n_parents)).cast("long")
    rows = cut(clean.select("file_id", index.alias("_i")))
    # those that want one source take its first pieces
    own = cut(ranked(pool, ["parent_id"], seed + 3, "segment_id"))
    sizes = own.groupBy("parent_id").agg(F.max("_n").alias("_size"))
    first = rows.where("_i is not null").join(parents, "_i").join(sizes, F.col("_parent").eqNullSafe(F.col("parent_id"))).select("file_id", "parent_id", "_size")
    first = ranked(first, ["parent_id"], seed + 2, "file_id").withColumn("_r", F.col("_r") % F.col("_size")).select("file_id", F.col("parent_id").alias("_parent"), "_r")
    first = cut(first.join(own.drop("_n"), F.col("_parent").eqNullSafe(F.col("parent_id")) & (first["_r"] == own["_r"])).select("file_id", F.lit(ONE).alias("strategy"), "segment_id", "parent_id"))
    # the others, and behind them the negatives, take what is left, or all pieces over again where nothing is
    rest = cut(spread(pool.join(first.select("segment_id").distinct(), "segment_id", "left_anti").select("segment_id", "parent_id"), seed + 4, "segment_id").drop("_n"))
    size = rest.count()
    if not size:
        rest = cut(spread(pool, seed + 4, "segment_id").drop("_n"))
        size = rest.count()
    some = rows.where("_i is null").select("file_id")
    n_any, n = some.count(), rows.count()
    if not size:
        return first, first.select("segment_id", "parent_id").limit(0)
    others = spread(some, seed + 5, "file_id").select("file_id", (F.col("_r") % size).alias("_r"))
    others = others.join(rest, "_r").select("file_id", F.lit(ANY).alias("strategy"), "segment_id", "parent_id")
    places = spark.range(int(n * per_clean)).select(((F.col("id") + n_any) % size).alias("_r"))
    return first.unionByName(cut(others)), cut(places.join(rest, "_r").select("segment_id", "parent_id"))


def training_set(clean: DataFrame, noise: DataFrame, seed: int, snr: tuple[float, float] = (-5.0, 15.0), share: float = 0.3, per_clean: float = 1.0, val: float = 0.2) -> DataFrame:
    """Rows of waveform, label, file_id, split and, for positives, strategy and snr_db; noise_parent for all.

    ``clean`` has file_id and wave, ``noise`` has segment_id, parent_id and wave, all of one length. The split is a cut of a seeded
    order at (1 - val) of the different rows; a negative whose piece is used again stays on one side.
    """
    pos, neg = assigned(clean, noise, seed, share, per_clean)
    none = lambda kind: F.lit(None).cast(kind)
    db = F.lit(snr[0]) + draw(seed + 6, "file_id") * (snr[1] - snr[0])
    named = F.format_string("%s_noise%d_%s_snr%.1f", F.col("_clean").cast("string"), F.col("parent_id").cast("long"), F.col("segment_id").cast("string"), F.col("snr_db"))
    pos = pos.select(F.col("file_id").alias("_clean"), "strategy", "segment_id", "parent_id", db.alias("snr_db")).withColumns({"label": F.lit(1), "file_id": named})
    other = F.format_string("neg_%d_%s", F.col("parent_id").cast("long"), F.col("segment_id").cast("string"))
    neg = neg.withColumns({"label": F.lit(0), "file_id": other, "strategy": none("string"), "snr_db": none("double")})
    order = spread(pos.select("label", "file_id").unionByName(neg.select("label", "file_id")).distinct(), seed + 7, "file_id", "label")
    split = F.when(F.col("_r") < F.floor(F.col("_n") * (1 - val)), "train").otherwise("val")
    splits = cut(order.select("label", "file_id", split.alias("split")))
    heard = noise.select("segment_id", F.col("wave").alias("_z"))
    columns = ["label", "file_id", "split", "strategy", "snr_db", F.col("parent_id").alias("noise_parent")]
    pos = pos.join(splits, ["label", "file_id"]).join(clean.select(F.col("file_id").alias("_clean"), F.col("wave").alias("_c")), "_clean").join(heard, "segment_id")
    neg = neg.join(splits, ["label", "file_id"]).join(heard, "segment_id")
    return pos.select(waves.mixed(F.col("_c"), F.col("_z"), F.col("snr_db")).alias("waveform"), *columns).unionByName(neg.select(F.col("_z").alias("waveform"), *columns))


def set_stats(samples: DataFrame) -> DataFrame:
    """Rows, and mean SNR of positives, of each split, label and strategy."""
    return samples.groupBy("split", "label", "strategy").agg(F.count("*").alias("n"), F.countDistinct("noise_parent").alias("n_parents"), F.avg("snr_db").alias("mean_snr_db"))


def some(samples: DataFrame, seed: int, n: dict[str, int]) -> DataFrame:
    """A seeded choice of rows of each split, to look at."""
    order = ranked(samples, ["split"], seed, "file_id", "label").drop("_n")
    wanted = F
    for k, v in n.items():
        wanted = wanted.when(F.col("split") == k, v)
    return order.where(F.col("_r") < wanted.otherwise(0)).drop("_r")
