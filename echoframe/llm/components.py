"""Connected components of a link table by joins alone: links are contracted until none is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Tables


def contracted(links: DataFrame, to: DataFrame) -> DataFrame:
    """Links between the places that their ends move to; those inside one place go, equal ones are one."""
    at = lambda c: to.select(F.col("v").alias(c), F.col("to").alias(f"to_{c}"))
    moved = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
    return moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label`` with the labels of linked nodes brought together to the least one.

    ``labels`` has the labels so far (at first each node's own id), ``links`` node ids in a and b. In a round every end of
    a link moves to its least neighbour, and on to where that moved; links then join the new places, and most are gone.
    Paths halve, so rounds grow as the logarithm of the longest. Every round is a written table; only whether links are
    left comes to the driver, and a round's tables go when the next are written.
    """
    with Tables(labels.sparkSession, "components") as t:
        links = t.put(contracted(links, labels.select(F.col("node").alias("v"), F.col("label").alias("to"))), "links")
        out = labels
        while not links.isEmpty():
            ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            hook = t.put(ends.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("_least")).select("v", F.least("v", "_least").alias("to")), "hooks")
            for _ in range(2):
                on = hook.select(F.col("v").alias("to"), F.col("to").alias("_on"))
                further = t.put(hook.join(on, "to", "left").select("v", F.coalesce("_on", "to").alias("to")), "hooks")
                t.drop(hook)
                hook = further
            place = hook.where("v <> to").select(F.col("v").alias("label"), "to")
            moved = t.put(out.join(place, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
            rest = t.put(contracted(links, hook), "links")
            t.drop(hook)
            t.drop(links)
            t.drop(out)
            out, links = moved, rest
        return t.keep(out)
