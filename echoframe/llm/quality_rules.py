"""Host-level quality rules on DataFrame functions only.

Every document is measured in one pass over its words. Failures of a rule set are counted by host, each host's failure
rate is shrunk by a beta prior that is fitted to all hosts by moments, and the host's verdict is joined back.

Defined cases: a null or empty text has no words and so fails; very long texts are measured whole; a rate or share at its bound
passes, as only what is above fails; a null host is a host of its own without a verdict; an empty table gives an empty
result; repeated rows are each measured; other columns stay untouched (clashing names are overwritten by
the measures only in :func:`measured`, never in :func:`passing`, which keeps the caller's columns).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Further rules that count as failures of a host, though a document alone doesn't go for them.
    max_symbol_percent: int = 30
    max_dup_line_percent: int = 60
    #: A host is rejected if its shrunk failure rate is above this.
    max_host_rate: float = 0.75
    #: Host tables up to this many rows are broadcast; larger ones are joined by a shuffle that splits skewed hosts.
    broadcast_hosts: int = 100_000


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the array ``words``, each word counted once.

    Windows are 64-bit hashes. Where any repeats, hash and position are packed in one long (as many low bits as positions
    need), sorted, and equal neighbours are confirmed by their full hashes: n log n for any text. Two windows are taken for
    equal by their hashes, and a repeat is missed if a third window between its places shares the hash's upper bits but not
    the rest: among n windows either has a probability of about n * n / 2**(64 - log2(n)).
    """

    def count(grams: Column) -> Column:
        bits = F.greatest(F.ceil(F.log2(F.size(grams) + F.lit(1))), F.lit(1)).cast("int")
        low = F.expr("1L")

        def packed(b: Column) -> Column:
            return F.sort_array(F.transform(grams, lambda g, i: F.call_function("shiftleft", g, b).bitwiseOR(i.cast("long"))))

        def positions(b: Column) -> Column:
            mask = F.call_function("shiftleft", low, b) - 1

            def flagged(s: Column) -> Column:
                def same(x: Column, i: Column, step: int) -> Column:
                    y = F.get(s, i + step)
                    close = F.call_function("shiftright", x, b) == F.call_function("shiftright", y, b)
                    return F.coalesce(
                        close & (F.get(grams, x.bitwiseAND(mask).cast("int")) == F.get(grams, y.bitwiseAND(mask).cast("int"))), F.lit(False)
                    )

                hit = F.filter(s, lambda x, i: same(x, i, -1) | same(x, i, 1))
                return F.sort_array(F.transform(hit, lambda x: x.bitwiseAND(mask)))

            return let(packed(b), flagged)

        def covered(p: Column) -> Column:
            step = F.transform(p, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(x - F.get(p, i - 1), F.lit(3).cast("long"))))
            return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(let(bits, positions), covered))

    def grams(h: Column) -> Column:
        return F.transform(F.slice(h, 3, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(F.get(h, i), F.get(h, i + 1), x))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), grams), count)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of each whole text. The text is split once."""
    t = F.coalesce(F.col(text), F.lit(""))
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    m = F.struct(
        let(F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != ""), of_words).alias("w"),
        F.char_length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
    )
    # a generator of one row: the fields below read its result, where a plain column would be evaluated once for each
    out = docs.select("*", F.explode(F.array(m)).alias("_m"))
    return out.withColumns(
        {
            "n_words": F.col("_m.w.n_words"),
            "word_chars": F.col("_m.word_chars"),
            "n_symbols": F.col("_m.n_symbols"),
            "n_dup_lines": F.col("_m.l.dup"),
            "n_repeat_words": F.col("_m.w.n_repeat_words"),
            "n_lines": F.col("_m.l.n"),
        }
    ).drop("_m")


def base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def counted_failed(rules: Rules) -> Column:
    """What counts against a host."""
    return (
        base_failed(rules)
        | (100 * F.col("n_symbols") > rules.max_symbol_percent * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > rules.max_dup_line_percent * F.col("n_lines"))
    )


def host_rates(measures: DataFrame, rules: Rules = Rules(), host: str = "source") -> DataFrame:
    """Per host: documents, failures, and the failure rate shrunk towards all hosts; a written table.

    The beta prior has the hosts' mean rate and the variance that is left when the binomial part is taken off; with one
    host, or hosts that don't differ, it weighs as much as 1,000 documents, and it never weighs less than 2.
    """
    hosts = measures.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n_docs"), F.count_if(counted_failed(rules)).alias("n_failed"))
    hosts = written(hosts, "quality-hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    mean, left = hosts.agg(F.avg(rate), F.var_pop(rate) - F.avg(rate * (1 - rate) / F.col("n_docs"))).first()  # the prior: one row
    mean = mean or 0.0
    weight = min(1000.0, max(2.0, mean * (1 - mean) / left - 1)) if left and left > 1e-9 else 1000.0
    return hosts.withColumn("host_rate", (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight))


def judged(docs: DataFrame, rules: Rules = Rules(), text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """One row per document: key, host, measures, base_failed, the host's shrunk rate and kept."""
    slim = measured(docs.select(F.col(key), F.col(host), F.col(text)), text).drop(text)
    slim = written(slim, "quality-measures")  # read twice: for the hosts, and to join them back
    hosts = host_rates(slim, rules, host).select(F.col(host).alias("_host"), "host_rate")
    small = hosts.limit(rules.broadcast_hosts + 1).count() <= rules.broadcast_hosts
    out = slim.join(F.broadcast(hosts) if small else hosts, F.col(host) == F.col("_host"), "left").drop("_host")
    failed = base_failed(rules)
    return out.withColumns({"base_failed": failed, "kept": ~failed & (F.coalesce(F.col("host_rate"), F.lit(0.0)) <= rules.max_host_rate)})


def passing(docs: DataFrame, rules: Rules = Rules(), text: str = "text", host: str = "source") -> DataFrame:
    """The documents that are kept, with their columns as they came.

    The measured rows are written once, whole, and read for the hosts (a few columns) and for the result; texts are not
    shuffled.
    """
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    rows = written(measured(docs.select(row, F.col(host).alias("_of"), F.col(text).alias("_text")), "_text").drop("_text"), "quality-rows")
    bad = host_rates(rows, rules, "_of").where(F.col("host_rate") > rules.max_host_rate).select(F.col("_of").alias("_host"))
    small = bad.limit(rules.broadcast_hosts + 1).count() <= rules.broadcast_hosts
    kept = rows.where(~base_failed(rules))
    return kept.join(F.broadcast(bad) if small else bad, F.col("_of") == F.col("_host"), "left_anti").select("_row.*")
