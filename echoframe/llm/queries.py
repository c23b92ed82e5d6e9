"""The numbered queries over the driver's tables, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judged

    out = judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import classes

    return classes(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import spans

    return spans(table(spark, sf_dir, "documents"))


def op4_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .huffman_ids import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out, learn, predict

    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 3, 1)
    return predict(docs, learn(docs.where(~out))).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encoded

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import scored
    from .language_id import held_out

    return scored(table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id"), 5, 1).alias("held_out")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import spans

    return spans(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import round_trip

    own = spark.createDataFrame([(-1, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return round_trip(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out
    from .scratch import Tables
    from .toxicity import learn, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 5, 0)
    with Tables(spark, "toxicity") as tables:
        model = learn(docs.select("doc_id", "text"), labels.where(~out).select("doc_id", F.col("toxic").cast("int").alias("label")), tables)
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_pii": op3_pii,
    "op4_huffman_ids": op4_huffman_ids,
    "op5_language_id": op5_language_id,
    "op6_decontaminate": op6_decontaminate,
    "op7_bpe": op7_bpe,
    "op8_katz": op8_katz,
    "op9_secrets": op9_secrets,
    "op10_chat": op10_chat,
    "op11_toxicity": op11_toxicity,
    "op12_whitening": op12_whitening,
    "op13_ranked_search": op13_ranked_search,
}

QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM l),
g AS (SELECT r, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, g FROM g WHERE g IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT DISTINCT r, i + k AS i FROM g JOIN again USING (r, g), range(3) t(k)),
rep AS (SELECT r, count(*) AS n FROM covered GROUP BY r),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d),
li AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM ln WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(li.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(li.n, 0) AS n_lines
  FROM d JOIN l USING (r) LEFT JOIN rep USING (r) LEFT JOIN li USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR 100 * n_symbols > 30 * word_chars OR 100 * n_dup_lines > 60 * n_lines) AS bad FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(bad / n) AS m, var_pop(bad / n) - avg((bad / n) * (1 - bad / n) / n) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 1e-9 THEN least(1000.0, greatest(2.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS weight FROM p),
s AS (SELECT source, (bad + m * weight) / (n + weight) AS host_rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(host_rate, 0) <= 0.75 AS kept, round(host_rate, 9) AS host_rate
FROM f LEFT JOIN s USING (source)
"""

SEARCH_SQL = r"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
d AS (SELECT r, doc_id, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM low WHERE x IS NOT NULL),
n AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
m AS (SELECT r, doc_id, 75 + (25 * n * docs) // terms AS m FROM n, c),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
i AS (SELECT row_number() OVER () AS i, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM benchmark),
q AS (SELECT i, item_id, unnest(regexp_extract_all(x, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i WHERE x IS NOT NULL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c WHERE term IN (SELECT term FROM q) GROUP BY term),
s AS (SELECT i, item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""

#: The other operators have no SQL form; tests/llm holds them against brute force, exact round trips and held-out accuracy.
ORACLES: dict[str, str] = {"op1_quality_rules": QUALITY_SQL, "op13_ranked_search": SEARCH_SQL}
