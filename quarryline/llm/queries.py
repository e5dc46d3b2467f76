"""Thin queries over the corpus operators: each applies one to its whole table and returns its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import decontaminate, divergence, hilbert, langid, neardup_vectors, periodic, phrases, pieces, pii, quality, simhash, syncmers, toxicity
from .common import crc_mod, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("pii_kinds").cast("long").alias("n_found"), "pii_kinds", "text")


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def _held_out(folds: int, fold: int):
    return F.coalesce(crc_mod(F.col("doc_id"), folds) == fold, F.lit(False)).alias("held_out")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", _held_out(toxicity.FOLDS, toxicity.HELD_OUT), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", _held_out(quality.FOLDS, quality.HELD_OUT), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op7_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = phrases.without_repeats(table(spark, sf_dir, "documents"))
    return short.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return scored.select("doc_id", _held_out(langid.FOLDS, langid.HELD_OUT), "lang_pred", F.col("lang_score").alias("score"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the texts made periodic from a word on, as the id's checksum h says.

    With h % 10 = 0, g = h // 10, a = g % n and p = 1 + (n - a) // (3 + g % 8), word i >= a becomes word a + (i - a) % p.
    A text without words has no a and stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    drawn = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("w"))
    n = F.size("w")
    placed = drawn.withColumn("a", F.try_mod("g", n.cast("long")).cast("int")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    words = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at("w", 1 + F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i)))
    return placed.select("doc_id", F.when(n > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_planted(table(spark, sf_dir, "documents"))).withColumn("top", periodic.longest(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(periodic.listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_likeness(table(spark, sf_dir, "documents"))


#: The checksum of the decimal id bit by bit; runs as islands of places whose words are equal a period apart.
PERIODIC_SQL = r"""
WITH h AS (SELECT doc_id, text, CASE WHEN doc_id IS NOT NULL THEN xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) END AS h FROM documents),
v AS (SELECT row_number() OVER () AS rid, doc_id, h // 10 AS g, h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM h),
a AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN g % len(w) END AS a FROM v),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w FROM p),
t AS (SELECT rid, n, unnest(range(n)) AS i, unnest(w) AS word FROM d),
e AS (SELECT x.rid, y.i - x.i AS p, x.i AS i FROM t x JOIN t y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
s AS (SELECT rid, p, min(i) AS start, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS k FROM e) GROUP BY rid, p, k),
r AS (SELECT rid, start, length, min(p) AS period FROM s WHERE length >= greatest(12, 2 * p) GROUP BY rid, start, length),
l AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs, min((-length, start, period)) AS top FROM r GROUP BY rid),
g AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM t ANTI JOIN g USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top[2]::BIGINT AS start, (-top[1])::BIGINT AS length, top[3]::BIGINT AS period, (1000 * -top[1] // top[3])::BIGINT AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN l USING (rid) LEFT JOIN k USING (rid)
"""


def queries() -> dict[str, Query]:
    ops = (op1_embedding_neardup, op2_decontaminate, op3_pii, op4_hilbert_shards, op5_toxicity, op6_quality, op7_repeated_phrases, op8_language, op9_simhash, op10_pieces, op11_periodic_runs, op12_source_divergence, op13_syncmers)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": decontaminate.ORACLE_SQL, "op11_periodic_runs": PERIODIC_SQL, "op12_source_divergence": divergence.ORACLE_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
