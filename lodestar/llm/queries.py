"""Registered queries of the training-data operators: each applies one operator
to its whole table and derives the contract's columns from the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.llm import (bpe, context_tree, dedup, hard_negatives, longest_match, mixing, secret_scan, simhash, subword, suffix_dedup,
                          topk, toxicity, whitening)
from lodestar.llm.common import UPPER, WORD, fold, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql.strip()
        return f
    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@register("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(documents(spark, sf_dir), ["doc_id"])
    base = F.filter("found", lambda x: x["kind"] != "guess")
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS]
    return found.select(F.col("doc")["doc_id"].alias("doc_id"), *counts[:3],
                        F.sha2(secret_scan.listed(base).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.listed(F.col("found")).alias("spans"), counts[3])


def of_kind(kind: str):
    return F.filter("found", lambda x: x["kind"] == kind)


@register("op2_topk_norm_sorted", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def scored(rows: DataFrame, mod: int, rest: int, threshold: float) -> DataFrame:
    doc_id = F.col("doc")["doc_id"]
    return rows.select(doc_id.alias("doc_id"), fold(doc_id, mod, rest).alias("held_out"), "score",
                       F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


@register("op3_quality_subword")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = subword.fit(docs, table(spark, sf_dir, "labels"), "quality", ~fold(F.col("doc_id"), 5, 0))
    return scored(subword.score(docs, model, ["doc_id"]), 5, 0, subword.THRESHOLD)


@register("op4_toxicity_grammar")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    grammar = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~fold(F.col("doc_id"), 4, 2))
    return scored(toxicity.score(docs, grammar, ["doc_id"]), 4, 2, toxicity.THRESHOLD)


@register("op5_simhash_golay")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(documents(spark, sf_dir), ["doc_id"])
    return near.select(F.col("doc")["doc_id"].alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                       "component_id")


@register("op6_context_tree")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc_id = F.col("doc")["doc_id"]
    scored_ = context_tree.score(documents(spark, sf_dir), ~fold(F.col("doc_id"), 7, 2), ["doc_id"])
    return scored_.select(doc_id.alias("doc_id"), fold(doc_id, 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                          "base_score", "score", "n_bytes", "bits_per_byte")


@register("op7_bpe_tree_concat")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(documents(spark, sf_dir), ["doc_id"])
    return coded.select(F.col("doc")["doc_id"].alias("doc_id"), *digests())


def digests() -> list:
    """The contract's digest columns of BPE ids and decoded text."""
    return [F.size("ids").cast("long").alias("n_tokens"),
            F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
            F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]


@register("op8_longest_match_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = longest_match.count_tokens(documents(spark, sf_dir).select("doc_id", "text"))
    return counted.select(F.col("doc")["doc_id"].alias("doc_id"), "n_words", "n_tokens")


@register("op9_mix_hash_threshold", f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
-- sources in the order in which they reach their cap as the level rises
r AS (SELECT *, row_number() OVER (ORDER BY {mixing.MOST}.0 * source_size / weight, encode(source) NULLS LAST) AS k FROM w),
c AS (SELECT *, sum(source_size) OVER () - coalesce({mixing.MOST} * sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_total,
             sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM r),
lev AS (SELECT k, open_total, open_weight FROM c WHERE {mixing.MOST} * source_size * open_weight >= weight * open_total ORDER BY k LIMIT 1),
t AS (SELECT c.source, c.source_size,
             CASE WHEN lev.k IS NULL OR c.k < lev.k THEN ({mixing.MOST} * c.source_size)::DOUBLE
                  ELSE lev.open_total::DOUBLE * c.weight::DOUBLE / lev.open_weight::DOUBLE END AS target
      FROM c LEFT JOIN lev ON true),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM t),
h AS (SELECT source, h, sum(size)::BIGINT AS size FROM d GROUP BY source, h),
u AS (SELECT b.*, h.h, h.size, sum(h.size) OVER (PARTITION BY h.source ORDER BY h.h) AS upto,
             b.target - b.copies * b.source_size AS budget
      FROM h JOIN b ON h.source IS NOT DISTINCT FROM b.source),
x AS (SELECT source, h, copies + CASE WHEN upto <= budget THEN 1
                                       WHEN upto - size <= budget AND budget - (upto - size) > upto - budget THEN 1
                                       ELSE 0 END AS times FROM u)
SELECT d.doc_id, d.size, b.source_size, b.target, (d.size * x.times)::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
       JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source")).select(
        F.col("doc")["doc_id"].alias("doc_id"), "size", "source_size", "target", "taken")


@register("op10_stream_dedup", f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.deduplicate(documents(spark, sf_dir), ["doc_id"])
    return found.select(F.col("doc")["doc_id"].alias("doc_id"), "keep_id", "group_size", "kept",
                        F.col("digest").alias("text_sha256"))


@register("op11_suffix_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicate(documents(spark, sf_dir), ["doc_id"])
    return found.select(F.col("doc")["doc_id"].alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


@register("op12_hard_negatives", """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
      FROM e a JOIN e c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
      FROM p JOIN s USING (anchor_id)
      WHERE NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(emb.withColumn("label", label), F.col("id") % 100 == 0)


@register("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
