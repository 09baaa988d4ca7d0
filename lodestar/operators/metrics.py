"""Ranking metrics computed without a global sort or a single-partition window.

Scores are first collapsed to one row per distinct score (partial
aggregation absorbs hot scores), then range-partitioned; per-partition totals
give each partition's offset and a window *within* it the running count. Exact,
tie-aware, and balanced at any scale.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import stored


def _counts_by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("s")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum((1 - F.col(label)).cast("long")).alias("neg"))


def cumulative_below(counts: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``<col>_below`` = sum of ``col`` over strictly smaller scores ``s``.

    The counts are stored once, range-partitioned by score: a partition is a
    bucket, so buckets scale with the session's partitions. Runs a job."""
    b = stored(counts.repartitionByRange("s").withColumn("_b", F.spark_partition_id()), "score_counts")
    tot = b.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    wo = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    off = tot.select("_b", *[F.coalesce(F.sum(f"_t_{c}").over(wo), F.lit(0)).alias(f"_o_{c}") for c in cols])
    wi = Window.partitionBy("_b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    inner = b.select("*", *[F.coalesce(F.sum(c).over(wi), F.lit(0)).alias(f"_i_{c}") for c in cols])
    j = inner.join(F.broadcast(off), "_b")  # one row per partition
    return j.select("s", *cols, *[(F.col(f"_o_{c}") + F.col(f"_i_{c}")).alias(f"{c}_below") for c in cols])


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Tie-aware AUC = P(s+ > s-) + 0.5 P(s+ = s-) (the average-rank formula)."""
    c = cumulative_below(_counts_by_score(df, score, label), ["pos", "neg"])
    return c.agg((F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))) /
                  (F.sum("pos") * F.sum("neg"))).alias("auc"),
                 F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """sum over distinct thresholds of (delta recall) x precision, scores descending."""
    c = cumulative_below(_counts_by_score(df, score, label), ["pos", "neg"])
    total = c.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()  # two numbers
    tp_ge = F.lit(total["p"]) - F.col("pos_below")
    fp_ge = F.lit(total["n"]) - F.col("neg_below")
    return c.agg((F.sum(F.col("pos") / F.lit(total["p"]) * tp_ge / (tp_ge + fp_ge))).alias("average_precision"))


def precision_at_k(df: DataFrame, score: str, label: str, k: int, tiebreak: Sequence[str]) -> DataFrame:
    top = df.orderBy(F.col(score).desc(), *tiebreak).limit(k)
    base = df.select(F.avg(label)).scalar()
    return top.agg(F.avg(label).alias("precision_at_k"), F.count(F.lit(1)).alias("k")).select(
        "*", (F.col("precision_at_k") / base).alias("lift"))


def standard_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population std, moments as scalar subqueries (one pass each)."""
    m = df.select(F.struct(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                           *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)])).scalar()
    idx = {c: i for i, c in enumerate(cols)}
    return df.select(*[((F.col(c) - m[f"m{idx[c]}"]) / F.nullif(m[f"s{idx[c]}"], F.lit(0.0))).alias(c)
                       if c in idx else F.col(c) for c in df.columns])
