"""Complaint panels: entity x quarter counts, DiD panel, coverage diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import scalars as S
from lodestar.operators import windows as W


def complaint_panel(sparse: DataFrame, densify: bool = False) -> DataFrame:
    """CERT x quarter counts with row-based lags 1 / 4 and smoothed growth.

    Input is already aggregated (one row per CERT x quarter), so the window's
    partition is bounded by the number of quarters, whatever the raw volume.
    """
    if densify:  # calendar lags: insert empty quarters (count 0) between an entity's first and last
        sparse = W.densify(sparse, "CERT", "quarter").fillna(0, subset=["complaint_count"])
    w = W.entity_window("CERT", "quarter")
    return sparse.select(
        "CERT", "quarter", "complaint_count", "timely_response",
        S.quarter_label("quarter").alias("quarter_str"),
        W.lag_k("complaint_count", 1, w).cast("double").alias("complaint_lag1"),
        W.lag_k("complaint_count", 4, w).cast("double").alias("complaint_lag4"),
        W.smoothed_growth("complaint_count", w).alias("complaint_growth"))


def did_panel(complaints: DataFrame, treated: str, post_cut: str) -> DataFrame:
    """institution x quarter counts with treat, post (quarter START >= cut) and log1p."""
    df = complaints.where(F.col("institution").isNotNull())
    g = df.groupBy("institution", S.quarter_start("date_received").alias("quarter_dt")).agg(
        F.count(F.lit(1)).alias("complaints"))
    return g.select(
        "institution", "quarter_dt", "complaints",
        S.quarter_label("quarter_dt").alias("quarter_str"),
        (F.col("institution") == treated).cast("int").alias("treat"),
        (F.col("quarter_dt") >= F.lit(post_cut).cast("date")).cast("int").alias("post"),
        F.log1p("complaints").alias("log_complaints"))


def mean_growth(panel: DataFrame, entity: str, order: str, value: str, before: str) -> DataFrame:
    """Average quarter-on-quarter % change per entity over the pre-period."""
    pre = panel.where(F.col(order) < F.lit(before).cast("date"))
    w = W.entity_window(entity, order)
    g = pre.select(entity, W.pct_change_pad(value, w).alias("_g"))
    return g.groupBy(entity).agg((F.avg("_g") * 100).alias("avg_qoq_pct"))


def velocity(complaints: DataFrame, include_current: bool = True, exclude: str | None = "Other") -> DataFrame:
    """institution x product x quarter counts with rolling 4-row z-score."""
    df = complaints.where(F.col("institution").isNotNull() & F.col("product").isNotNull())
    if exclude is not None:
        df = df.where(F.col("institution") != exclude)
    g = df.groupBy("institution", "product", S.quarter_start("date_received").alias("quarter")).agg(
        F.count(F.lit(1)).alias("count"))
    return W.velocity_zscore(g, "count", ["institution", "product"], "quarter", include_current=include_current)


def distress_coverage(panel: DataFrame, features: DataFrame, threshold: float = 100.0,
                      viable_at: int = 300) -> tuple[DataFrame, DataFrame]:
    """Left-join the complaint panel to distressed bank-quarters with an indicator.

    Returns (overlap rows with ``distressed`` 0/1, one-row summary)."""
    dist = (features.where(F.col("texas_ratio") > threshold)
            .select("CERT", S.quarter_start("REPDTE").alias("quarter")).distinct()
            .withColumn("distressed", F.lit(1)))
    overlap = panel.join(dist, ["CERT", "quarter"], "left").select(
        "CERT", "quarter", "complaint_count", F.coalesce("distressed", F.lit(0)).alias("distressed"))
    n_total = dist.select(F.count(F.lit(1))).scalar()
    summary = overlap.agg(
        F.sum("distressed").cast("long").alias("n_distressed_covered"),
        F.countDistinct(F.when(F.col("distressed") == 1, F.col("CERT"))).alias("n_certs_covered"),
    ).select("*", n_total.alias("n_distressed_total"))
    summary = summary.select(
        "*", S.safe_ratio(F.col("n_distressed_covered") * 100.0, F.col("n_distressed_total")).alias("coverage_pct"),
        F.when(F.col("n_distressed_covered") > viable_at, "VIABLE").otherwise("LOW COVERAGE").alias("verdict"))
    return overlap, summary
