"""Window queries and the complaint panels they feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import complaints as CP
from lodestar.operators import quantiles as Q
from lodestar.operators import windows as W
from lodestar.plans import sqlviews as V
from lodestar.plans.common import cte, rounded
from lodestar.plans.registry import register
from lodestar.plans.risk import features_sql
from lodestar.plans.scalars import apps, prep
from lodestar.sources import conform as C

PANEL_SQL = f"""
SELECT CERT, quarter, complaint_count, timely_response,
       CAST(year(quarter) AS VARCHAR) || 'Q' || CAST(quarter(quarter) AS VARCHAR) AS quarter_str,
       CAST(lag(complaint_count, 1) OVER w AS DOUBLE) AS complaint_lag1,
       CAST(lag(complaint_count, 4) OVER w AS DOUBLE) AS complaint_lag4,
       (complaint_count - lag(complaint_count, 1) OVER w) / (lag(complaint_count, 1) OVER w + 1) AS complaint_growth
FROM ({V.F3B}) s WINDOW w AS (PARTITION BY CERT ORDER BY quarter)"""

DID_SQL = f"""
SELECT institution, quarter_dt, complaints,
       CAST(year(quarter_dt) AS VARCHAR) || 'Q' || CAST(quarter(quarter_dt) AS VARCHAR) AS quarter_str,
       CAST(institution = '{C.TREATED_INSTITUTION}' AS INTEGER) AS treat,
       CAST(quarter_dt >= DATE '{C.COMPLAINT_POST_CUT}' AS INTEGER) AS post,
       ln(1 + complaints) AS log_complaints
FROM (SELECT institution, {V.quarter_start('date_received')} AS quarter_dt, count(*) AS complaints
      FROM ({V.F3}) f3 WHERE institution IS NOT NULL GROUP BY ALL) g"""


def complaint_panel(spark, sf):
    return CP.complaint_panel(C.sparse_complaints(spark, sf))


def did_panel(spark, sf):
    return CP.did_panel(C.complaints(spark, sf), C.TREATED_INSTITUTION, C.COMPLAINT_POST_CUT)


@register("complaint_panel", section="Q", sql=cte(p=PANEL_SQL) + """
SELECT CERT, CAST(quarter AS VARCHAR) AS quarter, complaint_count, round(timely_response, 6) AS timely_response,
       quarter_str, complaint_lag1, complaint_lag4, round(complaint_growth, 6) AS complaint_growth FROM p""")
def q_complaint_panel(spark, sf):
    return rounded(complaint_panel(spark, sf))


@register("lag_k", section="W", sql=cte(p=PANEL_SQL) + """
SELECT CERT, CAST(quarter AS VARCHAR) AS quarter, complaint_lag1, complaint_lag4 FROM p""")
def q_lag_k(spark, sf):
    return rounded(complaint_panel(spark, sf).select("CERT", "quarter", "complaint_lag1", "complaint_lag4"))


@register("smoothed_growth", section="W", sql=cte(p=PANEL_SQL) + """
SELECT CERT, CAST(quarter AS VARCHAR) AS quarter, round(complaint_growth, 6) AS complaint_growth FROM p""")
def q_smoothed_growth(spark, sf):
    return rounded(complaint_panel(spark, sf).select("CERT", "quarter", "complaint_growth"))


@register("did_panel", section="Q", sql=cte(d=DID_SQL) + """
SELECT institution, CAST(quarter_dt AS VARCHAR) AS quarter_dt, complaints, quarter_str, treat, post,
       round(log_complaints, 6) AS log_complaints FROM d""")
def q_did_panel(spark, sf):
    return rounded(did_panel(spark, sf))


@register("mean_growth", section="W", sql=cte(d=DID_SQL) + f"""
SELECT institution, round(avg(g) * 100, 6) AS avg_qoq_pct FROM (
  SELECT institution, complaints / lag(complaints) OVER (PARTITION BY institution ORDER BY quarter_dt) - 1 AS g
  FROM d WHERE quarter_dt < DATE '1998-01-01') GROUP BY 1""")
def q_mean_growth(spark, sf):
    return rounded(CP.mean_growth(did_panel(spark, sf), "institution", "quarter_dt", "complaints", "1998-01-01"))


VELOCITY_SQL = cte(f3=V.F3) + f"""
, g AS (SELECT institution, product, {V.quarter_start('date_received')} AS quarter, count(*) AS count
        FROM f3 WHERE institution IS NOT NULL AND product IS NOT NULL AND institution <> 'Other' GROUP BY ALL)
, r AS (SELECT *, CASE WHEN count(count) OVER w >= 2 THEN avg(count) OVER w END AS rolling_mean,
                  CASE WHEN count(count) OVER w >= 2 THEN stddev_samp(count) OVER w END AS rolling_std
        FROM g WINDOW w AS (PARTITION BY institution, product ORDER BY quarter ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
, z AS (SELECT *, (count - rolling_mean) / NULLIF(rolling_std, 0) AS z_score FROM r)
SELECT institution, product, CAST(quarter AS VARCHAR) AS quarter, count, round(rolling_mean, 6) AS rolling_mean,
       round(rolling_std, 6) AS rolling_std, round(z_score, 6) AS z_score,
       CAST(coalesce(z_score > 2.0, false) AS INTEGER) AS rising_flag FROM z"""


@register("velocity_zscore", section="W", sql=VELOCITY_SQL)
def q_velocity_zscore(spark, sf):
    return rounded(CP.velocity(C.complaints(spark, sf)))


@register("rolling_stats", section="W", sql=VELOCITY_SQL.replace(
    "SELECT institution, product, CAST(quarter AS VARCHAR) AS quarter, count, round(rolling_mean, 6) AS rolling_mean,\n"
    "       round(rolling_std, 6) AS rolling_std, round(z_score, 6) AS z_score,\n"
    "       CAST(coalesce(z_score > 2.0, false) AS INTEGER) AS rising_flag FROM z",
    "SELECT institution, product, CAST(quarter AS VARCHAR) AS quarter, round(rolling_mean, 6) AS rolling_mean,\n"
    "       round(rolling_std, 6) AS rolling_std FROM z"))
def q_rolling_stats(spark, sf):
    return rounded(CP.velocity(C.complaints(spark, sf)).select("institution", "product", "quarter",
                                                                "rolling_mean", "rolling_std"))


@register("within_demean", section="W", sql=cte(p=V.prep()) + """
SELECT county_code, round(sum(approved_dm * is_black_dm), 6) AS sxy, round(sum(is_black_dm * is_black_dm), 6) AS sxx,
       count(*) AS n FROM (
  SELECT county_code, approved - avg(approved) OVER (PARTITION BY county_code) AS approved_dm,
         is_black - avg(is_black) OVER (PARTITION BY county_code) AS is_black_dm FROM p) GROUP BY 1""")
def q_within_demean(spark, sf):
    d = W.within_demean(prep(spark, sf), ["approved", "is_black"], "county_code")
    return rounded(d.groupBy("county_code").agg(
        F.sum(F.col("approved_dm") * F.col("is_black_dm")).alias("sxy"),
        F.sum(F.col("is_black_dm") * F.col("is_black_dm")).alias("sxx"), F.count(F.lit(1)).alias("n")))


FIRST_ORDER = ["report_seq", "report_period", "l_partkey", "l_suppkey", "original_upb"]


@register("first_per_key", section="W", sql=cte(f4=V.F4) + """
SELECT loan_id, report_seq, CAST(report_period AS VARCHAR) AS report_period, fico, round(original_upb, 6) AS original_upb
FROM (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY report_seq, report_period, l_partkey, l_suppkey,
                                   original_upb) AS rn FROM f4) WHERE rn = 1""")
def q_first_per_key(spark, sf):
    lm = C.loan_months(spark, sf)
    first = W.first_per_key(lm, ["loan_id"], FIRST_ORDER)
    return rounded(first.select("loan_id", "report_seq", "report_period", "fico", "original_upb"))


@register("qcut_bucket", section="W", sql=cte(f1=V.F1) + """
, e AS (SELECT institution, min(loan_amount) AS lo, max(loan_amount) AS hi,
               quantile_cont(loan_amount, [0.25, 0.5, 0.75]) AS qs FROM f1 GROUP BY 1)
SELECT f1.institution, CAST(len(list_filter(list_distinct(qs), lambda x: x > lo AND x < hi AND x < loan_amount)) AS INTEGER) AS bucket,
       count(*) AS n, round(min(loan_amount), 6) AS min_amount, round(max(loan_amount), 6) AS max_amount
FROM f1 JOIN e ON f1.institution = e.institution GROUP BY ALL""")
def q_qcut_bucket(spark, sf):
    b = Q.qcut(apps(spark, sf), "loan_amount", 4, by=["institution"], duplicates="drop")
    return rounded(b.groupBy("institution", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("loan_amount").alias("min_amount"),
        F.max("loan_amount").alias("max_amount")))


@register("quantile_flags", section="W", sql=cte(p=V.prep()) + """
, q AS (SELECT quantile_cont(loan_amount, 0.25) AS p25, quantile_cont(loan_amount, 0.75) AS p75 FROM p)
SELECT institution, CAST(sum(CAST(loan_amount <= p25 AS INTEGER)) AS BIGINT) AS n_small,
       CAST(sum(CAST(loan_amount >= p75 AS INTEGER)) AS BIGINT) AS n_large FROM p, q GROUP BY 1""")
def q_quantile_flags(spark, sf):
    df = Q.quantile_flags(prep(spark, sf), "loan_amount", 0.25, 0.75)
    return df.groupBy("institution").agg(F.sum("is_small").cast("long").alias("n_small"),
                                         F.sum("is_large").cast("long").alias("n_large"))


@register("share_of_total", section="W", sql=cte(f3=V.F3) + """
SELECT product, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM f3), 6) AS share FROM f3 GROUP BY 1""")
def q_share_of_total(spark, sf):
    g = C.complaints(spark, sf).groupBy("product").agg(F.count(F.lit(1)).alias("n"))
    return rounded(W.share_of_total(g, "n"))


@register("distress_coverage", section="Q", sql=cte(p=PANEL_SQL, f=features_sql("api")) + """
, d AS (SELECT DISTINCT CERT, CAST(date_trunc('quarter', REPDTE) AS DATE) AS quarter, 1 AS distressed
        FROM f WHERE texas_ratio > 100)
, o AS (SELECT p.CERT, p.quarter, coalesce(d.distressed, 0) AS distressed FROM p LEFT JOIN d
        ON p.CERT = d.CERT AND p.quarter = d.quarter)
SELECT CAST(sum(distressed) AS BIGINT) AS n_distressed_covered,
       count(DISTINCT CASE WHEN distressed = 1 THEN CERT END) AS n_certs_covered,
       (SELECT count(*) FROM d) AS n_distressed_total,
       round(sum(distressed) * 100.0 / NULLIF((SELECT count(*) FROM d), 0), 6) AS coverage_pct,
       CASE WHEN sum(distressed) > 300 THEN 'VIABLE' ELSE 'LOW COVERAGE' END AS verdict FROM o""")
def q_distress_coverage(spark, sf):
    from lodestar.operators import risk as R
    feats = R.camels_ratios(C.bank_panel(spark, sf), "api")
    _, summary = CP.distress_coverage(complaint_panel(spark, sf), feats)
    return rounded(summary)


@register("join_left_indicator", section="J", sql=cte(p=PANEL_SQL, f=features_sql("api")) + """
, d AS (SELECT DISTINCT CERT, CAST(date_trunc('quarter', REPDTE) AS DATE) AS quarter, 1 AS distressed
        FROM f WHERE texas_ratio > 100)
SELECT p.CERT, CAST(p.quarter AS VARCHAR) AS quarter, p.complaint_count, coalesce(d.distressed, 0) AS distressed
FROM p LEFT JOIN d ON p.CERT = d.CERT AND p.quarter = d.quarter""")
def q_join_left_indicator(spark, sf):
    from lodestar.operators import risk as R
    feats = R.camels_ratios(C.bank_panel(spark, sf), "api")
    overlap, _ = CP.distress_coverage(complaint_panel(spark, sf), feats)
    return rounded(overlap)
