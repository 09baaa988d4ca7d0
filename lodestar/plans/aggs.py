"""Aggregation queries and sort / set queries (2.O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import scalars as S
from lodestar.operators import aggs as A
from lodestar.operators import frames
from lodestar.plans import sqlviews as V
from lodestar.plans.common import cte, rounded
from lodestar.plans.registry import register
from lodestar.plans.scalars import REASONS, apps, prep
from lodestar.sources import conform as C


def _cnt(name="n"):
    return F.count(F.lit(1)).alias(name)


#: event types of the given tables, for the oracle only: the query takes those that the data holds
EVENT_TYPES = "'click', 'error', 'purchase', 'signup', 'view'"


def complaint_quarters(spark, sf):
    f3 = C.complaints(spark, sf)
    return f3.select("*", S.quarter_start("date_received").alias("quarter"))


@register("group_count", section="A", sql=cte(f3=V.F3) + f"""
SELECT institution, CAST({V.quarter_start('date_received')} AS VARCHAR) AS quarter, count(*) AS complaints
FROM f3 WHERE institution IS NOT NULL GROUP BY ALL""")
def q_group_count(spark, sf):
    df = complaint_quarters(spark, sf).where(F.col("institution").isNotNull())
    return rounded(df.groupBy("institution", "quarter").agg(_cnt("complaints")))


@register("group_named_agg", section="A", sql=cte(f4=V.F4) + """
SELECT loan_purpose, count(*) AS n, round(median(original_upb), 6) AS upb_median,
       round(quantile_cont(original_upb, 0.75) - quantile_cont(original_upb, 0.25), 6) AS upb_iqr,
       round(avg(original_rate), 6) AS rate_mean,
       round(avg(CAST(current_delinquency >= 1 AS INTEGER)), 6) AS dq30_rate
FROM f4 GROUP BY 1""")
def q_group_named_agg(spark, sf):
    from lodestar.operators.quantiles import with_quantiles
    lm = C.loan_months(spark, sf)
    agg = lm.groupBy("loan_purpose").agg(_cnt(), F.avg("original_rate").alias("rate_mean"),
                                         F.avg((F.col("current_delinquency") >= 1).cast("int")).alias("dq30_rate"))
    q = with_quantiles(agg, lm, ["loan_purpose"], [("original_upb", 0.5, "upb_median"), ("original_upb", 0.25, "_q1"),
                                                   ("original_upb", 0.75, "_q3")])
    return rounded(q.select("loan_purpose", "n", "upb_median", (F.col("_q3") - F.col("_q1")).alias("upb_iqr"),
                            "rate_mean", "dq30_rate"))


@register("group_approval_rate", section="A", sql=cte(p=V.prep()) + """
SELECT derived_race, round(avg(approved), 6) AS approval_rate, count(*) AS n FROM p GROUP BY 1""")
def q_group_approval_rate(spark, sf):
    return rounded(prep(spark, sf).groupBy("derived_race").agg(F.avg("approved").alias("approval_rate"), _cnt()))


@register("conditional_rate", section="A", sql=cte(f3=V.F3) + """
SELECT institution, round(avg(CAST(coalesce(timely_response = 'Yes', false) AS INTEGER)), 6) AS timely_rate
FROM f3 GROUP BY 1""")
def q_conditional_rate(spark, sf):
    f3 = C.complaints(spark, sf)
    return rounded(f3.groupBy("institution").agg(
        A.conditional_rate(F.col("timely_response") == "Yes").alias("timely_rate")))


@register("value_counts_top", section="A", sql=cte(f3=V.F3) + """
SELECT state, count(*) AS n FROM f3 GROUP BY 1 ORDER BY n DESC, state LIMIT 10""")
def q_value_counts_top(spark, sf):
    f3 = C.complaints(spark, sf)
    return f3.groupBy("state").agg(_cnt()).orderBy(F.col("n").desc(), "state").limit(10)


@register("value_share", section="A", sql=cte(p=V.prep()) + """
, l AS (UNPIVOT (SELECT derived_race, denial_reason_1, denial_reason_2, denial_reason_3, denial_reason_4
                 FROM p WHERE denied = 1)
        ON denial_reason_1, denial_reason_2, denial_reason_3, denial_reason_4 INTO NAME slot VALUE reason)
, c AS (SELECT derived_race, reason, count(*) AS n FROM l WHERE reason IS NOT NULL AND trim(reason) <> '' GROUP BY ALL)
SELECT derived_race, reason, n, round(n * 100.0 / sum(n) OVER (PARTITION BY derived_race), 6) AS pct FROM c""")
def q_value_share(spark, sf):
    df = prep(spark, sf).where(F.col("denied") == 1)
    long = frames.unpivot_nonblank(df, ["derived_race"], REASONS, "slot", "reason")
    return rounded(A.value_share(long, ["derived_race"], "reason"))


@register("count_distinct", section="A", sql=cte(f3=V.F3) + """
SELECT institution, count(DISTINCT company) AS n_companies, count(DISTINCT state) AS n_states,
       count(DISTINCT complaint_id) AS n_complaints FROM f3 GROUP BY 1""")
def q_count_distinct(spark, sf):
    f3 = C.complaints(spark, sf)
    return f3.groupBy("institution").agg(F.countDistinct("company").alias("n_companies"),
                                         F.countDistinct("state").alias("n_states"),
                                         F.countDistinct("complaint_id").alias("n_complaints"))


PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]


@register("exact_quantiles", section="A", sql=cte(f1=V.F1) + """
SELECT institution, """ + ", ".join(
    f"round(quantile_cont(loan_amount, {p}), 6) AS p{int(p * 100)}" for p in PROBS) + """
FROM f1 GROUP BY 1""")
def q_exact_quantiles(spark, sf):
    from lodestar.operators.quantiles import quantiles_wide
    df = apps(spark, sf)
    return rounded(quantiles_wide(df, "loan_amount", PROBS, [f"p{int(p * 100)}" for p in PROBS], ["institution"]))


@register("describe_groups", section="A", sql=cte(f3=V.F3) + f"""
, g AS (SELECT institution, {V.quarter_start('date_received')} AS quarter, count(*) AS complaints FROM f3 GROUP BY ALL)
SELECT institution, count(*) AS count, round(avg(complaints), 6) AS mean, round(stddev_samp(complaints), 6) AS std,
       min(complaints) AS min, round(quantile_cont(complaints, 0.25), 6) AS q25,
       round(quantile_cont(complaints, 0.5), 6) AS q50, round(quantile_cont(complaints, 0.75), 6) AS q75,
       max(complaints) AS max FROM g GROUP BY 1""")
def q_describe_groups(spark, sf):
    g = complaint_quarters(spark, sf).groupBy("institution", "quarter").agg(_cnt("complaints"))
    return rounded(A.describe(g, ["institution"], "complaints"))


@register("pivot_counts", section="A", sql=cte(f1=V.F1)
          + " PIVOT f1 ON activity_year IN (1995, 1996, 1997, 1998, 1999, 2000, 2001) USING count(*) GROUP BY institution")
def q_pivot_counts(spark, sf):
    """One column per year that the data holds (the oracle lists the years of the given tables, so that a view can hold it)."""
    return apps(spark, sf).groupBy("institution").pivot("activity_year").count().fillna(0)


@register("pivot_gap", section="A", sql=cte(p=V.prep()) + """
SELECT institution, round(avg(CASE WHEN is_black = 0 THEN approved END), 6) AS rate_other,
       round(avg(CASE WHEN is_black = 1 THEN approved END), 6) AS rate_protected,
       round(avg(CASE WHEN is_black = 0 THEN approved END) - avg(CASE WHEN is_black = 1 THEN approved END), 6) AS gap
FROM p GROUP BY 1""")
def q_pivot_gap(spark, sf):
    df = prep(spark, sf)
    pv = df.groupBy("institution").pivot("is_black", [0, 1]).agg(F.avg("approved"))
    return rounded(pv.select("institution", F.col("0").alias("rate_other"), F.col("1").alias("rate_protected"),
                             (F.col("0") - F.col("1")).alias("gap")))


@register("resample_quarter_mean", section="A", sql="""
WITH e AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS period, event_type, value FROM events)
PIVOT e ON event_type IN ({EVENTS}) USING round(avg(value), 6) GROUP BY period""".replace("{EVENTS}", EVENT_TYPES))
def q_resample_quarter_mean(spark, sf):
    # events span 30 days, so the resample period here is the day; one column per series that the data holds
    return rounded(A.resample_mean_wide(C.macro_long(spark, sf), "series", "date", "value", period="day"))


@register("date_span", section="A", sql=cte(p=V.F2) + """
SELECT CAST(min(REPDTE) AS VARCHAR) AS first_date, CAST(max(REPDTE) AS VARCHAR) AS last_date,
       count(DISTINCT CERT) AS n_entities, count(*) AS n_rows FROM p""")
def q_date_span(spark, sf):
    p = C.bank_panel(spark, sf)
    return rounded(p.agg(F.min("REPDTE").alias("first_date"), F.max("REPDTE").alias("last_date"),
                         F.countDistinct("CERT").alias("n_entities"), _cnt("n_rows")))


@register("pearson_corr", section="A", sql=cte(f1=V.F1) + """
SELECT institution, round(corr(loan_amount, income), 6) AS corr_amount_income FROM f1 GROUP BY 1""")
def q_pearson_corr(spark, sf):
    return rounded(apps(spark, sf).groupBy("institution").agg(F.corr("loan_amount", "income")
                                                              .alias("corr_amount_income")))


@register("missingness_audit", section="A", sql=cte(p=V.prep()) + """
SELECT institution, round(avg(CAST(combined_loan_to_value_ratio IS NULL AS INTEGER)), 6) AS miss_ltv,
       round(avg(CAST(dti_mid IS NULL AS INTEGER)), 6) AS miss_dti,
       round(avg(CAST(log_income IS NULL AS INTEGER)), 6) AS miss_income FROM p GROUP BY 1""")
def q_missingness_audit(spark, sf):
    df = prep(spark, sf)
    return rounded(A.missingness(df, ["institution"], {"combined_loan_to_value_ratio": "miss_ltv",
                                                        "dti_mid": "miss_dti", "log_income": "miss_income"}))


PRE_POST_SQL = cte(f3=V.F3) + f"""
, c AS (SELECT product,
          CAST(sum(CASE WHEN date_received < DATE '{C.COMPLAINT_POST_CUT}' THEN 1 ELSE 0 END) AS BIGINT) AS pre,
          CAST(sum(CASE WHEN date_received >= DATE '{C.COMPLAINT_POST_CUT}' THEN 1 ELSE 0 END) AS BIGINT) AS post
        FROM f3 WHERE institution = '{C.TREATED_INSTITUTION}' GROUP BY 1)
SELECT product, pre, post, post - pre AS change,
       round((post - pre) * 100.0 / NULLIF((SELECT sum(post - pre) FROM c), 0), 6) AS pct_of_total_change FROM c"""


@register("pre_post_breakdown", section="A", sql=PRE_POST_SQL)
def q_pre_post_breakdown(spark, sf):
    f3 = C.complaints(spark, sf).where(F.col("institution") == C.TREATED_INSTITUTION)
    return rounded(A.pre_post_breakdown(f3, "product", "date_received", C.COMPLAINT_POST_CUT))


@register("concurrent_reason_share", section="A", sql=cte(f1=V.F1) + """
, d AS (SELECT institution,
          coalesce(denial_reason_1 = '3' OR denial_reason_2 = '3' OR denial_reason_3 = '3' OR denial_reason_4 = '3', false) AS flagged,
          """ + " + ".join(f"CAST(coalesce(denial_reason_{k} IS NOT NULL AND trim(denial_reason_{k}) <> '', false) AS INTEGER)"
                          for k in range(1, 5)) + """ AS n_reasons
        FROM f1 WHERE action_taken = 3 AND activity_year BETWEEN 1996 AND 2000)
SELECT institution, count(*) AS n_flagged, round(avg(CAST(n_reasons = 1 AS INTEGER)), 6) AS only_reason_share,
       round(avg(n_reasons), 6) AS mean_reasons FROM d WHERE flagged GROUP BY 1""")
def q_concurrent_reason_share(spark, sf):
    # the documented intent (denied AND in the year range), not the operator-precedence slip
    df = apps(spark, sf).where((F.col("action_taken") == 3) & F.col("activity_year").between(1996, 2000))
    d = df.select("institution", S.row_any_equals(REASONS, 3).alias("flagged"),
                  S.row_count_nonblank(REASONS).alias("n_reasons")).where("flagged")
    return rounded(d.groupBy("institution").agg(_cnt("n_flagged"),
                                                F.avg((F.col("n_reasons") == 1).cast("int")).alias("only_reason_share"),
                                                F.avg("n_reasons").alias("mean_reasons")))


@register("distinct_rows", section="A", sql=f"""
SELECT DISTINCT l_suppkey AS CERT, CAST({V.quarter_start('l_shipdate')} AS VARCHAR) AS quarter
FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 40""")
def q_distinct_rows(spark, sf):
    li = C.read(spark, sf, "lineitem", "l_suppkey", "l_returnflag", "l_quantity", "l_shipdate")
    f = li.where((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 40))
    return rounded(f.select(F.col("l_suppkey").alias("CERT"), S.quarter_start("l_shipdate").alias("quarter"))
                   .distinct())


# ---------------------------------------------------------------- 2.O sorts / set ops

@register("sort_multi", section="O", sql=cte(f3=V.F3) + f"""
SELECT institution, product, CAST({V.quarter_start('date_received')} AS VARCHAR) AS quarter, count(*) AS n
FROM f3 GROUP BY ALL ORDER BY institution, product, quarter""")
def q_sort_multi(spark, sf):
    g = complaint_quarters(spark, sf).groupBy("institution", "product", "quarter").agg(_cnt())
    return rounded(g.orderBy("institution", "product", "quarter"))


@register("top_k", section="O", sql=cte(p=V.F2) + """
SELECT CERT, CAST(REPDTE AS VARCHAR) AS REPDTE, round(ASSET, 6) AS ASSET FROM p
ORDER BY ASSET DESC, CERT, REPDTE LIMIT 20""")
def q_top_k(spark, sf):
    p = C.bank_panel(spark, sf)
    return rounded(p.select("CERT", "REPDTE", "ASSET").orderBy(F.col("ASSET").desc(), "CERT", "REPDTE").limit(20))


@register("top_levels_filter", section="O", sql=cte(f1=V.F1) + """
, t AS (SELECT state_code FROM f1 GROUP BY 1 ORDER BY count(*) DESC, state_code LIMIT 8)
SELECT state_code, count(*) AS n, round(avg(loan_amount), 6) AS mean_amount FROM f1
WHERE state_code IN (SELECT state_code FROM t) GROUP BY 1""")
def q_top_levels_filter(spark, sf):
    df = apps(spark, sf)
    top = A.top_levels(df, "state_code", 8)
    kept = df.join(F.broadcast(top), "state_code", "left_semi")
    return rounded(kept.groupBy("state_code").agg(_cnt(), F.avg("loan_amount").alias("mean_amount")))


@register("union_common", section="O", sql=cte(f1=V.F1) + """
SELECT institution, activity_year, count(*) AS n FROM (
  SELECT institution, activity_year, loan_amount FROM f1 WHERE activity_year <= 1997
  UNION ALL SELECT institution, activity_year, loan_amount FROM f1 WHERE activity_year > 1997) GROUP BY ALL""")
def q_union_common(spark, sf):
    df = apps(spark, sf)
    a = df.where(F.col("activity_year") <= 1997).select("institution", "activity_year", "loan_amount", "income")
    b = df.where(F.col("activity_year") > 1997).select("loan_amount", "activity_year", "institution", "state_code")
    return frames.union_common(a, b).groupBy("institution", "activity_year").agg(_cnt())


@register("seeded_sample", section="O", sql="""
SELECT doc_id, source, n_chars FROM documents ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '42')), doc_id LIMIT 50""")
def q_seeded_sample(spark, sf):
    """Deterministic n-row sample: smallest MD5 of key and seed; a TakeOrdered, no global sort."""
    docs = C.read(spark, sf, "documents", "doc_id", "source", "n_chars")
    return A.seeded_sample(docs, ["doc_id"], 50, seed=42)


@register("group_mean_sum_count", section="A", sql="""
WITH d AS (SELECT institution, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter_dt, count(*) AS complaints
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
           JOIN (SELECT r_regionkey, r_name AS institution FROM region) r ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT institution, CAST(quarter_dt >= DATE '""" + C.COMPLAINT_POST_CUT + """' AS INTEGER) AS post,
       round(avg(complaints), 6) AS mean, CAST(sum(complaints) AS BIGINT) AS sum, count(*) AS count FROM d GROUP BY ALL""")
def q_group_mean_sum_count(spark, sf):
    from lodestar.plans.windows import did_panel
    d = did_panel(spark, sf)
    return rounded(d.groupBy("institution", "post").agg(F.avg("complaints").alias("mean"),
                                                       F.sum("complaints").cast("long").alias("sum"),
                                                       F.count(F.lit(1)).alias("count")))
