"""Domain conform queries and served views, as DataFrames."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import scalars as S
from lodestar.operators import frames, glm
from lodestar.operators import risk as R
from lodestar.operators import windows as W
from lodestar.plans import sqlviews as V
from lodestar.plans.common import cte, rounded
from lodestar.plans.registry import register
from lodestar.plans.risk import WATCH_SQL, features, features_sql
from lodestar.plans.scalars import PROXY_PEER_KEYWORDS, PROXY_SUBJECT_KEYWORDS, _kw_sql, apps, prep
from lodestar.plans.stats import logit_2x2_sql
from lodestar.plans.windows import DID_SQL, did_panel
from lodestar.sources import conform as C


@register("hmda_conform", section="Q", sql=cte(f1=V.F1) + """
SELECT CASE WHEN institution = 'MIDDLE EAST' THEN 'EUROPE' ELSE institution END AS institution, activity_year,
       count(*) AS n, CAST(sum(CAST(action_taken = 1 AS INTEGER)) AS BIGINT) AS approved,
       CAST(sum(CAST(action_taken = 3 AS INTEGER)) AS BIGINT) AS denied
FROM f1 GROUP BY ALL""")
def q_hmda_conform(spark, sf):
    """Per-year extracts with differing columns -> union on common columns, predecessor remap, flags."""
    df = apps(spark, sf)
    early = df.where(F.col("activity_year") < 1998).drop("loan_term")
    late = df.where(F.col("activity_year") >= 1998).drop("occupancy_type")
    u = frames.union_common(early, late)
    alias = frames.lookup_table(spark, {"MIDDLE EAST": "EUROPE"}, "pred", "succ")
    u = u.join(F.broadcast(alias), u.institution == alias.pred, "left") \
        .withColumn("institution", F.coalesce("succ", "institution")).drop("pred", "succ")
    return u.groupBy("institution", "activity_year").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("action_taken") == 1).cast("int")).cast("long").alias("approved"),
        F.sum((F.col("action_taken") == 3).cast("int")).cast("long").alias("denied"))


FEAT_COLS = ["approved", "dti_mid", "log_income", "log_loan_amount", "is_black", "is_hispanic", "is_asian",
             "purpose_purchase", "purpose_refi", "purpose_cashout"]


@register("application_features", section="Q", sql="WITH p AS (" + V.prep() + ")\nSELECT institution, count(*) AS n, "
          + ", ".join(f"round(avg({c}), 6) AS {c}" for c in FEAT_COLS) + " FROM p GROUP BY 1")
def q_application_features(spark, sf):
    return rounded(prep(spark, sf).groupBy("institution").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in FEAT_COLS]))


@register("complaint_filter", section="Q", sql=cte(f3=V.F3) + f"""
, k AS (SELECT *, coalesce({_kw_sql('company', PROXY_SUBJECT_KEYWORDS)}, false) AS is_subject,
               coalesce({_kw_sql('company', PROXY_PEER_KEYWORDS)}, false) AS is_peer FROM f3)
SELECT CAST(year(date_received) AS INTEGER) AS year, company, CAST(is_subject AS INTEGER) AS is_subject, count(*) AS n
FROM k WHERE is_subject OR is_peer GROUP BY ALL""")
def q_complaint_filter(spark, sf):
    f3 = C.complaints(spark, sf)
    k = f3.select("*", S.keyword_any("company", PROXY_SUBJECT_KEYWORDS).alias("is_subject"),
                  S.keyword_any("company", PROXY_PEER_KEYWORDS).alias("is_peer"))
    k = k.where(F.col("is_subject") | F.col("is_peer"))
    return k.groupBy(F.year("date_received").alias("year"), "company",
                     F.col("is_subject").cast("int").alias("is_subject")).agg(F.count(F.lit(1)).alias("n"))


GSE_FIRST = ["report_seq", "report_period", "l_partkey", "l_suppkey", "original_upb"]


@register("gse_conform", section="Q", sql=cte(f4=V.F4) + """
, d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY report_seq, report_period, l_partkey,
          l_suppkey, original_upb) AS rn FROM f4) WHERE rn = 1)
SELECT CAST(TRY_CAST(right(first_payment_date, 4) AS INTEGER) AS INTEGER) AS orig_year, loan_purpose,
       count(*) AS n, count(CASE WHEN fico BETWEEN 300 AND 850 THEN fico END) AS n_valid_fico,
       round(avg(CASE WHEN fico BETWEEN 300 AND 850 THEN fico END), 6) AS fico_mean,
       CAST(sum(CAST(original_upb < 150000 AS INTEGER)) AS BIGINT) AS n_small FROM d GROUP BY ALL""")
def q_gse_conform(spark, sf):
    lm = C.loan_months(spark, sf)
    d = W.first_per_key(lm, ["loan_id"], GSE_FIRST)
    fico = F.when(F.col("fico").between(300, 850), F.col("fico"))
    d = d.select("*", S.year_from_mmyyyy("first_payment_date").alias("orig_year"), fico.alias("fico_ok"))
    return rounded(d.groupBy("orig_year", "loan_purpose").agg(
        F.count(F.lit(1)).alias("n"), F.count("fico_ok").alias("n_valid_fico"), F.avg("fico_ok").alias("fico_mean"),
        F.sum((F.col("original_upb") < 150000).cast("int")).cast("long").alias("n_small")))


@register("gse_cross_quarter_dedup", section="Q", sql=cte(f4=V.F4) + """
SELECT source_year, count(*) AS n_loans FROM (
  SELECT loan_id, min(source_year) AS source_year FROM f4 GROUP BY 1) GROUP BY 1""")
def q_gse_cross_quarter_dedup(spark, sf):
    lm = C.loan_months(spark, sf).select("loan_id", "source_year", *GSE_FIRST)
    first = W.first_per_key(lm, ["loan_id"], ["source_year", *GSE_FIRST])
    return first.groupBy("source_year").agg(F.count(F.lit(1)).alias("n_loans"))


@register("risk_tier", section="P", sql=cte(f=features_sql()) + f"""
SELECT CASE WHEN texas_ratio IS NULL THEN NULL WHEN texas_ratio > 100 THEN 'Distressed'
            WHEN texas_ratio > 50 THEN 'Elevated' ELSE 'Healthy' END AS texas_tier, count(*) AS n FROM f GROUP BY 1""")
def q_risk_tier(spark, sf):
    return features(spark, sf).groupBy(S.risk_tier_texas("texas_ratio").alias("texas_tier")).agg(
        F.count(F.lit(1)).alias("n"))


@register("view_watchlist", section="Q", sql="WITH w AS (" + WATCH_SQL + """)
SELECT CERT, STNAME, distress_prob, texas_ratio,
       CASE WHEN distress_prob >= 0.15 THEN 'High' WHEN distress_prob >= 0.05 THEN 'Elevated' ELSE 'Watch' END AS tier
FROM w""")
def q_view_watchlist(spark, sf):
    w = rounded(R.watchlist(features(spark, sf)))
    return w.select("CERT", "STNAME", "distress_prob", "texas_ratio", S.risk_tier_prob("distress_prob").alias("tier"))


@register("view_watchlist_entity", section="Q", sql=cte(f=features_sql("api")) + """
SELECT CERT, CAST(REPDTE AS VARCHAR) AS REPDTE, round(texas_ratio, 6) AS texas_ratio,
       CAST(count(*) OVER (PARTITION BY CERT) AS BIGINT) AS n_distressed_quarters FROM f WHERE texas_ratio > 100""")
def q_view_watchlist_entity(spark, sf):
    """Per-entity distress rows, served for every entity (a lookup is a filter on CERT)."""
    f = features(spark, sf, texas_rule="api").where(F.col("texas_ratio") > 100)
    n = f.groupBy("CERT").agg(F.count(F.lit(1)).alias("n_distressed_quarters"))
    return rounded(f.join(n, "CERT").select("CERT", "REPDTE", "texas_ratio", "n_distressed_quarters"))


@register("view_fair_lending", section="Q", sql="WITH p AS (" + V.prep() + "), z AS (WITH p2 AS (SELECT 1)"
          + logit_2x2_sql("p", ["institution"], "approved", "is_black") + """)
SELECT institution, odds_ratio, round((1 - odds_ratio) * 100, 6) AS gap_pct FROM z WHERE term = 'is_black'""")
def q_view_fair_lending(spark, sf):
    fit = glm.term(glm.logit(prep(spark, sf), "approved", ["is_black"], by=["institution"]), "is_black")
    out = rounded(fit.select("institution", "odds_ratio"))
    return out.select("*", F.round((1 - F.col("odds_ratio")) * 100, 6).alias("gap_pct")).orderBy("odds_ratio")


@register("view_complaints", section="Q", sql=cte(d=DID_SQL) + """
SELECT institution, post, round(avg(complaints), 6) AS mean_complaints, CAST(sum(complaints) AS BIGINT) AS total,
       count(*) AS n_quarters FROM d GROUP BY ALL""")
def q_view_complaints(spark, sf):
    d = did_panel(spark, sf)
    return rounded(d.groupBy("institution", "post").agg(F.avg("complaints").alias("mean_complaints"),
                                                       F.sum("complaints").cast("long").alias("total"),
                                                       F.count(F.lit(1)).alias("n_quarters")))


@register("view_bank_history", section="Q", sql=cte(p=V.F2) + """
SELECT CERT, INSTNAME AS name, CAST(REPDTE AS VARCHAR) AS date,
       round(NCLNLS / (EQ + NULLIF(LNLSNTV, 0)) * 100, 6) AS texas_ratio,
       round(NETINC / NULLIF(ASSET, 0) * 100, 6) AS roa, round(ASSET / 1000, 6) AS assets_m,
       round(RBCT1J / NULLIF(ASSET, 0) * 100, 6) AS tier1_leverage,
       CAST(REPDTE = max(REPDTE) OVER (PARTITION BY CERT) AS INTEGER) AS is_latest
FROM p""")
def q_view_bank_history(spark, sf):
    """Ordered ratio history with the latest row flagged, for every bank (a lookup is a filter on CERT)."""
    p = C.bank_panel(spark, sf)
    last = p.groupBy("CERT").agg(F.max("REPDTE").alias("_last"))
    p = p.join(last, "CERT")
    return rounded(p.select("CERT", F.col("INSTNAME").alias("name"), F.col("REPDTE").alias("date"),
                            R.texas_ratio("api").alias("texas_ratio"), S.safe_ratio("NETINC", "ASSET", 100.0).alias("roa"),
                            (F.col("ASSET") / 1000).alias("assets_m"),
                            S.safe_ratio("RBCT1J", "ASSET", 100.0).alias("tier1_leverage"),
                            (F.col("REPDTE") == F.col("_last")).cast("int").alias("is_latest")))


@register("view_headline_stats", section="Q", sql=cte(p=V.F2, f3=V.F3, f1=V.F1) + """
SELECT (SELECT count(*) FROM p) AS bank_rows, (SELECT count(DISTINCT CERT) FROM p) AS banks,
       (SELECT count(*) FROM f3) AS complaints, (SELECT count(*) FROM f1) AS applications,
       (SELECT count(DISTINCT institution) FROM f1) AS institutions""")
def q_view_headline_stats(spark, sf):
    p = C.bank_panel(spark, sf)
    f1 = apps(spark, sf)
    stats = p.agg(F.count(F.lit(1)).alias("bank_rows"), F.countDistinct("CERT").alias("banks"))
    return stats.select("*", C.complaints(spark, sf).select(F.count(F.lit(1))).scalar().alias("complaints"),
                        f1.select(F.count(F.lit(1))).scalar().alias("applications"),
                        f1.select(F.countDistinct("institution")).scalar().alias("institutions"))
