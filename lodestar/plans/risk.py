"""Early-warning queries on the bank panel (F2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import risk as R
from lodestar.operators import windows as W
from lodestar.plans import sqlviews as V
from lodestar.plans.common import cte, rnd, rounded
from lodestar.plans.registry import register
from lodestar.sources import conform as C

RATIOS = ["texas_ratio", "nim", "cre_ratio", "tier1_leverage", "ltd_ratio", "roa", "log_asset"]
QOQ = [f"{c}_qoq" for c in R.QOQ_COLUMNS]


def features_sql(texas_rule: str = "model") -> str:
    den = "EQ + NULLIF(LNLSNTV, 0)" if texas_rule == "api" else "EQ + LNLSNTV"
    pct = []
    for c in R.QOQ_COLUMNS:
        cur, prev = f"f_{c}", f"p_{c}"
        pct.append(f"CASE WHEN {prev} IS NULL OR {cur} IS NULL THEN NULL "
                   f"WHEN {prev} = 0 THEN CASE WHEN {cur} > 0 THEN CAST('Infinity' AS DOUBLE) "
                   f"WHEN {cur} < 0 THEN CAST('-Infinity' AS DOUBLE) END "
                   f"ELSE {cur} / {prev} - 1 END AS {c}_qoq")
    return f"""
SELECT *, coalesce(lead(distressed_now, 4) OVER (PARTITION BY CERT ORDER BY REPDTE), 0) AS label FROM (
SELECT *, {', '.join(pct)},
       CAST(coalesce(texas_ratio > 100, false) AS INTEGER) AS distressed_now FROM (
SELECT *, {', '.join(f'lag(f_{c}) OVER (PARTITION BY CERT ORDER BY REPDTE) AS p_{c}' for c in R.QOQ_COLUMNS)} FROM (
SELECT *, {', '.join(f'last_value({c} IGNORE NULLS) OVER (PARTITION BY CERT ORDER BY REPDTE ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f_{c}' for c in R.QOQ_COLUMNS)} FROM (
SELECT *, NCLNLS / NULLIF({den}, 0) * 100 AS texas_ratio,
       (INTINC - EINTEXP) / NULLIF(ASSET, 0) AS nim,
       LNRE / NULLIF(ASSET, 0) AS cre_ratio,
       RBCT1J / NULLIF(ASSET, 0) AS tier1_leverage,
       LNLSNET / NULLIF(DEP, 0) AS ltd_ratio,
       NETINC / NULLIF(ASSET, 0) AS roa,
       ln(1 + ASSET) AS log_asset
FROM ({V.F2}) p) r) f) l) q
"""


def features(spark, sf, **kw):
    return R.bank_features(C.bank_panel(spark, sf), **kw)


@register("bank_feature_panel", section="Q", sql=cte(f=features_sql()) + f"""
SELECT CERT, CAST(REPDTE AS VARCHAR) AS REPDTE, {rnd(*RATIOS, *QOQ)}, distressed_now, label FROM f""")
def q_bank_feature_panel(spark, sf):
    df = features(spark, sf)
    return rounded(df.select("CERT", "REPDTE", *RATIOS, *QOQ, "distressed_now", "label"))


@register("camels_ratios", section="P", sql=cte(f=features_sql()) + f"""
SELECT CERT, CAST(REPDTE AS VARCHAR) AS REPDTE, {rnd(*RATIOS)} FROM f""")
def q_camels_ratios(spark, sf):
    return rounded(R.camels_ratios(C.bank_panel(spark, sf)).select("CERT", "REPDTE", *RATIOS))


@register("safe_ratio", section="P", sql=cte(a=features_sql("api"), m=features_sql("model")) + f"""
SELECT m.CERT, CAST(m.REPDTE AS VARCHAR) AS REPDTE, round(m.texas_ratio, 6) AS texas_model, round(a.texas_ratio, 6) AS texas_api,
       round(m.roa * 100, 6) AS roa_pct, round(m.tier1_leverage * 100, 6) AS tier1_pct
FROM m JOIN a ON m.CERT = a.CERT AND m.REPDTE = a.REPDTE""")
def q_safe_ratio(spark, sf):
    p = C.bank_panel(spark, sf)
    from lodestar.functions.scalars import safe_ratio
    return rounded(p.select("CERT", "REPDTE", R.texas_ratio("model").alias("texas_model"),
                            R.texas_ratio("api").alias("texas_api"),
                            safe_ratio("NETINC", "ASSET", 100.0).alias("roa_pct"),
                            safe_ratio("RBCT1J", "ASSET", 100.0).alias("tier1_pct")))


@register("pct_change_pad", section="W", sql=cte(f=features_sql()) + f"""
SELECT CERT, CAST(REPDTE AS VARCHAR) AS REPDTE, {rnd(*QOQ)} FROM f""")
def q_pct_change_pad(spark, sf):
    return rounded(features(spark, sf).select("CERT", "REPDTE", *QOQ))


@register("lead_label", section="W", sql=cte(f=features_sql()) + """
SELECT CERT, CAST(REPDTE AS VARCHAR) AS REPDTE, distressed_now, label,
       CAST(coalesce(max(distressed_now) OVER (PARTITION BY CERT ORDER BY REPDTE
            ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), 0) AS INTEGER) AS label_any4 FROM f""")
def q_lead_label(spark, sf):
    df = features(spark, sf)
    w = W.entity_window("CERT", "REPDTE")
    return rounded(df.select("CERT", "REPDTE", "distressed_now", "label",
                             W.lead_label("distressed_now", 4, w, "any").alias("label_any4")))


@register("clip_bounds", section="P", sql=cte(f=features_sql()) + f"""
SELECT CERT, CAST(REPDTE AS VARCHAR) AS REPDTE, {', '.join(f"round(CASE WHEN {c} > 10 THEN 10.0 WHEN {c} < -10 THEN -10.0 ELSE {c} END, 6) AS {c}" for c in R.FEATURES)}
FROM f""")
def q_clip_bounds(spark, sf):
    df = features(spark, sf)
    from lodestar.functions.scalars import clip
    return rounded(df.select("CERT", "REPDTE", *[clip(c, -10, 10).alias(c) for c in R.FEATURES]))


def _score_sql() -> str:
    z = " + ".join([f"{b} * CASE WHEN {c} > 10 THEN 10.0 WHEN {c} < -10 THEN -10.0 ELSE {c} END"
                    for c, b in R.FIXED_COEFS.items()])
    return f"1.0 / (1.0 + exp(-({R.FIXED_INTERCEPT} + {z})))"


WATCH_SQL = cte(f=features_sql()) + f"""
, latest AS (SELECT * FROM f WHERE REPDTE = (SELECT max(REPDTE) FROM f)
             AND {' AND '.join(f'{c} IS NOT NULL' for c in R.FEATURES)})
SELECT CERT, STNAME, CITY, round({_score_sql()}, 6) AS distress_prob,
       round(texas_ratio, 6) AS texas_ratio, round(tier1_leverage, 6) AS tier1_leverage,
       round(cre_ratio, 6) AS cre_ratio
FROM latest ORDER BY distress_prob DESC, CERT LIMIT 25"""


@register("watchlist_score", section="M", sql=WATCH_SQL)
def q_watchlist_score(spark, sf):
    return rounded(R.watchlist(features(spark, sf)))


@register("latest_period", section="W", sql=cte(p=V.F2) + """
SELECT CERT, CAST(REPDTE AS VARCHAR) AS REPDTE, round(ASSET, 6) AS ASSET FROM p WHERE REPDTE = (SELECT max(REPDTE) FROM p)""")
def q_latest_period(spark, sf):
    p = C.bank_panel(spark, sf)
    return rounded(W.latest_period(p, "REPDTE").select("CERT", "REPDTE", "ASSET"))


@register("temporal_split", section="M", sql=cte(f=features_sql()) + """
SELECT CASE WHEN REPDTE <= DATE '1997-12-31' THEN 'train' ELSE 'test' END AS split,
       count(*) AS n, round(avg(label), 6) AS positive_rate
FROM f WHERE REPDTE <= DATE '1997-12-31' OR REPDTE >= DATE '1998-09-30' GROUP BY 1""")
def q_temporal_split(spark, sf):
    train, test = R.temporal_split(features(spark, sf), train_end="1997-12-31", test_start="1998-09-30")
    out = train.select(F.lit("train").alias("split"), "label").unionByName(
        test.select(F.lit("test").alias("split"), "label"))
    return rounded(out.groupBy("split").agg(F.count(F.lit(1)).alias("n"),
                                            F.avg("label").alias("positive_rate")))


@register("label_rate", section="A", sql=cte(f=features_sql()) + """
SELECT count(*) AS n_rows, round(avg(label), 6) AS label_rate, CAST(sum(label) AS BIGINT) AS n_positive FROM f""")
def q_label_rate(spark, sf):
    df = features(spark, sf)
    return rounded(df.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("label").alias("label_rate"),
                          F.sum("label").cast("long").alias("n_positive")))
