"""Counterfactual impact, wealth, policy scenarios, price grid and GSE distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import scalars as S
from lodestar.operators import glm
from lodestar.operators import joins as J
from lodestar.operators import quantiles as Q
from lodestar.plans import sqlviews as V
from lodestar.plans.common import cte, rounded
from lodestar.plans.registry import register
from lodestar.plans.scalars import (REASONS, fico_band, fico_band_sql, ltv_band, ltv_band_sql, prep)
from lodestar.sources import conform as C

# ---------------------------------------------------------------- fixed values
HOLDING_YEARS = 13
MORTGAGE_RATE = 0.065
DOWN_PAYMENT_SHARE = 0.10
LOAN_TERM_YEARS = 30
ANNUAL_APPRECIATION = 0.045
MEDIAN_HOME_VALUE = 239_000
TEN_YEAR_APPRECIATION_SHARE = 0.48
CONVERSION_RATES = [0.50, 0.65, 0.80]
SMALL_BALANCE_BPS = 25
SMALL_BALANCE_UPB = 150_000
# FICO band x LTV band -> loan-level price adjustment (bps); off-grid cells are NULL.
PRICE_GRID = {
    (">=780", "<=60"): 0, (">=780", "60-75"): 25, (">=780", "75-80"): 25, (">=780", "80-85"): 50,
    (">=780", "85-90"): 62, (">=780", "90-95"): 75,
    ("760-779", "<=60"): 25, ("760-779", "60-75"): 37, ("760-779", "75-80"): 50, ("760-779", "80-85"): 75,
    ("760-779", "85-90"): 87, ("760-779", "90-95"): 100,
    ("740-759", "<=60"): 50, ("740-759", "60-75"): 62, ("740-759", "75-80"): 75, ("740-759", "80-85"): 100,
    ("740-759", "85-90"): 112, ("740-759", "90-95"): 125,
    ("720-739", "<=60"): 75, ("720-739", "60-75"): 87, ("720-739", "75-80"): 100, ("720-739", "80-85"): 125,
    ("720-739", "85-90"): 137, ("720-739", "90-95"): 150,
    ("700-719", "<=60"): 100, ("700-719", "60-75"): 112, ("700-719", "75-80"): 125, ("700-719", "80-85"): 150,
    ("700-719", "85-90"): 175, ("700-719", "90-95"): 200,
    ("680-699", "<=60"): 125, ("680-699", "60-75"): 137, ("680-699", "75-80"): 150, ("680-699", "80-85"): 200,
    ("680-699", "85-90"): 225, ("680-699", "90-95"): 250,
    ("660-679", "<=60"): 150, ("660-679", "60-75"): 175, ("660-679", "75-80"): 200, ("660-679", "80-85"): 250,
    ("660-679", "85-90"): 275, ("660-679", "90-95"): 300,
    ("<660", "<=60"): 175, ("<660", "60-75"): 200, ("<660", "75-80"): 225, ("<660", "80-85"): 275,
    ("<660", "85-90"): 300, ("<660", "90-95"): 350,
}
# Illustrative fixed approval-model coefficients for the counterfactual score.
CF_COEFS = {"log_income": 0.05, "log_loan_amount": -0.02, "is_black": -0.6, "is_hispanic": -0.1,
            "is_asian": 0.05}
CF_INTERCEPT = 0.4


def equity_b(home_value: float = MEDIAN_HOME_VALUE) -> float:
    """Down payment + principal repaid after the holding period + appreciation (closed-form amortisation)."""
    r, n, h = MORTGAGE_RATE / 12, LOAN_TERM_YEARS * 12, HOLDING_YEARS * 12
    loan = home_value * (1 - DOWN_PAYMENT_SHARE)
    remaining = loan * ((1 + r) ** n - (1 + r) ** h) / ((1 + r) ** n - 1)
    return home_value * DOWN_PAYMENT_SHARE + (loan - remaining) + home_value * ((1 + ANNUAL_APPRECIATION) ** HOLDING_YEARS - 1)


def _cf_sql():
    z0 = " + ".join(f"{b} * {c}" for c, b in CF_COEFS.items() if c != "is_black")
    return (f"1 / (1 + exp(-({CF_INTERCEPT} + {z0})))",
            f"1 / (1 + exp(-({CF_INTERCEPT} + {z0} + {CF_COEFS['is_black']})))")


@register("counterfactual_score", section="M", sql="WITH p AS (" + V.prep() + f""")
SELECT institution, count(*) AS n_protected,
       round(sum({_cf_sql()[0]} - {_cf_sql()[1]}), 6) AS excess_approvals,
       round(avg({_cf_sql()[0]} - {_cf_sql()[1]}), 6) AS mean_excess
FROM p WHERE is_black = 1 AND log_income IS NOT NULL AND log_loan_amount IS NOT NULL GROUP BY 1""")
def q_counterfactual_score(spark, sf):
    df = prep(spark, sf).where((F.col("is_black") == 1)).dropna(subset=["log_income", "log_loan_amount"])
    cols = list(CF_COEFS)
    z1 = S.linear_score(CF_COEFS, CF_INTERCEPT, cols)
    z0 = S.linear_score({k: v for k, v in CF_COEFS.items() if k != "is_black"}, CF_INTERCEPT)
    d = S.sigmoid(z0) - S.sigmoid(z1)
    return rounded(df.groupBy("institution").agg(F.count(F.lit(1)).alias("n_protected"),
                                                 F.sum(d).alias("excess_approvals"), F.avg(d).alias("mean_excess")))


def _hv_sql():
    return "(150000 + 5000 * (length(state_code) % 10))"


def home_value_col():
    return F.lit(150000) + F.lit(5000) * (F.length("state_code") % 10)


@register("wealth_impact", section="M", sql="WITH p AS (" + V.prep() + f""")
, r AS (SELECT institution, {_hv_sql()} AS hv, {_cf_sql()[0]} - {_cf_sql()[1]} AS excess FROM p
        WHERE is_black = 1 AND log_income IS NOT NULL AND log_loan_amount IS NOT NULL)
SELECT institution, round(sum(excess), 6) AS excess, round(sum(excess * hv * {TEN_YEAR_APPRECIATION_SHARE}), 4) AS wealth_a,
       round(sum(excess * (hv * {DOWN_PAYMENT_SHARE} + (hv * {1 - DOWN_PAYMENT_SHARE} - hv * {1 - DOWN_PAYMENT_SHARE}
         * {((1 + MORTGAGE_RATE / 12) ** (LOAN_TERM_YEARS * 12) - (1 + MORTGAGE_RATE / 12) ** (HOLDING_YEARS * 12)) / ((1 + MORTGAGE_RATE / 12) ** (LOAN_TERM_YEARS * 12) - 1)!r})
         + hv * {(1 + ANNUAL_APPRECIATION) ** HOLDING_YEARS - 1!r})), 4) AS wealth_b
FROM r GROUP BY 1""")
def q_wealth_impact(spark, sf):
    """Excess approvals (counterfactual) x per-home equity: method A (48 % of value)
    and method B (down payment + amortised principal + appreciation)."""
    df = prep(spark, sf).where(F.col("is_black") == 1).dropna(subset=["log_income", "log_loan_amount"])
    z1 = S.linear_score(CF_COEFS, CF_INTERCEPT, list(CF_COEFS))
    z0 = S.linear_score({k: v for k, v in CF_COEFS.items() if k != "is_black"}, CF_INTERCEPT)
    ex = S.sigmoid(z0) - S.sigmoid(z1)
    hv = home_value_col()
    d = df.select("institution", ex.alias("excess"), hv.alias("hv"))
    r, n, h = MORTGAGE_RATE / 12, LOAN_TERM_YEARS * 12, HOLDING_YEARS * 12
    rem = ((1 + r) ** n - (1 + r) ** h) / ((1 + r) ** n - 1)
    eq_b = F.col("hv") * DOWN_PAYMENT_SHARE + (F.col("hv") * (1 - DOWN_PAYMENT_SHARE)
                                              - F.col("hv") * (1 - DOWN_PAYMENT_SHARE) * rem) \
        + F.col("hv") * ((1 + ANNUAL_APPRECIATION) ** HOLDING_YEARS - 1)
    return d.groupBy("institution").agg(
        F.round(F.sum("excess"), 6).alias("excess"),
        F.round(F.sum(F.col("excess") * F.col("hv") * TEN_YEAR_APPRECIATION_SHARE), 4).alias("wealth_a"),
        F.round(F.sum(F.col("excess") * eq_b), 4).alias("wealth_b"))


CITED_SQL = """CAST(coalesce(denial_reason_1 = '3' OR denial_reason_2 = '3' OR denial_reason_3 = '3'
              OR denial_reason_4 = '3', false) AS INTEGER)"""


@register("policy_scenarios", section="M", sql="WITH p AS (" + V.prep() + f""")
, c AS (SELECT is_black, activity_year, {CITED_SQL} AS cited FROM p WHERE denied = 1)
, d AS (SELECT CAST(sum(is_black) AS DOUBLE) AS n1, sum(is_black * cited) * 1.0 / sum(is_black) AS s1,
               sum((1 - is_black) * cited) * 1.0 / sum(1 - is_black) AS s0, count(DISTINCT activity_year) AS years FROM c)
, e AS (SELECT *, (s1 / (1 - s1)) / (s0 / (1 - s0)) AS odds_ratio FROM d)
, x AS (SELECT *, n1 * (s1 - s0) AS raw, n1 * s1 * (odds_ratio - 1) / odds_ratio AS cond FROM e)
SELECT conv AS conversion, round(odds_ratio, 6) AS odds_ratio, round(raw, 6) AS excess_citations_raw,
       round(cond, 6) AS excess_citations_conditional, round(cond * conv, 6) AS excess_approvals,
       round(cond * conv / years, 6) AS excess_approvals_annual,
       round(cond * conv * {MEDIAN_HOME_VALUE * TEN_YEAR_APPRECIATION_SHARE!r}, 4) AS wealth_a,
       round(cond * conv * {equity_b()!r}, 4) AS wealth_b,
       round(cond * conv / years * {MEDIAN_HOME_VALUE * TEN_YEAR_APPRECIATION_SHARE!r}, 4) AS wealth_a_annual,
       round(cond * conv / years * {equity_b()!r}, 4) AS wealth_b_annual
FROM x, (SELECT * FROM (VALUES (0.5::DOUBLE), (0.65::DOUBLE), (0.8::DOUBLE)) t(conv))""")
def q_policy_scenarios(spark, sf):
    """Credit-history citations among denied applicants: the protected group's excess over
    the other group's rate (raw), and the share (OR - 1) / OR of its citations with the odds
    ratio of being cited (conditional); the latter times conversion rates and per-home wealth
    by both methods, in total and per year of the data."""
    df = prep(spark, sf).where("denied = 1").select(
        "is_black", "activity_year", S.row_any_equals(REASONS, 3).cast("int").alias("cited"))
    d = df.agg(F.sum("is_black").cast("double").alias("n1"),
               F.avg(F.when(F.col("is_black") == 1, F.col("cited"))).alias("s1"),
               F.avg(F.when(F.col("is_black") == 0, F.col("cited"))).alias("s0"),
               F.countDistinct("activity_year").alias("years"))
    odds = lambda s: F.col(s) / (1 - F.col(s))
    d = d.withColumn("odds_ratio", odds("s1") / odds("s0"))
    d = d.withColumn("raw", F.col("n1") * (F.col("s1") - F.col("s0"))).withColumn(
        "cond", F.col("n1") * F.col("s1") * (F.col("odds_ratio") - 1) / F.col("odds_ratio"))
    x = d.select("*", F.explode(F.array(*[F.lit(c) for c in CONVERSION_RATES])).alias("conversion"))
    total = F.col("cond") * F.col("conversion")
    annual = total / F.col("years")
    a, b = MEDIAN_HOME_VALUE * TEN_YEAR_APPRECIATION_SHARE, equity_b()
    return x.select("conversion", F.round("odds_ratio", 6).alias("odds_ratio"), F.round("raw", 6).alias("excess_citations_raw"),
                    F.round("cond", 6).alias("excess_citations_conditional"), F.round(total, 6).alias("excess_approvals"),
                    F.round(annual, 6).alias("excess_approvals_annual"), F.round(total * a, 4).alias("wealth_a"),
                    F.round(total * b, 4).alias("wealth_b"), F.round(annual * a, 4).alias("wealth_a_annual"),
                    F.round(annual * b, 4).alias("wealth_b_annual"))


def grid_df(spark):
    return spark.createDataFrame([(f, l, float(v)) for (f, l), v in PRICE_GRID.items()],
                                 "fico_band string, ltv_band string, llpa_bps double")


def _grid_sql():
    rows = ", ".join(f"('{f}', '{l}', {float(v)})" for (f, l), v in PRICE_GRID.items())
    return f"(SELECT * FROM (VALUES {rows}) g(fico_band, ltv_band, llpa_bps))"


def priced(spark, sf):
    lm = C.loan_months(spark, sf).select("*", fico_band().alias("fico_band"), ltv_band().alias("ltv_band"))
    return J.grid_lookup(lm, grid_df(spark), ["fico_band", "ltv_band"], "llpa_bps")


@register("grid_lookup_join", section="J", sql=cte(f4=V.F4) + f"""
, b AS (SELECT *, {fico_band_sql()} AS fico_band, {ltv_band_sql()} AS ltv_band FROM f4)
SELECT b.fico_band, b.ltv_band, count(*) AS n, round(avg(g.llpa_bps), 6) AS mean_llpa
FROM b LEFT JOIN {_grid_sql()} g ON b.fico_band = g.fico_band AND b.ltv_band = g.ltv_band GROUP BY ALL""")
def q_grid_lookup_join(spark, sf):
    return rounded(priced(spark, sf).groupBy("fico_band", "ltv_band").agg(F.count(F.lit(1)).alias("n"),
                                                                          F.avg("llpa_bps").alias("mean_llpa")))


GSE_Q_SQL = cte(f4=V.F4) + """
, e AS (SELECT min(original_upb) AS lo, max(original_upb) AS hi, quantile_cont(original_upb, [0.25, 0.5, 0.75]) AS qs FROM f4)
, q AS (SELECT f4.*, CAST(len(list_filter(list_distinct(qs), lambda x: x > lo AND x < hi AND x < original_upb)) AS INTEGER) AS quartile
        FROM f4, e)"""


def gse_quartiles(spark, sf):
    return Q.qcut(C.loan_months(spark, sf), "original_upb", 4, name="quartile", duplicates="drop")


@register("fico_by_size", section="M", sql=GSE_Q_SQL + """
SELECT quartile, count(*) AS n, round(avg(fico), 6) AS fico_mean, round(median(fico), 6) AS fico_median,
       round(quantile_cont(fico, 0.25), 6) AS fico_p25, round(quantile_cont(fico, 0.75), 6) AS fico_p75,
       round(median(original_upb), 6) AS upb_median FROM q GROUP BY 1""")
def q_fico_by_size(spark, sf):
    d = gse_quartiles(spark, sf)
    agg = d.groupBy("quartile").agg(F.count(F.lit(1)).alias("n"), F.avg("fico").alias("fico_mean"))
    return rounded(Q.with_quantiles(agg, d, ["quartile"], [("fico", 0.5, "fico_median"), ("fico", 0.25, "fico_p25"),
                                                          ("fico", 0.75, "fico_p75"),
                                                          ("original_upb", 0.5, "upb_median")]))


@register("delinquency_by_size", section="M", sql=GSE_Q_SQL + """
SELECT quartile, count(*) AS n, round(avg(CAST(current_delinquency >= 1 AS INTEGER)), 6) AS dq30_rate,
       round(avg(CAST(current_delinquency >= 2 AS INTEGER)), 6) AS dq60_rate FROM q GROUP BY 1""")
def q_delinquency_by_size(spark, sf):
    d = gse_quartiles(spark, sf)
    return rounded(d.groupBy("quartile").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("current_delinquency") >= 1).cast("int")).alias("dq30_rate"),
        F.avg((F.col("current_delinquency") >= 2).cast("int")).alias("dq60_rate")))


@register("price_grid_by_size", section="Q", sql=GSE_Q_SQL + f"""
, b AS (SELECT *, {fico_band_sql()} AS fico_band, {ltv_band_sql()} AS ltv_band FROM q)
SELECT quartile, count(*) AS n, round(avg(original_rate * 100), 6) AS mean_rate_bps, round(avg(g.llpa_bps), 6) AS mean_llpa_bps,
       round(avg(g.llpa_bps + CASE WHEN original_upb < {SMALL_BALANCE_UPB} THEN {SMALL_BALANCE_BPS} ELSE 0 END), 6) AS mean_total_llpa
FROM b LEFT JOIN {_grid_sql()} g ON b.fico_band = g.fico_band AND b.ltv_band = g.ltv_band GROUP BY 1""")
def q_price_grid_by_size(spark, sf):
    d = Q.qcut(priced(spark, sf), "original_upb", 4, name="quartile", duplicates="drop")
    small = F.when(F.col("original_upb") < SMALL_BALANCE_UPB, SMALL_BALANCE_BPS).otherwise(0)
    return rounded(d.groupBy("quartile").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("original_rate") * 100).alias("mean_rate_bps"),
        F.avg("llpa_bps").alias("mean_llpa_bps"), F.avg(F.col("llpa_bps") + small).alias("mean_total_llpa")))


@register("rate_premium_explained", section="M")
def q_rate_premium_explained(spark, sf):
    """Small-loan rate premium with and without the price-grid control (two HC3 fits)."""
    d = priced(spark, sf).select("*", (F.col("original_rate") * 100).alias("rate_bps"),
                                 (F.col("original_upb") < SMALL_BALANCE_UPB).cast("int").alias("is_small"),
                                 F.log("original_upb").alias("log_upb")).dropna(subset=["llpa_bps"])
    base = ["fico", "original_dti", "original_ltv", "log_upb", "is_small"]
    a = glm.term(glm.ols(d, "rate_bps", base, cov_type="HC3"), "is_small").select(F.col("coef").alias("premium_a"))
    b = glm.term(glm.ols(d, "rate_bps", base + ["llpa_bps"], cov_type="HC3"), "is_small") \
        .select(F.col("coef").alias("premium_b"))
    pa, pb = a.first()["premium_a"], b.first()["premium_b"]
    return rounded(spark.createDataFrame(
        [(pa, pb, (pa - pb) if pa is not None and pb is not None else None,
          (pa - pb) / pa * 100 if pa else None)],
        "premium_a double, premium_b double, explained_bps double, explained_pct double"))


@register("denial_reason_gap", section="Q", sql="WITH p AS (" + V.prep() + """)
, b0 AS (SELECT row_number() OVER () AS rid, is_black, denial_reason_1, denial_reason_2, denial_reason_3,
                denial_reason_4 FROM p WHERE denied = 1 AND (is_black = 1 OR is_white = 1))
, l AS (UNPIVOT b0 ON denial_reason_1, denial_reason_2, denial_reason_3, denial_reason_4 INTO NAME slot VALUE reason)
, c AS (SELECT is_black, reason, count(*) AS n, count(DISTINCT rid) AS n_app FROM l
        WHERE reason IS NOT NULL AND trim(reason) <> '' GROUP BY ALL)
, s AS (SELECT *, n * 100.0 / sum(n) OVER (PARTITION BY is_black) AS pct FROM c)
SELECT coalesce(a.reason, b.reason) AS reason, round(coalesce(a.pct, 0), 6) AS pct_protected,
       round(coalesce(b.pct, 0), 6) AS pct_reference, round(coalesce(a.pct, 0) - coalesce(b.pct, 0), 6) AS gap,
       coalesce(a.n, 0) AS citations_protected, coalesce(a.n_app, 0) AS applicants_protected,
       coalesce(b.n, 0) AS citations_reference, coalesce(b.n_app, 0) AS applicants_reference
FROM (SELECT * FROM s WHERE is_black = 1) a FULL OUTER JOIN (SELECT * FROM s WHERE is_black = 0) b ON a.reason = b.reason""")
def q_denial_reason_gap(spark, sf):
    """Citation shares by group and their gap; citations (melted reason slots) and
    applicants (distinct denied applications citing the reason) are both reported."""
    from lodestar.operators import aggs as A, frames
    df = prep(spark, sf).where((F.col("denied") == 1) & ((F.col("is_black") == 1) | (F.col("is_white") == 1)))
    long = frames.unpivot_nonblank(df, ["is_black"], REASONS, "slot", "reason")
    sh = A.value_share(long, ["is_black"], "reason")
    slots = F.filter(F.array(*[F.col(c) for c in REASONS]), lambda x: x.isNotNull() & (F.trim(x) != ""))
    apps_ = df.select("is_black", F.explode(F.array_distinct(slots)).alias("reason")) \
        .groupBy("is_black", "reason").agg(F.count(F.lit(1)).alias("n_app"))
    sh = sh.join(apps_, ["is_black", "reason"], "left")
    a = sh.where("is_black = 1").select("reason", F.col("pct").alias("pct_protected"),
                                        F.col("n").alias("citations_protected"),
                                        F.col("n_app").alias("applicants_protected"))
    b = sh.where("is_black = 0").select("reason", F.col("pct").alias("pct_reference"),
                                        F.col("n").alias("citations_reference"),
                                        F.col("n_app").alias("applicants_reference"))
    gap = J.outer_align(a.select("reason", "pct_protected"), b.select("reason", "pct_reference"), "reason",
                        "pct_protected", "pct_reference", "gap")
    counts = a.drop("pct_protected").join(b.drop("pct_reference"), "reason", "full_outer")
    out = gap.join(counts, "reason", "left").select(
        "reason", "pct_protected", "pct_reference", "gap",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in
          ["citations_protected", "applicants_protected", "citations_reference", "applicants_reference"]])
    return rounded(out)


@register("outer_align", section="J", sql="WITH f1 AS (" + V.F1 + """)
, a AS (SELECT state_code, CAST(count(*) AS DOUBLE) AS n FROM f1 WHERE activity_year < 1998 GROUP BY 1)
, b AS (SELECT state_code, CAST(count(*) AS DOUBLE) AS n FROM f1 WHERE activity_year >= 1998 GROUP BY 1)
SELECT coalesce(a.state_code, b.state_code) AS state_code, coalesce(a.n, 0) AS pre, coalesce(b.n, 0) AS post,
       coalesce(a.n, 0) - coalesce(b.n, 0) AS diff FROM a FULL OUTER JOIN b ON a.state_code = b.state_code""")
def q_outer_align(spark, sf):
    df = C.applications(spark, sf)
    a = df.where(F.col("activity_year") < 1998).groupBy("state_code").agg(F.count(F.lit(1)).cast("double").alias("pre"))
    b = df.where(F.col("activity_year") >= 1998).groupBy("state_code").agg(F.count(F.lit(1)).cast("double").alias("post"))
    return J.outer_align(a, b, "state_code", "pre", "post", "diff")


@register("loan_distribution_by_group", section="Q", sql="WITH p AS (" + V.prep() + """)
SELECT derived_race, count(*) AS n, round(median(loan_amount), 6) AS median, round(avg(loan_amount), 6) AS mean,
       round(quantile_cont(loan_amount, 0.25), 6) AS p25, round(quantile_cont(loan_amount, 0.75), 6) AS p75
FROM p GROUP BY 1""")
def q_loan_distribution_by_group(spark, sf):
    d = prep(spark, sf)
    agg = d.groupBy("derived_race").agg(F.count(F.lit(1)).alias("n"), F.avg("loan_amount").alias("mean"))
    return rounded(Q.with_quantiles(agg, d, ["derived_race"], [("loan_amount", 0.5, "median"),
                                                              ("loan_amount", 0.25, "p25"),
                                                              ("loan_amount", 0.75, "p75")]))
