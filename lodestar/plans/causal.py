"""Causal-design and robustness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import causal as CA
from lodestar.operators import effects as FX
from lodestar.operators import frames, glm
from lodestar.operators import windows as W
from lodestar.plans import sqlviews as V
from lodestar.plans.common import cte, rounded
from lodestar.plans.registry import register
from lodestar.plans.scalars import prep
from lodestar.plans.windows import DID_SQL, did_panel
from lodestar.session import stored
from lodestar.sources import conform as C

TREAT = C.TREATED_INSTITUTION
POST_YEAR = 1998
REF_YEAR = 1997


def triple_frame(spark, sf):
    return prep(spark, sf).select(
        "*", (F.col("institution") == TREAT).cast("int").alias("treat"),
        (F.col("activity_year") >= POST_YEAR).cast("int").alias("post"))


TRIPLE_SRC = f"""(SELECT *, CAST(institution = '{TREAT}' AS INTEGER) AS treat,
                 CAST(activity_year >= {POST_YEAR} AS INTEGER) AS post FROM p)"""


@register("did_twfe", section="M", sql=cte(d=DID_SQL) + """
, m AS (SELECT *, treat * post AS dd,
          avg(treat * post) OVER (PARTITION BY institution) AS di, avg(treat * post) OVER (PARTITION BY quarter_dt) AS dt,
          avg(treat * post) OVER () AS da,
          avg(log_complaints) OVER (PARTITION BY institution) AS yi,
          avg(log_complaints) OVER (PARTITION BY quarter_dt) AS yq, avg(log_complaints) OVER () AS ya FROM d)
, r AS (SELECT dd - di - dt + da AS xt, log_complaints - yi - yq + ya AS yt FROM m)
, x AS (SELECT sum(xt * yt) / sum(xt * xt) AS b, sum(xt * xt) AS sxx, count(*) AS n,
               (SELECT count(DISTINCT institution) FROM d) AS ne, (SELECT count(DISTINCT quarter_dt) FROM d) AS nt FROM r)
SELECT 'treat_post' AS term, round(b, 6) AS coef,
       round(sqrt(sum(xt * xt * (yt - b * xt) * (yt - b * xt)
             / pow(1 - (1.0 / nt + 1.0 / ne - 1.0 / (ne * nt) + xt * xt / sxx), 2))) / sxx, 6) AS se,
       round((exp(b) - 1) * 100, 6) AS implied_pct, n
FROM r, x GROUP BY b, sxx, n, ne, nt""")
def q_did_twfe(spark, sf):
    """Two-way FE DiD with HC3. The panel is balanced, so the coefficient is the
    slope on double-demeaned variables and the leverage is 1/T + 1/N - 1/(NT) plus
    the regressor's share (the SQL oracle)."""
    fit = CA.did_twfe(did_panel(spark, sf), "log_complaints", "treat", "post", "institution", "quarter_str")
    return rounded(fit.select("term", "coef", "se", "implied_pct", "n"))


@register("did_twfe_absorbed", section="M", sql=cte(d=DID_SQL) + """
, m AS (SELECT *, treat * post AS dd,
          avg(treat * post) OVER (PARTITION BY institution) AS di, avg(treat * post) OVER (PARTITION BY quarter_dt) AS dt,
          avg(treat * post) OVER () AS da,
          avg(log_complaints) OVER (PARTITION BY institution) AS yi,
          avg(log_complaints) OVER (PARTITION BY quarter_dt) AS yq, avg(log_complaints) OVER () AS ya FROM d)
, r AS (SELECT institution, dd - di - dt + da AS xt, log_complaints - yi - yq + ya AS yt FROM m)
, x AS (SELECT sum(xt * yt) / sum(xt * xt) AS b, sum(xt * xt) AS sxx, count(*) AS n,
               count(DISTINCT institution) AS g, (SELECT count(DISTINCT quarter_dt) FROM d) AS nt FROM r)
, s AS (SELECT institution, sum(xt * (yt - b * xt)) AS sg FROM r, x GROUP BY 1)
SELECT 'treat_post' AS term, round(b, 6) AS coef,
       round(sqrt(g / (g - 1.0) * (n - 1.0) / (n - 1.0 - (g + nt - 1)) * (SELECT sum(sg * sg) FROM s)) / sxx, 6) AS se,
       n FROM x""")
def q_did_twfe_absorbed(spark, sf):
    """TWFE DiD with both effects absorbed by alternating projections (no dummy
    columns) and entity-clustered errors; scales to any number of entities."""
    fit = CA.did_twfe_absorbed(did_panel(spark, sf), "log_complaints", "treat", "post", "institution",
                               "quarter_dt")
    return rounded(fit.select("term", "coef", "se", "n"))


CELL_V = "var_samp(approved) / (count(*) - 1)"  # HC3 variance of a cell mean (leverage 1 / n_cell)


@register("did_triple", section="M", sql="WITH p AS (" + V.prep() + f"), t AS {TRIPLE_SRC}" + f"""
, c AS (SELECT is_black AS b, treat AS t, post AS q, avg(approved) AS m, {CELL_V} AS v FROM t GROUP BY ALL)
SELECT 'is_black_x_treat_x_post' AS term, round(
  (sum(CASE WHEN b=1 AND t=1 AND q=1 THEN m END) - sum(CASE WHEN b=1 AND t=1 AND q=0 THEN m END)
   - sum(CASE WHEN b=1 AND t=0 AND q=1 THEN m END) + sum(CASE WHEN b=1 AND t=0 AND q=0 THEN m END))
 - (sum(CASE WHEN b=0 AND t=1 AND q=1 THEN m END) - sum(CASE WHEN b=0 AND t=1 AND q=0 THEN m END)
   - sum(CASE WHEN b=0 AND t=0 AND q=1 THEN m END) + sum(CASE WHEN b=0 AND t=0 AND q=0 THEN m END)), 6) AS coef,
  round(sqrt(sum(v)), 6) AS se
FROM c""")
def q_did_triple(spark, sf):
    """Saturated 2x2x2 LPM with HC3: the coefficient is a difference of cell means
    and its HC3 variance the sum of cell-mean variances (the SQL oracle)."""
    fit = CA.did_triple(triple_frame(spark, sf), "approved", "is_black", "treat", "post")
    return rounded(fit.select("term", "coef", "se"))


EVENT_SQL = "WITH p AS (" + V.prep() + f"), t AS {TRIPLE_SRC}" + f"""
, c AS (SELECT activity_year AS y, is_black AS b, treat AS t, avg(approved) AS m, {CELL_V} AS v FROM t GROUP BY ALL)
, d AS (SELECT y, sum(CASE WHEN b=1 AND t=1 THEN m END) - sum(CASE WHEN b=0 AND t=1 THEN m END)
             - sum(CASE WHEN b=1 AND t=0 THEN m END) + sum(CASE WHEN b=0 AND t=0 THEN m END) AS dd,
             sum(v) AS vv FROM c GROUP BY 1)
, e AS (SELECT y AS activity_year, dd - (SELECT dd FROM d WHERE y = {REF_YEAR}) AS coef,
               sqrt(vv + (SELECT vv FROM d WHERE y = {REF_YEAR})) AS se FROM d WHERE y <> {REF_YEAR})"""


@register("event_study", section="M", sql=EVENT_SQL + """
SELECT activity_year, round(coef, 6) AS coef, round(se, 6) AS se FROM e""")
def q_event_study(spark, sf):
    es = CA.event_study(triple_frame(spark, sf), "approved", "is_black", "treat", "activity_year", REF_YEAR)
    return rounded(es.select("activity_year", "coef", "se"))


@register("pretrend_test", section="M", sql=EVENT_SQL + f"""
SELECT bool_and(abs(coef / se) < {glm.Z975}) AS all_pre_insignificant,
       round(max(abs(exp(coef) - 1)), 6) AS max_abs_or_dev,
       CASE WHEN bool_and(abs(coef / se) < {glm.Z975}) THEN 'PASS' ELSE 'MIXED' END AS verdict
FROM e WHERE activity_year < {POST_YEAR}""")
def q_pretrend_test(spark, sf):
    """All pre-period interactions insignificant (p > .05, i.e. |z| < 1.96) and the
    largest |OR - 1|; PASS / MIXED."""
    es = CA.event_study(triple_frame(spark, sf), "approved", "is_black", "treat", "activity_year", REF_YEAR)
    return rounded(CA.pretrend_test(es, "activity_year", POST_YEAR))


RARE_SQL = """(SELECT p.*, CASE WHEN c.n >= 50 THEN p.county_code ELSE 'other' END AS county
  FROM p LEFT JOIN (SELECT county_code, count(*) AS n FROM p WHERE county_code IS NOT NULL GROUP BY 1) c
  ON p.county_code = c.county_code)"""


def county_collapsed(df, min_count=50):
    from lodestar.operators import joins as J
    return J.rare_level_collapse(df, "county_code", min_count, out="county")


@register("within_fe_lpm", section="M", sql="WITH p AS (" + V.prep() + f"), r AS {RARE_SQL}" + """
, d AS (SELECT approved - avg(approved) OVER (PARTITION BY county) AS yt,
               is_black - avg(is_black) OVER (PARTITION BY county) AS xt FROM r)
, b AS (SELECT sum(xt * yt) / sum(xt * xt) AS b, sum(xt * xt) AS sxx, count(*) AS n FROM d)
SELECT 'is_black' AS term, round(b, 6) AS coef,
       round(sqrt(sum(xt * xt * (yt - b * xt) * (yt - b * xt) / ((1 - xt * xt / sxx) * (1 - xt * xt / sxx)))) / sxx, 6) AS se,
       n FROM d, b GROUP BY b, sxx, n""")
def q_within_fe_lpm(spark, sf):
    """County-demeaned LPM with HC3 (leverage x~^2 / sum x~^2 on the demeaned regressor)."""
    d = W.within_demean(county_collapsed(prep(spark, sf)), ["approved", "is_black"], "county")
    fit = glm.ols(d, "approved_dm", ["is_black_dm"], intercept=False, cov_type="HC3")
    return rounded(fit.select(F.lit("is_black").alias("term"), "coef", "se", "n"))


@register("lpm_pooled_fe", section="M")
def q_lpm_pooled_fe(spark, sf):
    df = stored(prep(spark, sf).select("approved", *CREDIT, *RACE, "institution", "activity_year"), "lpm_rows")  # levels and the fit read them
    df, e = frames.one_hot_drop_first(df, "institution", prefix="fe_i")
    df, t = frames.one_hot_drop_first(df, "activity_year", prefix="fe_y")
    fit = glm.ols(df, "approved", [*CREDIT, *RACE, *e, *t], cov_type="HC3")
    return rounded(glm.term(fit, "is_black"))


@register("lpm_by_group", section="M")
def q_lpm_by_group(spark, sf):
    df = stored(prep(spark, sf).select("approved", *CREDIT, *RACE, "institution", "activity_year"), "lpm_rows")
    df, t = frames.one_hot_drop_first(df, "activity_year", prefix="fe_y")
    # controls and year dummies that are constant in a group are left out of its fit
    fit = glm.ols(df, "approved", [*CREDIT, *RACE, *t], by=["institution"], cov_type="HC3", min_n=200)
    return rounded(glm.term(fit, "is_black").select("institution", "coef", "se", "p", "ci_lo", "ci_hi", "n"))


@register("size_gap_corr", section="M", sql="WITH p AS (" + V.prep() + """)
, g AS (SELECT institution, count(*) AS n, avg(CASE WHEN is_black = 0 THEN approved END)
               - avg(CASE WHEN is_black = 1 THEN approved END) AS gap FROM p GROUP BY 1)
SELECT round(corr(n, gap), 6) AS corr_size_gap, count(*) AS n_groups FROM g""")
def q_size_gap_corr(spark, sf):
    g = prep(spark, sf).groupBy("institution").agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(F.when(F.col("is_black") == 0, F.col("approved"))) -
         F.avg(F.when(F.col("is_black") == 1, F.col("approved")))).alias("gap"))
    return rounded(g.agg(F.corr("n", "gap").alias("corr_size_gap"), F.count(F.lit(1)).alias("n_groups")))


OSTER_SQL = "WITH p AS (" + V.prep() + """)
, m AS (SELECT institution, regr_sxx(approved, is_black) AS sxx, regr_syy(approved, is_black) AS syy,
           regr_sxy(approved, is_black) AS sxy, regr_sxx(log_income, is_black) AS szz_dummy,
           covar_pop(is_black, log_income) * count(*) AS sxz, covar_pop(log_income, approved) * count(*) AS szy,
           var_pop(log_income) * count(*) AS szz FROM p GROUP BY 1)
, f AS (SELECT institution, sxy / sxx AS b_u, sxy * sxy / (sxx * syy) AS r_u,
           (sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz) AS b_c,
           ((sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz) * sxy
            + (szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz) * szy) / syy AS r_c FROM m)
SELECT institution, mult AS rmax_mult, round(b_u, 6) AS b_u, round(b_c, 6) AS b_c, round(r_u, 6) AS r_u,
       round(r_c, 6) AS r_c,
       round(b_c * (least(mult * r_c, 0.99) - r_c) / ((b_u - b_c) * (r_c - r_u)), 3) AS delta
FROM f, (SELECT * FROM (VALUES (1.3::DOUBLE), (2.0::DOUBLE)) t(mult))"""


@register("oster_delta", section="M", sql=OSTER_SQL)
def q_oster_delta(spark, sf):
    """Oster delta from an uncontrolled and a controlled linear fit per institution
    (both fits in one batched job each); Rmax = min(mult x R_c, 0.99)."""
    df = prep(spark, sf)
    u = glm.term(glm.ols(df, "approved", ["is_black"], by=["institution"]), "is_black") \
        .select("institution", F.col("coef").alias("b_u"), F.col("r2").alias("r_u"))
    c = glm.term(glm.ols(df, "approved", ["is_black", "log_income"], by=["institution"]), "is_black") \
        .select("institution", F.col("coef").alias("b_c"), F.col("r2").alias("r_c"))
    j = u.join(c, "institution").select("*", F.explode(F.array(F.lit(1.3), F.lit(2.0))).alias("rmax_mult"))
    delta = F.col("b_c") * (F.least(F.col("rmax_mult") * F.col("r_c"), F.lit(0.99)) - F.col("r_c")) / \
        F.nullif((F.col("b_u") - F.col("b_c")) * (F.col("r_c") - F.col("r_u")), F.lit(0.0))
    # delta is a ratio of small differences (ill-conditioned): 3 decimals
    out = rounded(j.select("institution", "rmax_mult", "b_u", "b_c", "r_u", "r_c", delta.alias("delta")))
    return out.withColumn("delta", F.round("delta", 3))


SHRINK = [0.3, 0.4, 0.5]


@register("shrink_sensitivity", section="M", sql="WITH p AS (" + V.prep() + """)
, cells AS (SELECT institution, sum(CASE WHEN is_black = 1 AND approved = 1 THEN 1 ELSE 0 END) AS a,
       sum(CASE WHEN is_black = 1 AND approved = 0 THEN 1 ELSE 0 END) AS b,
       sum(CASE WHEN is_black = 0 AND approved = 1 THEN 1 ELSE 0 END) AS c,
       sum(CASE WHEN is_black = 0 AND approved = 0 THEN 1 ELSE 0 END) AS d FROM p GROUP BY 1)
SELECT institution, s AS shrink, round(exp(ln(a * d / (b * c)) * (1 - s)), 6) AS odds_ratio_shrunk
FROM cells, (SELECT * FROM (VALUES (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE)) t(s))""")
def q_shrink_sensitivity(spark, sf):
    fit = glm.term(glm.logit(prep(spark, sf), "approved", ["is_black"], by=["institution"]), "is_black")
    sc = F.explode(F.array(*[F.lit(s) for s in SHRINK])).alias("shrink")
    return rounded(fit.select("*", sc).select(
        "institution", "shrink", F.exp(F.col("coef") * (1 - F.col("shrink"))).alias("odds_ratio_shrunk")))


CREDIT = C.CREDIT_FEATURES
RACE = C.RACE_FEATURES
#: race only, + income and loan amount, + debt-to-income, + all credit controls
NESTED = {"race": RACE, "income_loan": ["log_income", "log_loan_amount", *RACE],
          "dti": ["log_income", "log_loan_amount", "dti_mid", *RACE], "full": [*CREDIT, *RACE]}


def stacked_logit(df, y, specs, complete=()):
    """Logit fits of several nested specifications in one batched call: each row is
    repeated per specification, with the terms outside it set to zero (the solver
    leaves such terms out). ``complete``: columns that must not be null in any of them."""
    terms = list(dict.fromkeys(x for xs in specs.values() for x in xs))
    d = df.dropna(subset=list(complete)) if complete else df
    d = d.select(y, *terms, F.explode(F.array(*[F.lit(s) for s in specs])).alias("spec"))
    uses = {x: F.col("spec").isin([s for s, xs in specs.items() if x in xs]) for x in terms}
    d = d.select("spec", y, *[F.when(uses[x], F.col(x).cast("double")).otherwise(F.lit(0.0)).alias(x) for x in terms])
    return glm.logit(d, y, terms, by=["spec"])


@register("coef_stability", section="M")
def q_coef_stability(spark, sf):
    """Protected coefficient over nested control sets, each on its own complete cases,
    and its movement from the first to each."""
    fits = glm.term(stacked_logit(prep(spark, sf), "approved", NESTED), "is_black")
    b0 = fits.where("spec = 'race'").select("coef").first()[0]
    return rounded(fits.select("spec", "coef", "odds_ratio", "r2", "n",
                               (F.abs(F.lit(b0) - F.col("coef")) / abs(b0) * 100).alias("movement_pct")))


@register("r2_decomposition", section="M")
def q_r2_decomposition(spark, sf):
    """McFadden R2 gained by each control group, all on one complete-case sample."""
    fits = stacked_logit(prep(spark, sf), "approved", NESTED, complete=NESTED["full"])
    r2 = {r["spec"]: r["r2"] for r in fits.where("term = 'const'").select("spec", "r2").collect()}  # four rows
    names = list(NESTED)
    total = r2[names[-1]] - r2[names[0]]
    rows = [(s, float(r2[s]), float(r2[s] - r2[names[i - 1]]) if i else None,
             float((r2[s] - r2[names[i - 1]]) / total * 100) if i and total > 0 else None) for i, s in enumerate(names)]
    return rounded(spark.createDataFrame(rows, "spec string, r2 double, r2_gain double, share_pct double"))


@register("spec_table", section="M")
def q_spec_table(spark, sf):
    """The protected coefficient with all controls: over everything, among purchases, with an effect for each state, and (a linear
    probability model on demeaned columns, in points of probability) for each county of 50 rows or more and the others together."""
    xs = [*CREDIT, *RACE]
    # stored: four fits and the counties' counts read these rows
    df = stored(prep(spark, sf).select("approved", *xs, "loan_purpose", "state_code", "county_code"), "spec_rows")
    fits = {"baseline": glm.logit(df, "approved", xs), "purchase_only": glm.logit(df.where(F.col("loan_purpose") == "1"), "approved", xs),
            "state_fe": FX.logit_absorbed(df, "approved", xs, "state_code")}
    within = W.within_demean(county_collapsed(df).dropna(subset=xs), ["approved", *xs], "county")
    lpm = glm.ols(within, "approved_dm", [f"{x}_dm" for x in xs], cov_type="HC3")
    fits["county_fe_lpm"] = lpm.withColumn("term", F.regexp_replace("term", "_dm$", ""))
    out = None
    for label, fit in fits.items():
        one = glm.term(fit, "is_black").select(F.lit(label).alias("label"), "*")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@register("logit_two_stage", section="M")
def q_logit_two_stage(spark, sf):
    df = prep(spark, sf)
    s1 = glm.logit(df, "approved", CREDIT, by=["institution"]).select(F.lit(1).alias("stage"), "*")
    s2 = glm.logit(df, "approved", CREDIT + RACE, by=["institution"]).select(F.lit(2).alias("stage"), "*")
    return rounded(s1.unionByName(s2))


@register("logit_interaction", section="M")
def q_logit_interaction(spark, sf):
    """Full controls, small- and large-loan flags, and the protected group's interactions
    with the small-loan flag and with debt-to-income; combined_or is the protected odds
    ratio among small loans."""
    from lodestar.operators import quantiles as Q
    df = Q.quantile_flags(prep(spark, sf), "loan_amount").withColumnsRenamed({"is_small": "loan_q1", "is_large": "loan_q4"})
    df = frames.interactions(df, [("is_black", "loan_q1"), ("is_black", "dti_mid")])
    fit = glm.logit(df, "approved", [*CREDIT, *RACE, "loan_q1", "loan_q4", "is_black_x_loan_q1", "is_black_x_dti_mid"])
    b = {r["term"]: r["coef"] for r in fit.select("term", "coef").collect()}
    both = (b["is_black"], b["is_black_x_loan_q1"])
    combined = F.lit(None).cast("double") if None in both else F.exp(F.lit(sum(both)))
    return rounded(fit.where("term <> 'const'").select("*", combined.alias("combined_or")))


@register("logit_state_fe", section="M")
def q_logit_state_fe(spark, sf):
    """All controls and an effect for each state, without dummy columns."""
    return rounded(FX.logit_absorbed(prep(spark, sf), "approved", [*CREDIT, *RACE], "state_code"))


@register("placebo_permutation", section="M")
def q_placebo_permutation(spark, sf):
    """500 permutation draws of the protected flag for the treated institution, refit
    with all controls in one batched Newton job per step; a summary row with the actual fit."""
    xs = [*CREDIT, *RACE]
    df = prep(spark, sf).where(F.col("institution") == TREAT).select("app_id", "approved", *xs)
    draws = CA.placebo_permutation(df, "approved", xs, "is_black", "app_id", n_draws=500, actual=True)
    actual = draws.where("draw = -1").first()["coef"]
    return rounded(CA.placebo_summary(draws.where("draw >= 0"), actual).select("*", F.lit(actual).alias("actual_coef")))


def odds_ratio_panel(spark, sf):
    """Institution x year panel of the protected odds ratio."""
    fit = glm.logit(prep(spark, sf), "approved", ["is_black"], by=["institution", "activity_year"])
    return glm.term(fit, "is_black").where("odds_ratio IS NOT NULL").select("institution", "activity_year", "odds_ratio")


@register("synthetic_control", section="M")
def q_synthetic_control(spark, sf):
    """Donor weights for the treated institution on its odds ratios before the event."""
    return rounded(CA.synthetic_control(odds_ratio_panel(spark, sf), "institution", "activity_year", "odds_ratio",
                                        POST_YEAR, [TREAT]))


@register("synthetic_gap", section="M")
def q_synthetic_gap(spark, sf):
    """Actual minus synthetic odds ratio of the treated institution by year."""
    panel = odds_ratio_panel(spark, sf)
    w = CA.synthetic_control(panel, "institution", "activity_year", "odds_ratio", POST_YEAR, [TREAT])
    return rounded(CA.synthetic_gap(panel, w, "institution", "activity_year", "odds_ratio"))


@register("event_study_logit", section="M")
def q_event_study_logit(spark, sf):
    """The event study in logit form with the full controls: odds ratios by year."""
    es = CA.event_study(triple_frame(spark, sf), "approved", "is_black", "treat", "activity_year", REF_YEAR,
                        controls=[*CREDIT, "is_hispanic", "is_asian"], model="logit")
    return rounded(es)
