"""Estimator queries. Where the general case is iterative, the
registered query uses a specification with a closed form (single binary
regressor, one-regressor OLS, saturated cells) so the grouped Newton / Gram
engine is value-checked against plain SQL; richer specifications are
registered as rows-only queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import glm
from lodestar.plans import sqlviews as V
from lodestar.plans.common import cte, rounded
from lodestar.plans.registry import register
from lodestar.plans.scalars import apps, prep
from lodestar.session import stored
from lodestar.sources import conform as C

OUT = ["term", "coef", "se", "odds_ratio"]


def _coef_out(df, by, cols=OUT):
    return rounded(df.select(*by, *cols))


def logit_2x2_sql(src: str, by: list[str], y: str, x: str, min_n: int = 0, extra_where: str = "") -> str:
    """Closed-form logit of binary y on binary x per group: log odds ratio and
    se = sqrt(1/a + 1/b + 1/c + 1/d); intercept = log odds in the x = 0 cell."""
    g = ", ".join(by)
    gsel = (g + ", ") if by else ""
    where = f"WHERE n >= {min_n} AND a > 0 AND b > 0 AND c > 0 AND d > 0" + (f" AND {extra_where}" if extra_where else "")
    return f"""
, cells AS (SELECT {gsel}count(*) AS n,
       sum(CASE WHEN {x} = 1 AND {y} = 1 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN {x} = 1 AND {y} = 0 THEN 1 ELSE 0 END) AS b,
       sum(CASE WHEN {x} = 0 AND {y} = 1 THEN 1 ELSE 0 END) AS c, sum(CASE WHEN {x} = 0 AND {y} = 0 THEN 1 ELSE 0 END) AS d
     FROM {src} {'GROUP BY ' + g if by else ''})
SELECT {gsel}'const' AS term, round(ln(c / d), 6) AS coef, round(sqrt(1.0 / c + 1.0 / d), 6) AS se,
       round(c / d, 6) AS odds_ratio FROM cells {where}
UNION ALL
SELECT {gsel}'{x}' AS term, round(ln(a * d / (b * c)), 6) AS coef, round(sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d), 6) AS se,
       round(a * d / (b * c), 6) AS odds_ratio FROM cells {where}"""


# ---------------------------------------------------------------- logit family

@register("logit_fit", section="M", sql="WITH p AS (" + V.prep() + ")" + logit_2x2_sql(
    "p", ["institution"], "approved", "is_black"))
def q_logit_fit(spark, sf):
    fit = glm.logit(prep(spark, sf), "approved", ["is_black"], by=["institution"])
    return _coef_out(fit, ["institution"])


@register("logit_by_group", section="M", sql="WITH p AS (" + V.prep() + ")" + logit_2x2_sql(
    "p", ["institution", "activity_year"], "approved", "is_black", min_n=500))
def q_logit_by_group(spark, sf):
    """One fit per institution x year in a single batched Newton job; groups under 500 rows skipped."""
    fit = glm.logit(prep(spark, sf), "approved", ["is_black"], by=["institution", "activity_year"], min_n=500)
    return _coef_out(fit, ["institution", "activity_year"])


@register("logit_institution_year_panel", section="M", sql="WITH p AS (" + V.prep() + ")" + logit_2x2_sql(
    "p", ["institution", "activity_year"], "approved", "is_black", min_n=300, extra_where="a + b >= 30"))
def q_logit_institution_year_panel(spark, sf):
    df = prep(spark, sf)
    counts = df.groupBy("institution", "activity_year").agg(F.sum("is_black").alias("_np"))
    keep = counts.where(F.col("_np") >= 30).select("institution", "activity_year")
    fit = glm.logit(df.join(keep, ["institution", "activity_year"], "left_semi"), "approved", ["is_black"],
                    by=["institution", "activity_year"], min_n=300)
    return _coef_out(fit, ["institution", "activity_year"])


PRE_POST_SRC = "(SELECT *, CASE WHEN activity_year < 1998 THEN 'pre' ELSE 'post' END AS period FROM p)"


@register("logit_pre_post", section="M", sql="WITH p AS (" + V.prep() + ")" + logit_2x2_sql(
    PRE_POST_SRC, ["institution", "period"], "approved", "is_black"))
def q_logit_pre_post(spark, sf):
    df = prep(spark, sf).withColumn("period", F.when(F.col("activity_year") < 1998, "pre").otherwise("post"))
    fit = glm.logit(df, "approved", ["is_black"], by=["institution", "period"])
    return _coef_out(fit, ["institution", "period"])


QUART_SRC = """(SELECT p.*, CAST(len(list_filter(list_distinct(e.qs), lambda x: x > e.lo AND x < e.hi AND x < p.loan_amount)) AS INTEGER) AS loan_q
  FROM p JOIN (SELECT institution, min(loan_amount) AS lo, max(loan_amount) AS hi,
                      quantile_cont(loan_amount, [0.25, 0.5, 0.75]) AS qs FROM p GROUP BY 1) e
  ON p.institution = e.institution)"""


@register("logit_by_quantile", section="M", sql="WITH p AS (" + V.prep() + ")" + logit_2x2_sql(
    QUART_SRC, ["institution", "loan_q"], "approved", "is_black"))
def q_logit_by_quantile(spark, sf):
    from lodestar.operators import quantiles as Q
    df = Q.qcut(prep(spark, sf), "loan_amount", 4, by=["institution"], duplicates="drop", name="loan_q")
    fit = glm.logit(df, "approved", ["is_black"], by=["institution", "loan_q"])
    return _coef_out(fit, ["institution", "loan_q"])


CHANNEL_SRC = "(SELECT *, CASE WHEN aus_1 = 1 THEN 'DU' WHEN aus_1 = 2 THEN 'LP' ELSE 'manual' END AS channel FROM p WHERE loan_type = 1)"


@register("logit_by_channel", section="M", sql="WITH p AS (" + V.prep() + ")" + logit_2x2_sql(
    CHANNEL_SRC, ["channel"], "approved", "is_black"))
def q_logit_by_channel(spark, sf):
    df = prep(spark, sf).where(F.col("loan_type") == 1).withColumn(
        "channel", F.when(F.col("aus_1") == 1, "DU").when(F.col("aus_1") == 2, "LP").otherwise("manual"))
    return _coef_out(glm.logit(df, "approved", ["is_black"], by=["channel"]), ["channel"])


INSIDE_SRC = "(SELECT *, CASE WHEN state_code IN ('ALGERIA', 'KENYA', 'BRAZIL', 'CANADA', 'FRANCE') THEN 'inside' ELSE 'outside' END AS area FROM p)"
INSIDE_STATES = ["ALGERIA", "KENYA", "BRAZIL", "CANADA", "FRANCE"]


@register("logit_inside_outside", section="M", sql="WITH p AS (" + V.prep() + ")" + logit_2x2_sql(
    INSIDE_SRC, ["institution", "area"], "approved", "is_black"))
def q_logit_inside_outside(spark, sf):
    df = prep(spark, sf).withColumn("area", F.when(F.col("state_code").isin(*INSIDE_STATES), "inside")
                                    .otherwise("outside"))
    return _coef_out(glm.logit(df, "approved", ["is_black"], by=["institution", "area"]), ["institution", "area"])


def odds_sql(src: str, by: list[str]) -> str:
    """Protected odds ratio per group from its four cells (closed form of the one-regressor logit)."""
    g = ", ".join(by)
    return f"""
, cells AS (SELECT {g}, CAST(sum(is_black * approved) AS DOUBLE) AS a, sum(is_black * (1 - approved)) AS b,
                   sum((1 - is_black) * approved) AS c, sum((1 - is_black) * (1 - approved)) AS d FROM {src} GROUP BY {g})
, o AS (SELECT {g}, a * d / (b * c) AS orr FROM cells WHERE a > 0 AND b > 0 AND c > 0 AND d > 0)"""


def odds_by(df, by):
    fit = glm.logit(df, "approved", ["is_black"], by=by)
    return glm.term(fit, "is_black").select(*by, F.col("odds_ratio").alias("orr"))


@register("logit_pre_post_gap", section="M", sql="WITH p AS (" + V.prep() + ")" + odds_sql(PRE_POST_SRC, ["institution", "period"]) + """
SELECT x.institution, round(x.orr, 6) AS or_pre, round(y.orr, 6) AS or_post, round(y.orr - x.orr, 6) AS or_change,
       CASE WHEN y.orr < x.orr THEN 'widened' ELSE 'narrowed' END AS gap
FROM o x JOIN o y ON x.institution = y.institution AND x.period = 'pre' AND y.period = 'post'""")
def q_logit_pre_post_gap(spark, sf):
    """Change of the protected odds ratio from before to after the event, by institution."""
    df = prep(spark, sf).withColumn("period", F.when(F.col("activity_year") < 1998, "pre").otherwise("post"))
    o = odds_by(df, ["institution", "period"]).groupBy("institution").agg(
        F.max(F.when(F.col("period") == "pre", F.col("orr"))).alias("or_pre"),
        F.max(F.when(F.col("period") == "post", F.col("orr"))).alias("or_post")).dropna()
    return rounded(o.select("*", (F.col("or_post") - F.col("or_pre")).alias("or_change"),
                            F.when(F.col("or_post") < F.col("or_pre"), "widened").otherwise("narrowed").alias("gap")))


@register("logit_inside_outside_gap", section="M", sql="WITH p AS (" + V.prep() + ")" + odds_sql(INSIDE_SRC, ["institution", "area"]) + f"""
, w AS (SELECT institution, max(CASE WHEN area = 'inside' THEN orr END) AS or_inside,
               max(CASE WHEN area = 'outside' THEN orr END) AS or_outside FROM o GROUP BY 1)
SELECT institution, round(or_inside, 6) AS or_inside, round(or_outside, 6) AS or_outside,
       round(or_inside - or_outside, 6) AS or_gap,
       round((or_inside - or_outside) - (SELECT avg(or_inside - or_outside) FROM w q WHERE q.institution <> w.institution), 6) AS gap_vs_peers
FROM w""")
def q_logit_inside_outside_gap(spark, sf):
    """Protected odds ratio inside minus outside the assessment area, one row per institution,
    and that gap against the mean of the peers'."""
    df = prep(spark, sf).withColumn("area", F.when(F.col("state_code").isin(*INSIDE_STATES), "inside").otherwise("outside"))
    w = odds_by(df, ["institution", "area"]).groupBy("institution").agg(
        F.max(F.when(F.col("area") == "inside", F.col("orr"))).alias("or_inside"),
        F.max(F.when(F.col("area") == "outside", F.col("orr"))).alias("or_outside"))
    w = w.withColumn("or_gap", F.col("or_inside") - F.col("or_outside"))
    t = w.agg(F.sum("or_gap").alias("s"), F.count("or_gap").alias("k")).first()  # two numbers
    own = F.col("or_gap").isNotNull().cast("int")
    peers = (F.lit(t["s"]) - F.coalesce("or_gap", F.lit(0.0))) / F.nullif(F.lit(t["k"]) - own, F.lit(0))
    return rounded(w.select("*", (F.col("or_gap") - peers).alias("gap_vs_peers")))


def _bucket_sql(q: int) -> str:
    inner = ", ".join(repr(i / q) for i in range(1, q))
    return f"""(SELECT p.*, CAST(len(list_filter(list_distinct(e.qs), lambda x: x > e.lo AND x < e.hi AND x < p.loan_amount)) AS INTEGER) AS loan_q
  FROM p, (SELECT min(loan_amount) AS lo, max(loan_amount) AS hi, quantile_cont(loan_amount, [{inner}]) AS qs FROM p) e)"""


def _by_bucket(spark, sf, q):
    from lodestar.operators import quantiles as Q
    df = Q.qcut(prep(spark, sf), "loan_amount", q, duplicates="drop", name="loan_q")
    return rounded(odds_by(df, ["loan_q"]).withColumnRenamed("orr", "odds_ratio").dropna())


@register("logit_by_decile", section="M", sql="WITH p AS (" + V.prep() + ")" + odds_sql(_bucket_sql(10), ["loan_q"])
          + " SELECT loan_q, round(orr, 6) AS odds_ratio FROM o")
def q_logit_by_decile(spark, sf):
    """Protected odds ratio by decile of the loan amount."""
    return _by_bucket(spark, sf, 10)


@register("logit_by_tercile", section="M", sql="WITH p AS (" + V.prep() + ")" + odds_sql(_bucket_sql(3), ["loan_q"])
          + " SELECT loan_q, round(orr, 6) AS odds_ratio FROM o")
def q_logit_by_tercile(spark, sf):
    """Protected odds ratio by tercile of the loan amount."""
    return _by_bucket(spark, sf, 3)


@register("logit_full_by_stratum", section="M")
def q_logit_full_by_stratum(spark, sf):
    """Full-control fits by institution, year, purpose, state and income band in one batched
    call: a row belongs to one stratum of each kind. Controls that are constant in a
    stratum are left out of its fit; strata under 500 rows are skipped."""
    from lodestar.operators import quantiles as Q
    kinds = {"institution": "institution", "year": "activity_year", "purpose": "loan_purpose", "state": "state_code",
             "income_band": "income_band"}
    xs = [*C.CREDIT_FEATURES, *C.RACE_FEATURES]
    # stored: the quantiles read the rows several times
    rows = stored(prep(spark, sf).select("approved", *xs, "income", *[c for c in kinds.values() if c != "income_band"]), "strata_rows")
    df = Q.qcut(rows, "income", 4, duplicates="drop", name="income_band")
    d = df.select(F.col("approved").cast("double").alias("approved"), *[F.col(x).cast("double").alias(x) for x in xs],
                  *[F.col(c).cast("string").alias(f"_{k}") for k, c in kinds.items()],
                  *[F.lit(None).cast("string").alias(c) for c in ("kind", "level")]).dropna(subset=["approved", *xs])
    blocks = glm.blocks_by_kind({k: f"_{k}" for k in kinds}, "approved", xs)
    fit = glm.term(glm.logit(d, "approved", xs, by=["kind", "level"], min_n=500, blocks=blocks), "is_black")
    return rounded(fit.select("kind", "level", "coef", "se", "p", "odds_ratio", "or_lo", "or_hi", "n", "r2"))


@register("logit_wide", section="M")
def q_logit_wide(spark, sf):
    """The wide form's 22 credit features and the group flags, by institution."""
    df = C.application_features_wide(apps(spark, sf))
    return rounded(glm.logit(df, "approved", [*C.WIDE_FEATURES, *C.RACE_FEATURES], by=["institution"]))


@register("application_features_wide", section="Q", sql="WITH p AS (" + V.prep() + f""")
, m AS (SELECT median(combined_loan_to_value_ratio) AS ltv, median(dti_mid) AS dti, median(log_income) AS inc FROM p)
SELECT institution, count(*) AS n, round(sum(coalesce(combined_loan_to_value_ratio, m.ltv)), 4) AS ltv,
       round(sum(coalesce(dti_mid, m.dti)), 4) AS dti, round(sum(coalesce(log_income, m.inc)), 4) AS log_income,
       CAST(sum(CAST(loan_type = 2 AS INTEGER)) AS BIGINT) AS is_fha, CAST(sum(CAST(loan_type = 3 AS INTEGER)) AS BIGINT) AS is_va,
       CAST(sum(CAST(loan_type = 4 AS INTEGER)) AS BIGINT) AS is_usda,
       CAST(sum(CAST(occupancy_type = 3 AS INTEGER)) AS BIGINT) AS is_investment,
       CAST(sum(CAST(occupancy_type = 2 AS INTEGER)) AS BIGINT) AS is_second_home,
       CAST(sum(CAST(lien_status = 2 AS INTEGER)) AS BIGINT) AS is_subordinate,
       CAST(sum(CAST(construction_method = 2 AS INTEGER)) AS BIGINT) AS is_manufactured,
       CAST(sum(CAST(loan_term BETWEEN 355 AND 365 AS INTEGER)) AS BIGINT) AS is_30yr,
       CAST(sum(CAST(lower(conforming_loan_limit) = 'c' AS INTEGER)) AS BIGINT) AS is_conforming,
       CAST(sum(CAST(aus_1 = 1 AS INTEGER)) AS BIGINT) AS aus_du, CAST(sum(CAST(aus_1 = 2 AS INTEGER)) AS BIGINT) AS aus_lp,
       CAST(sum(CAST(aus_1 BETWEEN 3 AND 7 AS INTEGER)) AS BIGINT) AS aus_manual,
       CAST(sum(CAST(combined_loan_to_value_ratio IS NULL AS INTEGER)) AS BIGINT) AS miss_ltv,
       CAST(sum(CAST(dti_mid IS NULL AS INTEGER)) AS BIGINT) AS miss_dti,
       CAST(sum(CAST(log_income IS NULL AS INTEGER)) AS BIGINT) AS miss_income
FROM p, m GROUP BY 1""")
def q_application_features_wide(spark, sf):
    """Sums of the wide form's features by institution (its values checked in aggregate)."""
    d = C.application_features_wide(apps(spark, sf))
    flags = [c for c in C.WIDE_FEATURES if c.startswith(("is_", "aus_", "miss_"))]
    return d.groupBy("institution").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("ltv"), 4).alias("ltv"), F.round(F.sum("dti_mid"), 4).alias("dti"),
        F.round(F.sum("log_income"), 4).alias("log_income"), *[F.sum(c).cast("long").alias(c) for c in flags])


OUTCOME_SRC = """(SELECT p.*, o.outcome_level AS outcome_level,
   CAST(p.outcome_cat = o.outcome_level AS INTEGER) AS y_outcome
 FROM (SELECT *, {oc} AS outcome_cat FROM p) p
 JOIN (SELECT * FROM (VALUES ('credit_history'), ('dti'), ('collateral'), ('incomplete'), ('other_denial')) t(outcome_level)) o
   ON p.outcome_cat IN (o.outcome_level, 'originated'))"""


def _outcome_src():
    from lodestar.plans.scalars import OUTCOME_SQL
    return OUTCOME_SRC.format(oc=OUTCOME_SQL)


@register("logit_outcome_vs_reference", section="M", sql="WITH p AS (" + V.prep() + ")" + logit_2x2_sql(
    _outcome_src(), ["outcome_level"], "y_outcome", "is_black"))
def q_logit_outcome_vs_reference(spark, sf):
    """Binary logit of each denial category vs the reference (originated), all in one batched job."""
    from lodestar.plans.scalars import outcome_category
    df = prep(spark, sf).withColumn("outcome_cat", outcome_category())
    levels = ["credit_history", "dti", "collateral", "incomplete", "other_denial"]
    # a reference row serves every level, a denied row its own
    own = F.when(F.col("outcome_cat") == "originated", F.array(*[F.lit(x) for x in levels])).when(
        F.col("outcome_cat").isin(levels), F.array("outcome_cat"))
    pairs = df.withColumn("outcome_level", F.explode(own))
    pairs = pairs.withColumn("y_outcome", (F.col("outcome_cat") == F.col("outcome_level")).cast("int"))
    # few distinct rows: each is fitted once, with its number
    cells = stored(pairs.groupBy("outcome_level", "y_outcome", "is_black").agg(F.count(F.lit(1)).alias("times")), "cells")
    return _coef_out(glm.logit(cells, "y_outcome", ["is_black"], by=["outcome_level"], times="times"), ["outcome_level"])


@register("pipeline_stage_logit", section="M", sql="WITH f AS (" + V.F1 + """), p AS (SELECT *,
   CAST(derived_race = 'Black or African American' AS INTEGER) AS is_black,
   CAST(action_taken = 1 AS INTEGER) AS originated, 'vs_all_other' AS stage FROM f
   UNION ALL SELECT *, CAST(derived_race = 'Black or African American' AS INTEGER), CAST(action_taken = 1 AS INTEGER),
   'vs_denied' FROM f WHERE action_taken IN (1, 3))""" + logit_2x2_sql("p", ["stage"], "originated", "is_black"))
def q_pipeline_stage_logit(spark, sf):
    a = apps(spark, sf).withColumn("is_black", (F.col("derived_race") == "Black or African American").cast("int")) \
        .withColumn("originated", (F.col("action_taken") == 1).cast("int"))
    both = a.withColumn("stage", F.lit("vs_all_other")).unionByName(
        a.where(F.col("action_taken").isin(1, 3)).withColumn("stage", F.lit("vs_denied")))
    return _coef_out(glm.logit(both, "originated", ["is_black"], by=["stage"]), ["stage"])


# ---------------------------------------------------------------- OLS family

@register("ols_fit", section="M", sql=cte(f4=V.F4) + """
, s AS (SELECT loan_purpose, count(*) AS n, regr_slope(original_rate, fico) AS b, regr_intercept(original_rate, fico) AS a,
               regr_sxx(original_rate, fico) AS sxx, regr_syy(original_rate, fico) AS syy,
               regr_sxy(original_rate, fico) AS sxy, avg(fico) AS xbar FROM f4 GROUP BY 1)
SELECT loan_purpose, 'const' AS term, round(a, 6) AS coef,
       round(sqrt((syy - sxy * sxy / sxx) / (n - 2) * (1.0 / n + xbar * xbar / sxx)), 6) AS se,
       round(1 - (syy - sxy * sxy / sxx) / syy, 6) AS r2 FROM s
UNION ALL SELECT loan_purpose, 'fico', round(b, 6), round(sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 6),
       round(1 - (syy - sxy * sxy / sxx) / syy, 6) FROM s""")
def q_ols_fit(spark, sf):
    fit = glm.ols(C.loan_months(spark, sf), "original_rate", ["fico"], by=["loan_purpose"])
    return rounded(fit.select("loan_purpose", "term", "coef", "se", "r2"))


HC3_SQL = "WITH p AS (" + V.prep() + """)
, s AS (SELECT institution, count(*) AS n,
          avg(CASE WHEN is_black = 0 THEN approved END) AS m0, avg(CASE WHEN is_black = 1 THEN approved END) AS m1,
          var_samp(CASE WHEN is_black = 0 THEN approved END) AS v0, var_samp(CASE WHEN is_black = 1 THEN approved END) AS v1,
          count(CASE WHEN is_black = 0 THEN 1 END) AS n0, count(CASE WHEN is_black = 1 THEN 1 END) AS n1
        FROM p GROUP BY 1)
SELECT institution, 'const' AS term, round(m0, 6) AS coef, round(sqrt(v0 / (n0 - 1)), 6) AS se FROM s
UNION ALL SELECT institution, 'is_black', round(m1 - m0, 6), round(sqrt(v1 / (n1 - 1) + v0 / (n0 - 1)), 6) FROM s"""


@register("ols_hc3", section="M", sql=HC3_SQL)
def q_ols_hc3(spark, sf):
    """Linear probability model with HC3 errors; a binary regressor has the
    closed form var(b) = sum_g sum e^2 / (n_g - 1)^2."""
    fit = glm.ols(prep(spark, sf), "approved", ["is_black"], by=["institution"], cov_type="HC3")
    return rounded(fit.select("institution", "term", "coef", "se"))


@register("ols_cluster", section="M", sql="WITH p AS (" + V.prep() + """)
, d AS (SELECT institution, state_code, approved - avg(approved) OVER (PARTITION BY institution) AS yt,
               log_loan_amount - avg(log_loan_amount) OVER (PARTITION BY institution) AS xt FROM p)
, b AS (SELECT institution, sum(xt * yt) / sum(xt * xt) AS b, sum(xt * xt) AS sxx, count(*) AS n,
               count(DISTINCT state_code) AS g FROM d GROUP BY 1)
, sg AS (SELECT d.institution, d.state_code, sum(d.xt * (d.yt - b.b * d.xt)) AS s FROM d JOIN b USING (institution)
         GROUP BY ALL)
SELECT b.institution, 'log_loan_amount' AS term, round(b.b, 6) AS coef,
       round(sqrt(b.g / (b.g - 1.0) * (b.n - 1.0) / (b.n - 2.0) * sum(sg.s * sg.s) / (b.sxx * b.sxx)), 6) AS se
FROM b JOIN sg USING (institution) GROUP BY b.institution, b.b, b.g, b.n, b.sxx""")
def q_ols_cluster(spark, sf):
    fit = glm.ols(prep(spark, sf), "approved", ["log_loan_amount"], by=["institution"], cov_type="cluster",
                  cluster="state_code")
    return rounded(glm.term(fit, "log_loan_amount").select("institution", "term", "coef", "se"))
