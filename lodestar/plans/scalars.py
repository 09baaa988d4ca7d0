"""Projection, predicate and scalar-function queries, mostly on
the application proxy F1. Every query aggregates or projects whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import scalars as S
from lodestar.operators import frames
from lodestar.plans import sqlviews as V
from lodestar.plans.common import cte, rounded
from lodestar.plans.registry import register
from lodestar.sources import conform as C

# ---------------------------------------------------------------- fixed values
# Proxy institution rules for the complaint proxy (ordered, first match wins).
PROXY_INSTITUTION_RULES = [("middle east", "Mideast Group"), ("africa", "Africa Bancorp"),
                           ("america", "America Bancorp"), ("asia", "Asia Bancorp")]
PROXY_SUBJECT_KEYWORDS = ["africa"]
PROXY_PEER_KEYWORDS = ["america", "europe"]
# Literal removals applied in order by the entity-name cleaner.
NAME_REMOVALS = ["national bank", "federal savings bank", "state bank", "savings bank", "community bank"]
# FICO and LTV bands of the price grid.
FICO_BANDS = [(780, ">=780"), (760, "760-779"), (740, "740-759"), (720, "720-739"), (700, "700-719"),
              (680, "680-699"), (660, "660-679")]
FICO_FLOOR_LABEL = "<660"
LTV_BANDS = [(60, "<=60"), (75, "60-75"), (80, "75-80"), (85, "80-85"), (90, "85-90"), (95, "90-95")]
LTV_CEIL_LABEL = ">95"
PURPOSE_LABELS = {"1": "purchase", "31": "refinance", "32": "cash_out"}


def apps(spark, sf):
    return C.applications(spark, sf)


def prep(spark, sf, **kw):
    return C.application_features(C.applications(spark, sf), **kw)


def _cnt():
    return F.count(F.lit(1)).alias("n")


# ---------------------------------------------------------------- names / projection

RAW_NAMES = {"complaint_id": "Complaint ID", "product": "Product", "company": "Company",
             "timely_response": "Timely response?", "state": "State", "date_received": "Date-received"}


@register("normalize_colnames", section="P", sql=cte(f3=V.F3) + """
SELECT complaint_id, product, company, timely_response, state, CAST(date_received AS VARCHAR) AS date_received
FROM f3""")
def q_normalize_colnames(spark, sf):
    raw = C.complaints(spark, sf).select(*[F.col(k).alias(v) for k, v in RAW_NAMES.items()])
    return rounded(frames.normalize_colnames(raw))


@register("drop_dup_columns", section="P", sql="""
SELECT o_orderkey AS id, o_custkey AS cust, c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey""")
def q_drop_dup_columns(spark, sf):
    o = C.read(spark, sf, "orders", "o_orderkey", "o_custkey")
    c = C.read(spark, sf, "customer", "c_custkey", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("c_custkey").alias("cust"),
        F.col("c_nationkey").alias("nation"))
    return frames.drop_dup_columns(j)


@register("select_available", section="P", sql=cte(f1=V.F1) + """
SELECT institution, activity_year, loan_amount, CAST(NULL AS DOUBLE) AS census_tract_income FROM f1""")
def q_select_available(spark, sf):
    want = ["institution", "activity_year", "loan_amount", "census_tract_income"]
    return rounded(frames.select_available(apps(spark, sf), want, defaults={"census_tract_income": "double"}))


@register("coerce_numeric", section="P", sql=cte(f1=V.F1) + """
SELECT TRY_CAST(debt_to_income_ratio AS DOUBLE) AS dti_num, count(*) AS n FROM f1 GROUP BY 1""")
def q_coerce_numeric(spark, sf):
    df = apps(spark, sf)
    return rounded(df.groupBy(S.coerce_numeric("debt_to_income_ratio").alias("dti_num")).agg(_cnt()))


def _date_text():
    return F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("bad"), F.col("o_orderkey").cast("string"))) \
        .otherwise(F.date_format("o_orderdate", "yyyyMMdd"))


@register("coerce_date", section="P", sql="""
SELECT CAST(CAST(try_strptime(CASE WHEN o_orderkey % 10 = 0 THEN 'bad' || CAST(o_orderkey AS VARCHAR)
            ELSE strftime(o_orderdate, '%Y%m%d') END, '%Y%m%d') AS DATE) AS VARCHAR) AS d, count(*) AS n
FROM orders GROUP BY 1""")
def q_coerce_date(spark, sf):
    o = C.read(spark, sf, "orders", "o_orderkey", "o_orderdate")
    return rounded(o.groupBy(S.coerce_date(_date_text()).alias("d")).agg(_cnt()))


@register("year_from_mmyyyy", section="P", sql="""
SELECT TRY_CAST(right(strftime(l_shipdate, '%m%Y'), 4) AS INTEGER) AS first_payment_year, count(*) AS n
FROM lineitem GROUP BY 1""")
def q_year_from_mmyyyy(spark, sf):
    lm = C.loan_months(spark, sf)
    return lm.groupBy(S.year_from_mmyyyy("first_payment_date").alias("first_payment_year")).agg(_cnt())


@register("quarter_key", section="P", sql=cte(f3=V.F3) + f"""
SELECT CAST({V.quarter_start('date_received')} AS VARCHAR) AS quarter_dt,
       CAST(year(date_received) AS VARCHAR) || 'Q' || CAST(quarter(date_received) AS VARCHAR) AS quarter_str,
       CAST(year(date_received) AS INTEGER) AS year, count(*) AS n
FROM f3 GROUP BY ALL""")
def q_quarter_key(spark, sf):
    f3 = C.complaints(spark, sf)
    return rounded(f3.groupBy(S.quarter_start("date_received").alias("quarter_dt"),
                              S.quarter_label("date_received").alias("quarter_str"),
                              F.year("date_received").alias("year")).agg(_cnt()))


@register("log1p_clip0", section="P", sql=cte(f1=V.F1) + f"""
SELECT state_code, round(sum({V.log1p0('income')}), 4) AS sum_log_income,
       round(sum({V.log1p0('loan_amount')}), 4) AS sum_log_loan FROM f1 GROUP BY 1""")
def q_log1p_clip0(spark, sf):
    df = apps(spark, sf)
    return df.groupBy("state_code").agg(F.round(F.sum(S.log1p_clip0("income")), 4).alias("sum_log_income"),
                                        F.round(F.sum(S.log1p_clip0("loan_amount")), 4).alias("sum_log_loan"))


DTI_FIXTURE = ["<20%", "20%-<30%", "30%-<36%", "36", "50%-60%", ">60%", "Exempt", "NA", "45%"]


@register("dti_midpoint", section="P", sql=cte(f1=V.F1) + f"""
SELECT debt_to_income_ratio, {V.dti_sql('debt_to_income_ratio', 'A')} AS dti_a,
       {V.dti_sql('debt_to_income_ratio', 'B')} AS dti_b, count(*) AS n FROM f1 GROUP BY ALL""")
def q_dti_midpoint(spark, sf):
    df = apps(spark, sf)
    return rounded(df.groupBy("debt_to_income_ratio", S.dti_midpoint("debt_to_income_ratio", "A").alias("dti_a"),
                              S.dti_midpoint("debt_to_income_ratio", "B").alias("dti_b")).agg(_cnt()))


FLAG_SQL = """
CAST(coalesce(loan_type = 2, false) AS INTEGER) AS is_fha, CAST(coalesce(loan_type = 3, false) AS INTEGER) AS is_va,
CAST(coalesce(loan_type = 4, false) AS INTEGER) AS is_usda,
CAST(coalesce(occupancy_type = 3, false) AS INTEGER) AS is_investment,
CAST(coalesce(aus_1 = 1, false) AS INTEGER) AS aus_du, CAST(coalesce(aus_1 IN (3, 4, 5, 6, 7), false) AS INTEGER) AS aus_manual,
CAST(coalesce(loan_term BETWEEN 355 AND 365, false) AS INTEGER) AS is_30yr"""


def flag_columns():
    lt, oc, aus = F.col("loan_type"), F.col("occupancy_type"), F.col("aus_1")
    return [S.indicator(lt == 2).alias("is_fha"), S.indicator(lt == 3).alias("is_va"),
            S.indicator(lt == 4).alias("is_usda"), S.indicator(oc == 3).alias("is_investment"),
            S.indicator(aus == 1).alias("aus_du"), S.indicator(aus.isin(3, 4, 5, 6, 7)).alias("aus_manual"),
            S.indicator(F.col("loan_term").between(355, 365)).alias("is_30yr")]


@register("indicator_flags", section="P", sql=cte(p=V.prep()) + f"""
SELECT is_black, is_white, is_asian, is_hispanic, purpose_purchase, purpose_refi, purpose_cashout, is_fha, is_va,
       is_usda, is_investment, aus_du, aus_manual, is_30yr, count(*) AS n
FROM (SELECT *, {FLAG_SQL} FROM p) GROUP BY ALL""")
def q_indicator_flags(spark, sf):
    df = prep(spark, sf).select("*", *flag_columns())
    keys = ["is_black", "is_white", "is_asian", "is_hispanic", "purpose_purchase", "purpose_refi",
            "purpose_cashout", "is_fha", "is_va", "is_usda", "is_investment", "aus_du", "aus_manual", "is_30yr"]
    return df.groupBy(*keys).agg(_cnt())


@register("filter_membership", section="P", sql=cte(f1=V.F1) + """
SELECT institution, count(*) AS n FROM f1
WHERE action_taken IN (1, 3) AND activity_year BETWEEN 1996 AND 2000 AND combined_loan_to_value_ratio IS NOT NULL
  AND loan_amount >= 1000 AND income <= 9000
GROUP BY 1""")
def q_filter_membership(spark, sf):
    df = apps(spark, sf).where(
        F.col("action_taken").isin(1, 3) & F.col("activity_year").between(1996, 2000)
        & F.col("combined_loan_to_value_ratio").isNotNull() & (F.col("loan_amount") >= 1000)
        & (F.col("income") <= 9000))
    return df.groupBy("institution").agg(_cnt())


def _kw_sql(col, kws):
    return "(" + " OR ".join(f"strpos(lower({col}), '{k}') > 0" for k in kws) + ")"


@register("keyword_any", section="P", sql=cte(f3=V.F3) + f"""
SELECT CAST(coalesce({_kw_sql('company', PROXY_SUBJECT_KEYWORDS)}, false) AS INTEGER) AS is_subject,
       CAST(coalesce({_kw_sql('company', PROXY_PEER_KEYWORDS)}, false) AS INTEGER) AS is_peer, count(*) AS n
FROM f3 GROUP BY ALL""")
def q_keyword_any(spark, sf):
    f3 = C.complaints(spark, sf)
    return f3.groupBy(S.keyword_any("company", PROXY_SUBJECT_KEYWORDS).cast("int").alias("is_subject"),
                      S.keyword_any("company", PROXY_PEER_KEYWORDS).cast("int").alias("is_peer")).agg(_cnt())


def _norm_sql(col, rules, default="'Other'"):
    whens = " ".join(f"WHEN strpos(lower({col}), '{k}') > 0 THEN '{v}'" for k, v in rules)
    return f"CASE {whens} ELSE {default} END"


@register("normalize_entity", section="P", sql=cte(f3=V.F3) + f"""
SELECT {_norm_sql('company', PROXY_INSTITUTION_RULES)} AS canonical, count(*) AS n FROM f3 GROUP BY 1""")
def q_normalize_entity(spark, sf):
    f3 = C.complaints(spark, sf)
    return f3.groupBy(S.normalize_entity("company", PROXY_INSTITUTION_RULES).alias("canonical")).agg(_cnt())


def _noisy_names_sql():
    return """
SELECT DISTINCT p_name AS name FROM part
UNION ALL SELECT DISTINCT upper(p_name) || ' National Bank, N.A.' FROM part
UNION ALL SELECT DISTINCT p_name || ' state bank.' FROM part"""


def _replace_chain_sql(col="lower(name)"):
    s = col
    for r in NAME_REMOVALS:
        s = f"replace({s}, '{r}', '')"
    return s


def noisy_names(spark, sf):
    p = C.read(spark, sf, "part", "p_name").distinct()
    return p.select(F.col("p_name").alias("name")).unionByName(
        p.select(F.concat(F.upper("p_name"), F.lit(" National Bank, N.A.")).alias("name"))).unionByName(
        p.select(F.concat(F.col("p_name"), F.lit(" state bank.")).alias("name")))


@register("clean_entity_name", section="P", sql=f"""
SELECT name, trim(replace(replace({_replace_chain_sql()}, ',', ''), '.', '')) AS name_clean
FROM ({_noisy_names_sql()}) s""")
def q_clean_entity_name(spark, sf):
    n = noisy_names(spark, sf)
    return n.select("name", S.clean_entity_name("name", NAME_REMOVALS).alias("name_clean"))


WS = "[ \\t\\n\\r\\f]"


@register("text_filter_norm", section="P", sql=f"""
SELECT doc_id, source AS institution, CAST(length(regexp_replace(regexp_replace(lower(text), '^{WS}+', ''), '{WS}+$', '')) AS INTEGER) AS n_norm,
       md5(regexp_replace(regexp_replace(lower(text), '^{WS}+', ''), '{WS}+$', '')) AS h
FROM documents WHERE length(text) > 50""")
def q_text_filter_norm(spark, sf):
    d = C.read(spark, sf, "documents", "doc_id", "source", "text").where(F.length("text") > 50)
    norm = F.regexp_replace(F.regexp_replace(F.lower("text"), f"^{WS}+", ""), f"{WS}+$", "")
    return d.select("doc_id", F.col("source").alias("institution"), F.length(norm).alias("n_norm"),
                    F.md5(norm).alias("h"))


def _purpose_map_sql():
    rows = ", ".join(f"('{k}', '{v}')" for k, v in PURPOSE_LABELS.items())
    return f"(SELECT * FROM (VALUES {rows}) t(code, label))"


@register("map_with_default", section="P", sql=cte(f1=V.F1) + f"""
SELECT coalesce(m.label, 'other') AS purpose_label, count(*) AS n
FROM f1 LEFT JOIN {_purpose_map_sql()} m ON f1.loan_purpose = m.code GROUP BY 1""")
def q_map_with_default(spark, sf):
    df = apps(spark, sf)
    lookup = frames.lookup_table(spark, PURPOSE_LABELS, "code", "label")
    return frames.map_with_default(df, lookup, "loan_purpose", "code", "label", "other", "purpose_label") \
        .groupBy("purpose_label").agg(_cnt())


def outcome_category():
    dr = S.coerce_numeric("denial_reason_1")
    return (F.when(F.col("approved") == 1, "originated").when(dr == 3, "credit_history").when(dr == 1, "dti")
            .when(dr == 4, "collateral").when(dr == 7, "incomplete").otherwise("other_denial"))


OUTCOME_SQL = """CASE WHEN approved = 1 THEN 'originated'
  WHEN TRY_CAST(denial_reason_1 AS DOUBLE) = 3 THEN 'credit_history'
  WHEN TRY_CAST(denial_reason_1 AS DOUBLE) = 1 THEN 'dti'
  WHEN TRY_CAST(denial_reason_1 AS DOUBLE) = 4 THEN 'collateral'
  WHEN TRY_CAST(denial_reason_1 AS DOUBLE) = 7 THEN 'incomplete' ELSE 'other_denial' END"""


@register("case_category", section="P", sql=cte(p=V.prep()) + f"""
SELECT {OUTCOME_SQL} AS outcome, count(*) AS n FROM p GROUP BY 1""")
def q_case_category(spark, sf):
    return prep(spark, sf).groupBy(outcome_category().alias("outcome")).agg(_cnt())


def fico_band(c="fico"):
    x = F.col(c)
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for lo, lab in FICO_BANDS:
        out = out.when(x >= lo, lab)
    return out.otherwise(FICO_FLOOR_LABEL)


def ltv_band(c="original_ltv"):
    x = F.col(c)
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for hi, lab in LTV_BANDS:
        out = out.when(x <= hi, lab)
    return out.otherwise(LTV_CEIL_LABEL)


def fico_band_sql(c="fico"):
    return ("CASE WHEN " + c + " IS NULL THEN NULL " + " ".join(f"WHEN {c} >= {lo} THEN '{lab}'" for lo, lab in FICO_BANDS)
            + f" ELSE '{FICO_FLOOR_LABEL}' END")


def ltv_band_sql(c="original_ltv"):
    return ("CASE WHEN " + c + " IS NULL THEN NULL " + " ".join(f"WHEN {c} <= {hi} THEN '{lab}'" for hi, lab in LTV_BANDS)
            + f" ELSE '{LTV_CEIL_LABEL}' END")


@register("band_value", section="P", sql=cte(f4=V.F4) + f"""
SELECT {fico_band_sql()} AS fico_band, {ltv_band_sql()} AS ltv_band, count(*) AS n FROM f4 GROUP BY ALL""")
def q_band_value(spark, sf):
    lm = C.loan_months(spark, sf)
    return lm.groupBy(fico_band().alias("fico_band"), ltv_band().alias("ltv_band")).agg(_cnt())


@register("significance_label", section="P", sql="""
SELECT CASE WHEN l_discount * 2 < 0.01 THEN '***' WHEN l_discount * 2 < 0.05 THEN '**'
            WHEN l_discount * 2 < 0.1 THEN '*' ELSE 'n.s.' END AS sig, count(*) AS n FROM lineitem GROUP BY 1""")
def q_significance_label(spark, sf):
    li = C.read(spark, sf, "lineitem", "l_discount")
    return li.groupBy(S.significance_label(F.col("l_discount") * 2).alias("sig")).agg(_cnt())


REASONS = [f"denial_reason_{k}" for k in range(1, 5)]


@register("row_any_equals", section="P", sql=cte(f1=V.F1) + """
SELECT institution, CAST(coalesce(denial_reason_1 = '3' OR denial_reason_2 = '3' OR denial_reason_3 = '3'
       OR denial_reason_4 = '3', false) AS INTEGER) AS has_credit_history, count(*) AS n FROM f1 GROUP BY ALL""")
def q_row_any_equals(spark, sf):
    df = apps(spark, sf)
    return df.groupBy("institution", S.row_any_equals(REASONS, 3).cast("int").alias("has_credit_history")).agg(_cnt())


@register("row_count_nonblank", section="P", sql=cte(f1=V.F1) + """
SELECT CAST(CAST(coalesce(denial_reason_1 IS NOT NULL AND trim(denial_reason_1) <> '', false) AS INTEGER) + CAST(coalesce(denial_reason_2 IS NOT NULL AND trim(denial_reason_2) <> '', false) AS INTEGER) + CAST(coalesce(denial_reason_3 IS NOT NULL AND trim(denial_reason_3) <> '', false) AS INTEGER) + CAST(coalesce(denial_reason_4 IS NOT NULL AND trim(denial_reason_4) <> '', false) AS INTEGER) AS INTEGER) AS n_reasons, count(*) AS n
FROM f1 GROUP BY 1""")
def q_row_count_nonblank(spark, sf):
    return apps(spark, sf).groupBy(S.row_count_nonblank(REASONS).alias("n_reasons")).agg(_cnt())


@register("unpivot_reasons", section="P", sql=cte(f1=V.F1) + """
SELECT reason, count(*) AS n_citations FROM (
  UNPIVOT (SELECT denial_reason_1, denial_reason_2, denial_reason_3, denial_reason_4 FROM f1 WHERE action_taken = 3)
  ON denial_reason_1, denial_reason_2, denial_reason_3, denial_reason_4 INTO NAME slot VALUE reason)
WHERE reason IS NOT NULL AND trim(reason) <> '' GROUP BY 1""")
def q_unpivot_reasons(spark, sf):
    df = apps(spark, sf).where(F.col("action_taken") == 3)
    long = frames.unpivot_nonblank(df, [], REASONS, "slot", "reason")
    return long.groupBy("reason").agg(F.count(F.lit(1)).alias("n_citations"))


@register("impute_constant", section="P", sql=cte(f1=V.F1) + """
SELECT institution, round(sum(coalesce(combined_loan_to_value_ratio, 0)), 4) AS ltv_sum,
       round(avg(coalesce(combined_loan_to_value_ratio, 0)), 6) AS ltv_mean FROM f1 GROUP BY 1""")
def q_impute_constant(spark, sf):
    df = apps(spark, sf).fillna(0.0, subset=["combined_loan_to_value_ratio"])
    return df.groupBy("institution").agg(F.round(F.sum("combined_loan_to_value_ratio"), 4).alias("ltv_sum"),
                                         F.round(F.avg("combined_loan_to_value_ratio"), 6).alias("ltv_mean"))


@register("impute_median", section="P", sql=cte(p=V.prep()) + """
, m AS (SELECT quantile_cont(combined_loan_to_value_ratio, 0.5) AS med_ltv, quantile_cont(dti_mid, 0.5) AS med_dti FROM p)
SELECT institution, round(avg(coalesce(combined_loan_to_value_ratio, med_ltv)), 6) AS ltv_mean,
       round(avg(coalesce(dti_mid, med_dti)), 6) AS dti_mean, count(*) AS n FROM p, m GROUP BY 1""")
def q_impute_median(spark, sf):
    from lodestar.operators import aggs
    df = aggs.impute_median(prep(spark, sf), ["combined_loan_to_value_ratio", "dti_mid"])
    return rounded(df.groupBy("institution").agg(F.avg("combined_loan_to_value_ratio").alias("ltv_mean"),
                                                 F.avg("dti_mid").alias("dti_mean"), _cnt()))


@register("missing_flags", section="P", sql=cte(p=V.prep()) + """
SELECT CAST(combined_loan_to_value_ratio IS NULL AS INTEGER) AS miss_ltv, CAST(dti_mid IS NULL AS INTEGER) AS miss_dti,
       count(*) AS n FROM p GROUP BY ALL""")
def q_missing_flags(spark, sf):
    df = prep(spark, sf)
    return df.groupBy(F.col("combined_loan_to_value_ratio").isNull().cast("int").alias("miss_ltv"),
                      F.col("dti_mid").isNull().cast("int").alias("miss_dti")).agg(_cnt())


@register("drop_incomplete", section="P", sql=cte(p=V.prep()) + """
SELECT institution, count(*) AS n FROM p
WHERE log_income IS NOT NULL AND log_loan_amount IS NOT NULL AND dti_mid IS NOT NULL GROUP BY 1""")
def q_drop_incomplete(spark, sf):
    df = prep(spark, sf).dropna(subset=["log_income", "log_loan_amount", "dti_mid"])
    return df.groupBy("institution").agg(_cnt())


CONST_CANDIDATES = ["is_black", "is_hispanic", "is_asian", "purpose_purchase", "dti_mid", "approved"]


@register("drop_constant_features", section="P", sql=cte(p=V.prep()) + """
SELECT institution, feature FROM (
  SELECT institution, 'is_black' AS feature, stddev_samp(is_black) AS sd FROM p GROUP BY 1
  UNION ALL SELECT institution, 'is_hispanic', stddev_samp(is_hispanic) FROM p GROUP BY 1
  UNION ALL SELECT institution, 'is_asian', stddev_samp(is_asian) FROM p GROUP BY 1
  UNION ALL SELECT institution, 'purpose_purchase', stddev_samp(purpose_purchase) FROM p GROUP BY 1
  UNION ALL SELECT institution, 'dti_mid', stddev_samp(dti_mid) FROM p GROUP BY 1
  UNION ALL SELECT institution, 'approved', stddev_samp(approved) FROM p GROUP BY 1
  UNION ALL SELECT institution, 'loan_purpose_is_home', stddev_samp(CAST(loan_purpose <> '' AS INTEGER)) FROM p GROUP BY 1)
WHERE sd > 0""")
def q_drop_constant_features(spark, sf):
    df = prep(spark, sf).withColumn("loan_purpose_is_home", (F.col("loan_purpose") != "").cast("int"))
    return frames.nonconstant_features(df, CONST_CANDIDATES + ["loan_purpose_is_home"], ["institution"])


@register("one_hot_drop_first", section="P", sql=cte(p=V.prep()) + """
SELECT institution, count(*) AS n,
       CAST(sum(CASE WHEN occupancy_type = 2 THEN 1 ELSE 0 END) AS BIGINT) AS occupancy_type_2,
       CAST(sum(CASE WHEN occupancy_type = 3 THEN 1 ELSE 0 END) AS BIGINT) AS occupancy_type_3
FROM p GROUP BY 1""")
def q_one_hot_drop_first(spark, sf):
    df = prep(spark, sf)
    enc, names = frames.one_hot_drop_first(df, "occupancy_type")
    return enc.groupBy("institution").agg(_cnt(), *[F.sum(n).cast("long").alias(n) for n in names])


@register("interaction_terms", section="P", sql=cte(p=V.prep()) + """
SELECT institution, round(sum(is_black * log_loan_amount), 4) AS black_x_size,
       CAST(sum(is_black * purpose_refi) AS BIGINT) AS black_x_refi,
       round(sum(is_black * purpose_refi * log_income), 4) AS black_x_refi_x_income FROM p GROUP BY 1""")
def q_interaction_terms(spark, sf):
    df = frames.interactions(prep(spark, sf), [("is_black", "log_loan_amount"), ("is_black", "purpose_refi"),
                                               ("is_black", "purpose_refi", "log_income")])
    return df.groupBy("institution").agg(
        F.round(F.sum("is_black_x_log_loan_amount"), 4).alias("black_x_size"),
        F.sum("is_black_x_purpose_refi").cast("long").alias("black_x_refi"),
        F.round(F.sum("is_black_x_purpose_refi_x_log_income"), 4).alias("black_x_refi_x_income"))


@register("null_to_json", section="P", sql="""
SELECT r_regionkey AS id, CAST(to_json({'region': r_name, 'key': r_regionkey, 'missing': CAST(NULL AS INTEGER)}) AS VARCHAR) AS payload
FROM region""")
def q_null_to_json(spark, sf):
    r = C.read(spark, sf, "region", "r_regionkey", "r_name")
    return r.select(F.col("r_regionkey").alias("id"), frames.to_json_nulls(
        F.struct(F.col("r_name").alias("region"), F.col("r_regionkey").alias("key"),
                 F.lit(None).cast("int").alias("missing"))).alias("payload"))
