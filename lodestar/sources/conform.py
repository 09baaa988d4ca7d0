"""Conformed domain views built from the driver's tables (proxies F1..F6).

The same derivations are written in SQL in ``lodestar.plans.sqlviews`` so each
query can be checked against an independent engine.

F1 applications   lineitem x orders x customer x nation x region
F2 bank panel     lineitem aggregated by supplier x quarter
F3 complaints     orders x customer x nation x region (+ documents narratives)
F3b sparse        returned, high-quantity lineitems by supplier x quarter
F4 loan-months    lineitem
F5 macro          events daily means by type
F6 names          part names and noisy copies
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import scalars as S
from lodestar.session import discard, stored
from lodestar.sources.tables import read

# ---------------------------------------------------------------- fixed values
# Category codes used by the application proxy (must equal the oracle SQL).
PROTECTED_SEGMENT = "BUILDING"          # derived_race = Black or African American
HISPANIC_SEGMENT = "AUTOMOBILE"         # derived_ethnicity = Hispanic or Latino
ASIAN_SEGMENT = "MACHINERY"             # derived_race = Asian
NOT_HISPANIC_SEGMENT = "FURNITURE"      # derived_ethnicity = Not Hispanic or Latino
TREATED_INSTITUTION = "AFRICA"
COMPLAINT_POST_CUT = "1998-05-01"


def _dims_nation_region(spark, sf):
    n = read(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = read(spark, sf, "region", "r_regionkey", "r_name")
    # nation and region are fixed-size code tables (25 and 5 rows).
    return F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).drop("n_regionkey", "r_regionkey"))


# ---------------------------------------------------------------- F1

def applications(spark: SparkSession, sf: str) -> DataFrame:
    """Mortgage-application proxy, one row per lineitem."""
    li = read(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
              "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    o = read(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    c = read(spark, sf, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nr = _dims_nation_region(spark, sf)
    df = (li.join(o, li.l_orderkey == o.o_orderkey)
          .join(c, F.col("o_custkey") == c.c_custkey)
          .join(nr, F.col("c_nationkey") == F.col("n_nationkey")))
    seg = F.col("c_mktsegment")
    q = F.col("l_quantity")
    cols = [
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
                   "l_quantity").alias("app_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("r_name").alias("institution"),
        F.col("n_name").alias("state_code"),
        (F.col("c_custkey") % 200).cast("string").alias("county_code"),
        F.year("o_orderdate").alias("activity_year"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 3).otherwise(2)
         .alias("action_taken"),
        F.when(seg == PROTECTED_SEGMENT, "Black or African American")
         .when(seg == ASIAN_SEGMENT, "Asian").otherwise("White").alias("derived_race"),
        F.when(seg == HISPANIC_SEGMENT, "Hispanic or Latino")
         .when(seg == NOT_HISPANIC_SEGMENT, "Not Hispanic or Latino")
         .otherwise("Ethnicity Not Available").alias("derived_ethnicity"),
        F.when(F.col("c_custkey") % 2 == 0, "Male").otherwise("Female").alias("derived_sex"),
        F.col("c_acctbal").alias("income"),
        F.col("l_extendedprice").alias("loan_amount"),
        F.when(F.col("l_linenumber") == 1, "1").when(F.col("l_linenumber") == 2, "31")
         .when(F.col("l_linenumber") == 3, "32").otherwise("2").alias("loan_purpose"),
        F.when(q < 20, "<20%").when(q < 30, "20%-<30%").when(q < 36, "30%-<36%")
         .when(q < 50, q.cast("int").cast("string")).otherwise("50%-60%").alias("debt_to_income_ratio"),
        F.nullif(F.col("l_discount") * 1000, F.lit(0.0)).alias("combined_loan_to_value_ratio"),
        (F.col("l_partkey") % 4 + 1).cast("int").alias("loan_type"),
        (F.col("l_suppkey") % 7 + 1).cast("int").alias("aus_1"),
        (F.col("l_orderkey") % 3 + 1).cast("int").alias("occupancy_type"),
        F.when(F.col("l_linenumber") % 2 == 0, 360.0).otherwise(180.0).alias("loan_term"),
        F.when(F.col("l_orderkey") % 9 == 0, 2).otherwise(1).alias("lien_status"),
        F.when(F.col("l_partkey") % 13 == 0, 2).otherwise(1).alias("construction_method"),
        F.when(F.col("l_suppkey") % 5 == 0, "NC").otherwise("C").alias("conforming_loan_limit"),
    ]
    for k in range(1, 5):
        code = (F.col("l_partkey") + k * F.col("l_suppkey")) % 11
        cols.append(F.when(code == 0, F.lit(None).cast("string")).otherwise(code.cast("string"))
                    .alias(f"denial_reason_{k}"))
    return df.select(*cols)


def application_features(apps: DataFrame, dti_variant: str = "A", hispanic_mode: str = "contains") -> DataFrame:
    """The shared ``prep``: decided applications, logs, DTI, group flags, purposes."""
    df = apps.where(F.col("action_taken").isin(1, 3))
    eth = F.col("derived_ethnicity")
    hisp = eth.contains("Hispanic") if hispanic_mode == "contains" else (eth == "Hispanic or Latino")
    return df.select(
        "*",
        (F.col("action_taken") == 1).cast("int").alias("approved"),
        (F.col("action_taken") == 3).cast("int").alias("denied"),
        S.dti_midpoint("debt_to_income_ratio", dti_variant).alias("dti_mid"),
        S.log1p_clip0("income").alias("log_income"),
        S.log1p_clip0("loan_amount").alias("log_loan_amount"),
        S.indicator(F.col("derived_race") == "Black or African American").alias("is_black"),
        S.indicator(F.col("derived_race") == "White").alias("is_white"),
        S.indicator(F.col("derived_race") == "Asian").alias("is_asian"),
        S.indicator(hisp).alias("is_hispanic"),
        S.indicator(F.col("loan_purpose") == "1").alias("purpose_purchase"),
        S.indicator(F.col("loan_purpose") == "31").alias("purpose_refi"),
        S.indicator(F.col("loan_purpose") == "32").alias("purpose_cashout"),
    )


#: the wide form's credit features, in its order
WIDE_FEATURES = ["log_income", "log_loan_amount", "dti_mid", "ltv", "purpose_purchase", "purpose_refi", "purpose_cashout",
                 "is_fha", "is_va", "is_usda", "is_investment", "is_second_home", "is_subordinate", "is_manufactured",
                 "is_30yr", "is_conforming", "aus_du", "aus_lp", "aus_manual", "miss_ltv", "miss_dti", "miss_income"]


def application_features_wide(apps: DataFrame) -> DataFrame:
    """``application_features`` with loan type, occupancy, lien, construction, term, conforming
    and underwriting flags; missing LTV, DTI and income are flagged, then filled with the
    exact median over all rows."""
    from lodestar.operators.quantiles import quantiles_wide
    d = application_features(apps)
    flag = lambda c, v: S.indicator(F.col(c) == v)
    d = d.withColumns({
        "ltv": F.col("combined_loan_to_value_ratio").cast("double"),
        "is_fha": flag("loan_type", 2), "is_va": flag("loan_type", 3), "is_usda": flag("loan_type", 4),
        "is_investment": flag("occupancy_type", 3), "is_second_home": flag("occupancy_type", 2),
        "is_subordinate": flag("lien_status", 2), "is_manufactured": flag("construction_method", 2),
        "is_30yr": S.indicator(F.col("loan_term").between(355, 365)),
        "is_conforming": S.indicator(F.lower("conforming_loan_limit") == "c"),
        "aus_du": flag("aus_1", 1), "aus_lp": flag("aus_1", 2), "aus_manual": S.indicator(F.col("aus_1").isin(3, 4, 5, 6, 7))})
    filled = {"ltv": "miss_ltv", "dti_mid": "miss_dti", "log_income": "miss_income"}
    d = d.withColumns({m: F.col(c).isNull().cast("int") for c, m in filled.items()})
    three = stored(d.select(*filled), "median_rows")  # the quantiles read them several times
    medians = {c: quantiles_wide(three, c, [0.5], ["m"]).first() for c in filled}  # three numbers
    discard(three)
    return d.withColumns({c: F.coalesce(F.col(c), F.lit(r["m"] if r else None).cast("double")) for c, r in medians.items()})


CREDIT_FEATURES = ["log_income", "log_loan_amount", "dti_mid", "purpose_purchase", "purpose_refi", "purpose_cashout"]
RACE_FEATURES = ["is_black", "is_hispanic", "is_asian"]


# ---------------------------------------------------------------- F2

def bank_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Bank financials proxy: one row per CERT x quarter end."""
    li = read(spark, sf, "lineitem", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount",
              "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    p, d, t = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    agg = (li.groupBy(F.col("l_suppkey").alias("CERT"), S.quarter_end("l_shipdate").alias("REPDTE"))
           .agg(F.sum(p).alias("ASSET"),
                F.sum(p * (1 - d)).alias("DEP"),
                F.sum(F.when(F.col("l_linestatus") == "O", p).otherwise(0.0)).alias("LNLSNET"),
                F.sum(p * d).alias("INTINC"),
                F.sum(p * t).alias("EINTEXP"),
                F.sum(p * 0.1).alias("RBCT1J"),
                F.sum(F.when(F.col("l_returnflag") == "R", p * F.col("l_quantity") / 50).otherwise(0.0))
                 .alias("NCLNLS"),
                F.sum(F.when(F.col("l_partkey") % 2 == 0, p).otherwise(0.0)).alias("LNRE")))
    agg = agg.select("*", (F.col("INTINC") - F.col("EINTEXP")).alias("NETINC"),
                     (F.col("INTINC") * 3).alias("EQ"), (F.col("EINTEXP") * 3).alias("LNLSNTV"))
    sup = read(spark, sf, "supplier", "s_suppkey", "s_name", "s_nationkey")
    n = read(spark, sf, "nation", "n_nationkey", "n_name")
    names = sup.join(F.broadcast(n), sup.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("CERT"), F.col("s_name").alias("INSTNAME"),
        F.col("n_name").alias("STNAME"), F.col("s_name").alias("CITY"))
    return agg.join(names, "CERT", "left")


# ---------------------------------------------------------------- F3

def complaints(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = read(spark, sf, "customer", "c_custkey", "c_nationkey")
    nr = _dims_nation_region(spark, sf)
    df = o.join(c, o.o_custkey == c.c_custkey).join(nr, F.col("c_nationkey") == F.col("n_nationkey"))
    return df.select(
        F.col("o_orderkey").alias("complaint_id"),
        F.concat(F.col("n_name"), F.lit(" "), F.col("r_name"), F.lit(" BANCORP")).alias("company"),
        F.col("r_name").alias("institution"),
        F.col("o_orderpriority").alias("product"),
        F.col("o_orderdate").alias("date_received"),
        F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No").alias("timely_response"),
        F.col("n_name").alias("state"),
    )


def narratives(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents", "doc_id", "text", "lang", "source")
    return d.select("doc_id", F.col("source").alias("institution"), F.col("lang").alias("product"),
                    F.col("text").alias("narrative"))


def sparse_complaints(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    f = li.where((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 40))
    return (f.groupBy(F.col("l_suppkey").alias("CERT"), S.quarter_start("l_shipdate").alias("quarter"))
            .agg(F.count(F.lit(1)).alias("complaint_count"),
                 F.avg((F.col("l_linestatus") == "F").cast("int")).alias("timely_response")))


# ---------------------------------------------------------------- F4

def loan_months(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
              "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    return li.select(
        F.col("l_orderkey").alias("loan_id"),
        F.col("l_linenumber").alias("report_seq"),
        F.col("l_shipdate").alias("report_period"),
        F.year("l_shipdate").alias("source_year"),
        F.concat(F.lit("SELLER "), (F.col("l_suppkey") % 10).cast("string")).alias("seller_name"),
        (F.lit(2.0) + F.col("l_tax") * 50).alias("original_rate"),
        F.col("l_extendedprice").alias("original_upb"),
        F.lit(360).alias("loan_term"),
        F.date_format("l_shipdate", "MMyyyy").alias("first_payment_date"),
        F.col("l_quantity").alias("original_dti"),
        (F.lit(50.0) + F.col("l_discount") * 500).alias("original_ltv"),
        (F.lit(300) + (F.col("l_partkey") * 37 + F.col("l_suppkey") * 11) % 551).cast("int").alias("fico"),
        F.when(F.col("l_linenumber") % 3 == 0, "P").when(F.col("l_linenumber") % 3 == 1, "R")
         .otherwise("C").alias("loan_purpose"),
        (F.col("l_suppkey") % 4).cast("int").alias("current_delinquency"),
        F.col("l_partkey"), F.col("l_suppkey"),
    )


# ---------------------------------------------------------------- F5

def macro_long(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events", "ts", "event_type", "value")
    return e.select(F.col("event_type").alias("series"), F.col("ts").cast("date").alias("date"), "value")


# ---------------------------------------------------------------- F6

def entity_names(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct part names (the 'institutions') with their id."""
    p = read(spark, sf, "part", "p_partkey", "p_name")
    return p.groupBy("p_name").agg(F.min("p_partkey").alias("cert")).select(
        "cert", F.col("p_name").alias("name"))
