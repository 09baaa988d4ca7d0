"""The conformed views written once more in plain ANSI SQL (DuckDB dialect).

These are the independent oracle side of ``lodestar.sources.conform``; a query
oracle composes them as CTEs: ``WITH f1 AS (<F1>) SELECT ... FROM f1``.
"""


def quarter_end(ts: str) -> str:
    return f"CAST(last_day(date_trunc('quarter', {ts}) + INTERVAL 2 MONTH) AS DATE)"


def quarter_start(ts: str) -> str:
    return f"CAST(date_trunc('quarter', {ts}) AS DATE)"


def _denials() -> str:
    return ",\n".join(
        f"CASE WHEN (l_partkey + {k} * l_suppkey) % 11 = 0 THEN NULL "
        f"ELSE CAST((l_partkey + {k} * l_suppkey) % 11 AS VARCHAR) END AS denial_reason_{k}"
        for k in range(1, 5))


F1 = f"""
SELECT l_orderkey AS order_id,
       r_name AS institution,
       n_name AS state_code,
       CAST(c_custkey % 200 AS VARCHAR) AS county_code,
       CAST(year(o_orderdate) AS INTEGER) AS activity_year,
       CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 3 ELSE 2 END AS action_taken,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Black or African American'
                         WHEN 'MACHINERY' THEN 'Asian' ELSE 'White' END AS derived_race,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Hispanic or Latino'
                         WHEN 'FURNITURE' THEN 'Not Hispanic or Latino'
                         ELSE 'Ethnicity Not Available' END AS derived_ethnicity,
       CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS derived_sex,
       c_acctbal AS income,
       l_extendedprice AS loan_amount,
       CASE l_linenumber WHEN 1 THEN '1' WHEN 2 THEN '31' WHEN 3 THEN '32' ELSE '2' END AS loan_purpose,
       CASE WHEN l_quantity < 20 THEN '<20%' WHEN l_quantity < 30 THEN '20%-<30%'
            WHEN l_quantity < 36 THEN '30%-<36%'
            WHEN l_quantity < 50 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
            ELSE '50%-60%' END AS debt_to_income_ratio,
       NULLIF(l_discount * 1000, 0) AS combined_loan_to_value_ratio,
       CAST(l_partkey % 4 + 1 AS INTEGER) AS loan_type,
       CAST(l_suppkey % 7 + 1 AS INTEGER) AS aus_1,
       CAST(l_orderkey % 3 + 1 AS INTEGER) AS occupancy_type,
       CASE WHEN l_linenumber % 2 = 0 THEN 360.0 ELSE 180.0 END AS loan_term,
       CASE WHEN l_orderkey % 9 = 0 THEN 2 ELSE 1 END AS lien_status,
       CASE WHEN l_partkey % 13 = 0 THEN 2 ELSE 1 END AS construction_method,
       CASE WHEN l_suppkey % 5 = 0 THEN 'NC' ELSE 'C' END AS conforming_loan_limit,
       {_denials()}
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
"""


def dti_sql(c: str, variant: str = "A") -> str:
    strip_all = f"trim(replace(replace(replace({c}, '%', ''), '<', ''), '>', ''))"
    ranged_src = strip_all if variant.upper() == "B" else f"replace({c}, '%', '')"
    parts = f"string_split({ranged_src}, '-')"
    return (f"CASE WHEN {c} IS NULL THEN NULL "
            f"WHEN strpos({ranged_src}, '-') > 0 THEN "
            f"CASE WHEN len({parts}) = 2 THEN (TRY_CAST({parts}[1] AS DOUBLE) + TRY_CAST({parts}[2] AS DOUBLE)) / 2 END "
            f"ELSE TRY_CAST({strip_all} AS DOUBLE) END")


def log1p0(c: str) -> str:
    return f"ln(1 + CASE WHEN {c} < 0 THEN 0 ELSE {c} END)"


def prep(dti_variant: str = "A", hispanic_mode: str = "contains") -> str:
    hisp = ("strpos(derived_ethnicity, 'Hispanic') > 0" if hispanic_mode == "contains"
            else "derived_ethnicity = 'Hispanic or Latino'")
    return f"""
SELECT *,
       CAST(action_taken = 1 AS INTEGER) AS approved,
       CAST(action_taken = 3 AS INTEGER) AS denied,
       {dti_sql('debt_to_income_ratio', dti_variant)} AS dti_mid,
       {log1p0('income')} AS log_income,
       {log1p0('loan_amount')} AS log_loan_amount,
       CAST(coalesce(derived_race = 'Black or African American', false) AS INTEGER) AS is_black,
       CAST(coalesce(derived_race = 'White', false) AS INTEGER) AS is_white,
       CAST(coalesce(derived_race = 'Asian', false) AS INTEGER) AS is_asian,
       CAST(coalesce({hisp}, false) AS INTEGER) AS is_hispanic,
       CAST(coalesce(loan_purpose = '1', false) AS INTEGER) AS purpose_purchase,
       CAST(coalesce(loan_purpose = '31', false) AS INTEGER) AS purpose_refi,
       CAST(coalesce(loan_purpose = '32', false) AS INTEGER) AS purpose_cashout
FROM ({F1}) a
WHERE action_taken IN (1, 3)
"""


F2 = f"""
SELECT a.*, n_name AS STNAME, s_name AS INSTNAME, s_name AS CITY FROM (
  SELECT CERT, REPDTE, ASSET, DEP, LNLSNET, INTINC, EINTEXP, RBCT1J, NCLNLS, LNRE,
         INTINC - EINTEXP AS NETINC, INTINC * 3 AS EQ, EINTEXP * 3 AS LNLSNTV
  FROM (
    SELECT l_suppkey AS CERT, {quarter_end('l_shipdate')} AS REPDTE,
           sum(l_extendedprice) AS ASSET,
           sum(l_extendedprice * (1 - l_discount)) AS DEP,
           sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0.0 END) AS LNLSNET,
           sum(l_extendedprice * l_discount) AS INTINC,
           sum(l_extendedprice * l_tax) AS EINTEXP,
           sum(l_extendedprice * 0.1) AS RBCT1J,
           sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * l_quantity / 50 ELSE 0.0 END) AS NCLNLS,
           sum(CASE WHEN l_partkey % 2 = 0 THEN l_extendedprice ELSE 0.0 END) AS LNRE
    FROM lineitem GROUP BY 1, 2) g) a
LEFT JOIN supplier ON a.CERT = s_suppkey
LEFT JOIN nation ON s_nationkey = n_nationkey
"""


F3 = """
SELECT o_orderkey AS complaint_id,
       n_name || ' ' || r_name || ' BANCORP' AS company,
       r_name AS institution,
       o_orderpriority AS product,
       o_orderdate AS date_received,
       CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS timely_response,
       n_name AS state
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

F3B = f"""
SELECT l_suppkey AS CERT, {quarter_start('l_shipdate')} AS quarter,
       count(*) AS complaint_count,
       avg(CAST(l_linestatus = 'F' AS INTEGER)) AS timely_response
FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 40
GROUP BY 1, 2
"""

F4 = """
SELECT l_orderkey AS loan_id, l_linenumber AS report_seq, l_shipdate AS report_period,
       CAST(year(l_shipdate) AS INTEGER) AS source_year,
       'SELLER ' || CAST(l_suppkey % 10 AS VARCHAR) AS seller_name,
       2.0 + l_tax * 50 AS original_rate,
       l_extendedprice AS original_upb,
       360 AS loan_term,
       strftime(l_shipdate, '%m%Y') AS first_payment_date,
       l_quantity AS original_dti,
       50.0 + l_discount * 500 AS original_ltv,
       CAST(300 + (l_partkey * 37 + l_suppkey * 11) % 551 AS INTEGER) AS fico,
       CASE l_linenumber % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'R' ELSE 'C' END AS loan_purpose,
       CAST(l_suppkey % 4 AS INTEGER) AS current_delinquency,
       l_partkey, l_suppkey, l_extendedprice, l_shipdate
FROM lineitem
"""

NARRATIVES = """
SELECT doc_id, source AS institution, lang AS product, text AS narrative FROM documents
"""
