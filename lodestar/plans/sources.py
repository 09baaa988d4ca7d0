"""Source / sink queries and the remaining key joins. Intermediate files are
derived by Spark from the given tables and written under the shared
checkpoint folder (``spark.checkpoint.dir``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import frames
from lodestar.operators import joins as J
from lodestar.operators import windows as W
from lodestar.plans import sqlviews as V
from lodestar.plans.common import cte, rounded
from lodestar.plans.registry import register
from lodestar.plans.scalars import apps, prep
from lodestar.session import prepare, scratch_path
from lodestar.sources import conform as C
from lodestar.sources import files as FS
from lodestar.sources import zipped
from lodestar.sources.tables import read, table_path


@register("scan_parquet", section="S", sql="""
SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity > 45""")
def q_scan_parquet(spark, sf):
    """Pruned, filtered scan: ReadSchema has 4 columns and the predicates are pushed to parquet."""
    prepare(spark)
    df = spark.read.parquet(table_path(sf, "lineitem"))
    return df.where((F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") > 45)) \
        .select("l_orderkey", "l_extendedprice")


ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@register("scan_csv_pruned", section="S", sql="""
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders""")
def q_scan_csv_pruned(spark, sf):
    path = scratch_path(spark, "orders_csv")
    read(spark, sf, "orders", *ORDER_COLS).write.mode("overwrite").csv(path, header=True)
    return FS.read_csv_strings(spark, path, ORDER_COLS, ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@register("scan_csv_zipped", section="S", sql="""
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders""")
def q_scan_csv_zipped(spark, sf):
    """Zipped CSV landings of the orders, a member a partition, read without their other columns."""
    prepare(spark)
    path = zipped.write_csv_zipped(read(spark, sf, "orders", *ORDER_COLS), scratch_path(spark, "orders_zip"))
    return zipped.read_csv_zipped(spark, path, ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@register("scan_csv_positional", section="S", sql="""
SELECT CAST(l_orderkey AS VARCHAR) AS loan_id, l_returnflag AS flag, CAST(l_linenumber AS VARCHAR) AS seq FROM lineitem""")
def q_scan_csv_positional(spark, sf):
    path = scratch_path(spark, "lineitem_pipe")
    li = read(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    li.write.mode("overwrite").csv(path, sep="|", header=False)
    return FS.read_csv_positional(spark, path, 5, {0: "loan_id", 4: "flag", 3: "seq"})


@register("scan_json_envelope", section="S", sql="""
SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL""")
def q_scan_json_envelope(spark, sf):
    """Event payloads landed as paged JSON envelopes, then exploded back to records."""
    path = scratch_path(spark, "events_pages")
    e = read(spark, sf, "events", "event_id", "event_type", "props")
    rec = e.select(F.struct("event_id", "event_type", F.from_json("props", "k int")["k"].alias("k")).alias("data"))
    # fixed-size pages (1,000 records), so a page never grows with the data
    pages = rec.groupBy(F.floor(F.col("data.event_id") / 1000).alias("page")) \
        .agg(F.collect_list(F.struct("data")).alias("data"))
    pages.select("data").write.mode("overwrite").json(path)
    recs = FS.read_json_envelope(spark, path, "event_id: bigint, event_type: string, k: int")
    return recs.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


EXPECTED_YEARS = list(range(1992, 2003))


@register("scan_multi_file_lineage", section="S", sql="""
WITH c AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS source_year, count(*) AS n FROM lineitem GROUP BY 1)
SELECT CAST(coalesce(x.y, c.source_year) AS INTEGER) AS source_year, coalesce(c.n, 0) AS n, CAST(c.n IS NULL AS INTEGER) AS missing,
       CAST(x.y IS NULL AS INTEGER) AS unexpected
FROM (SELECT unnest(range(1992, 2003)) AS y) x FULL JOIN c ON c.source_year = x.y""")
def q_scan_multi_file_lineage(spark, sf):
    """Union of per-year files tagged with their source path; expected years with no
    file are reported as missing, files of other years as unexpected."""
    path = scratch_path(spark, "lineitem_by_year")
    li = read(spark, sf, "lineitem", "l_orderkey", "l_shipdate").withColumn("year", F.year("l_shipdate"))
    FS.write_parquet(li, path, partition_by=["year"])  # one file set per source year, one job
    tagged = spark.read.parquet(f"{path}/year=*").select(
        F.regexp_extract(F.col("_metadata.file_path"), r"year=(\d+)", 1).cast("int").alias("source_year"))
    counts = tagged.groupBy("source_year").agg(F.count(F.lit(1)).alias("n"))
    return with_expected_years(counts, EXPECTED_YEARS)


def with_expected_years(counts, years):
    """Counts per source year, completed by expected years without files and flags for both kinds of surprise."""
    expected = counts.sparkSession.createDataFrame([(y, True) for y in years], "source_year int, expected boolean")
    return expected.join(counts, "source_year", "full_outer").select(
        "source_year", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().cast("int").alias("missing"),
        F.col("expected").isNull().cast("int").alias("unexpected"))


ALIASES = {"MIDDLE EAST": "EUROPE"}


@register("scan_year_tagged", section="S", sql=cte(f1=V.F1) + """
SELECT CASE WHEN institution = 'MIDDLE EAST' THEN 'EUROPE' ELSE institution END AS institution, activity_year,
       count(*) AS n FROM f1 GROUP BY ALL""")
def q_scan_year_tagged(spark, sf):
    """Per-source rows tagged with institution / year; predecessors remapped to the successor."""
    df = apps(spark, sf)
    alias = frames.lookup_table(spark, ALIASES, "pred", "succ")
    j = df.join(F.broadcast(alias), df.institution == alias.pred, "left")
    return j.select(F.coalesce("succ", "institution").alias("institution"), "activity_year") \
        .groupBy("institution", "activity_year").agg(F.count(F.lit(1)).alias("n"))


@register("chunked_first_seen", section="S", sql=cte(f4=V.F4) + """
SELECT loan_id, fico, CAST(source_year AS INTEGER) AS source_year FROM (
  SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY source_year, report_seq, report_period, l_partkey,
                               l_suppkey, original_upb) AS rn FROM f4) WHERE rn = 1""")
def q_chunked_first_seen(spark, sf):
    """Keep the first row per loan in source order (the batch twin of the streaming dedup)."""
    lm = C.loan_months(spark, sf)
    first = W.first_per_key(lm, ["loan_id"], ["source_year", "report_seq", "report_period", "l_partkey",
                                              "l_suppkey", "original_upb"])
    return first.select("loan_id", "fico", "source_year")


@register("sink_parquet", section="S", sql=cte(f3=V.F3) + """
SELECT institution, product, count(*) AS n FROM f3 GROUP BY ALL""")
def q_sink_parquet(spark, sf):
    agg = C.complaints(spark, sf).groupBy("institution", "product").agg(F.count(F.lit(1)).alias("n"))
    path = FS.write_parquet(agg, scratch_path(spark, "complaint_counts"), partition_by=["institution"])
    return spark.read.parquet(path).select("institution", "product", "n")


@register("sink_if_absent", section="S", sql=cte(f3=V.F3) + """
SELECT institution, count(*) AS n FROM f3 GROUP BY 1""")
def q_sink_if_absent(spark, sf):
    agg = C.complaints(spark, sf).groupBy("institution").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "inst_counts")
    FS.write_if_absent(agg, path)
    FS.write_if_absent(agg.limit(0), path)  # second write is skipped: output exists
    return spark.read.parquet(path)


LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus", "l_shipdate"]


def _profile_text(c: str) -> str:
    return f"CAST(round({c} * 10000) AS BIGINT)" if c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") else \
        f"strftime({c}, '%Y-%m-%d')" if c == "l_shipdate" else c


@register("profile_columns", section="S", sql="""
SELECT column_name, count(value) AS n_nonnull, count(DISTINCT value) AS n_distinct, min(value) AS min_value,
       max(value) AS max_value, round(avg(CAST(TRY_CAST(value AS DOUBLE) IS NOT NULL AS INTEGER)), 6) AS numeric_share
FROM (UNPIVOT (SELECT """ + ", ".join(f"CAST({_profile_text(c)} AS VARCHAR) AS {c}" for c in LINEITEM)
          + " FROM lineitem) ON " + ", ".join(LINEITEM) + " INTO NAME column_name VALUE value) GROUP BY 1")
def q_profile_columns(spark, sf):
    """Every column of the table: counts, range, share of numeric values. Amounts are profiled
    in units of 1/10000, dates as days, so that both engines print them alike."""
    li = profiled_lineitem(spark, sf)
    return rounded(profile(li).select("column_name", "n_nonnull", "n_distinct", "min_value", "max_value", "numeric_share"))


def profiled_lineitem(spark, sf):
    li = read(spark, sf, "lineitem", *LINEITEM)
    amounts = {c: F.round(F.col(c) * 10000).cast("long") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}
    return li.withColumns(amounts | {"l_shipdate": F.date_format("l_shipdate", "yyyy-MM-dd")})


def profile(df):
    """One row per column: type, non-null and distinct counts, range and numeric share."""
    types = dict(df.dtypes)
    long = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "column_name", "value")
    # one row per (column, value) first: distinct counts and samples then need no set of values in a task
    v = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("c"))
    number = F.col("value").try_cast("double").isNotNull()
    kind = F.create_map(*[F.lit(x) for c in df.columns for x in (c, types[c])])
    one = v.groupBy("column_name").agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("c")).otherwise(0)).alias("n_nonnull"),
        F.count("value").alias("n_distinct"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        (F.sum(F.when(number, F.col("c")).otherwise(0)) / F.sum(F.when(F.col("value").isNotNull(), F.col("c")))).alias("numeric_share"))
    return one.withColumn("dtype", kind[F.col("column_name")])


RULES = [("fico", 600, 850), ("original_dti", 10, 65), ("original_upb", 50_000, 3_000_000)]


@register("validate_ranges", section="S", sql=cte(f4=V.F4) + " UNION ALL ".join(
    f"SELECT '{f}' AS field, round(avg(CAST(TRY_CAST({f} AS DOUBLE) BETWEEN {lo} AND {hi} AS INTEGER)) * 100, 6) AS pct_valid, "
    f"count(TRY_CAST({f} AS DOUBLE)) AS n_numeric FROM f4" for f, lo, hi in RULES))
def q_validate_ranges(spark, sf):
    """Share of numeric-parsable values within [lo, hi] per field over the whole table."""
    lm = C.loan_months(spark, sf)
    v = {f: F.col(f).cast("string").try_cast("double") for f, _, _ in RULES}
    # all rules in one aggregation, then one row per field
    one = lm.agg(*[F.struct(F.lit(f).alias("field"),
                            F.round(F.avg(v[f].between(lo, hi).cast("int")) * 100, 6).alias("pct_valid"),
                            F.count(v[f]).alias("n_numeric")).alias(f) for f, lo, hi in RULES])
    return one.select(F.explode(F.array(*[F.col(f) for f, _, _ in RULES])).alias("r")).select("r.*")


@register("model_sink", section="S")
def q_model_sink(spark, sf):
    """Persist a coefficient table (the model artefact) and read it back."""
    from lodestar.operators import glm
    fit = glm.logit(prep(spark, sf), "approved", ["is_black", "log_income"], by=["institution"])
    path = FS.write_parquet(fit, scratch_path(spark, "model_coefficients"))
    return spark.read.parquet(path)


# ---------------------------------------------------------------- joins

@register("join_inner_key", section="J", sql="WITH p AS (" + V.prep() + """)
, g AS (SELECT institution, avg(CASE WHEN is_black = 0 THEN approved END) - avg(CASE WHEN is_black = 1 THEN approved END) AS gap FROM p GROUP BY 1)
, n AS (SELECT institution, count(*) AS n FROM p GROUP BY 1)
SELECT g.institution, round(gap, 6) AS gap, n FROM g JOIN n ON g.institution = n.institution""")
def q_join_inner_key(spark, sf):
    df = prep(spark, sf)
    g = df.groupBy("institution").agg((F.avg(F.when(F.col("is_black") == 0, F.col("approved")))
                                       - F.avg(F.when(F.col("is_black") == 1, F.col("approved")))).alias("gap"))
    n = df.groupBy("institution").agg(F.count(F.lit(1)).alias("n"))
    return rounded(g.join(n, "institution", "inner"))


@register("semi_join_keys", section="J", sql=cte(s=V.F3B) + """
SELECT CERT, count(*) AS n_quarters FROM s WHERE CERT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
GROUP BY 1""")
def q_semi_join_keys(spark, sf):
    s = C.sparse_complaints(spark, sf)
    keys = read(spark, sf, "supplier", "s_suppkey", "s_acctbal").where("s_acctbal > 0") \
        .select(F.col("s_suppkey").alias("CERT"))
    return s.join(keys, "CERT", "left_semi").groupBy("CERT").agg(F.count(F.lit(1)).alias("n_quarters"))


@register("anti_join_seen", section="J", sql=cte(f4=V.F4) + """
SELECT source_year, count(DISTINCT loan_id) AS new_loans FROM f4 a
WHERE NOT EXISTS (SELECT 1 FROM f4 b WHERE b.loan_id = a.loan_id AND b.source_year < a.source_year)
GROUP BY 1""")
def q_anti_join_seen(spark, sf):
    """Loans first seen in each source year: rows whose key appears in no earlier year."""
    lm = C.loan_months(spark, sf).select("loan_id", "source_year")
    # a key is new in its first year and in no other: the anti-join is a minimum per key
    first_year = lm.groupBy("loan_id").agg(F.min("source_year").alias("source_year"))
    return first_year.groupBy("source_year").agg(F.count(F.lit(1)).alias("new_loans"))


@register("rare_level_collapse", section="J", sql="WITH p AS (" + V.prep() + """)
, c AS (SELECT county_code, count(*) AS n FROM p WHERE county_code IS NOT NULL GROUP BY 1)
SELECT CASE WHEN c.n >= 300 THEN p.county_code ELSE 'other' END AS county, count(*) AS n
FROM p LEFT JOIN c ON p.county_code = c.county_code GROUP BY 1""")
def q_rare_level_collapse(spark, sf):
    d = J.rare_level_collapse(prep(spark, sf), "county_code", 300, out="county")
    return d.groupBy("county").agg(F.count(F.lit(1)).alias("n"))


@register("dim_lookup_default", section="J", sql="""
WITH s AS (SELECT DISTINCT l_suppkey AS CERT FROM lineitem UNION SELECT DISTINCT -1 - l_suppkey FROM lineitem)
, d AS (SELECT s_suppkey AS CERT, s_name AS NAME, n_name AS STALP,
               row_number() OVER (PARTITION BY s_suppkey ORDER BY s_name) AS rn
        FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s.CERT, coalesce(d.NAME, 'Unknown') AS NAME, coalesce(d.STALP, '') AS STALP
FROM s LEFT JOIN (SELECT * FROM d WHERE rn = 1) d ON s.CERT = d.CERT""")
def q_dim_lookup_default(spark, sf):
    keys = read(spark, sf, "lineitem", "l_suppkey").distinct()
    # negative keys are in no dimension, so they fall back to defaults
    s = keys.select(F.explode(F.array(F.col("l_suppkey"), -1 - F.col("l_suppkey"))).alias("CERT"))
    sup = read(spark, sf, "supplier", "s_suppkey", "s_name", "s_nationkey")
    n = read(spark, sf, "nation", "n_nationkey", "n_name")
    dim = sup.join(F.broadcast(n), sup.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("CERT"), F.col("s_name").alias("NAME"), F.col("n_name").alias("STALP"))
    return J.dim_lookup_default(s, dim, "CERT", ["NAME"], {"NAME": "Unknown", "STALP": ""})
