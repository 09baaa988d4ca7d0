"""Physical-plan properties the scale design relies on."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_and_pushes_filters(spark):
    plan = _plan(E.queries()["scan_parquet"](spark, SF))
    assert "PushedFilters: [IsNotNull(l_shipdate), IsNotNull(l_quantity), LessThan(l_shipdate" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double,l_shipdate:timestamp_ntz>" in plan


def test_first_per_key_aggregates_map_side(spark):
    plan = _plan(E.queries()["first_per_key"](spark, SF))
    assert "partial_min" in plan and "row_number" not in plan


def test_no_single_partition_exchange_in_headline_queries(spark):
    q = E.queries()
    for k in ["bank_feature_panel", "complaint_panel", "velocity_zscore", "keyword_topk", "exact_quantiles",
              "qcut_bucket", "value_share", "within_demean", "first_per_key", "did_panel"]:
        plan = _plan(q[k](spark, SF))
        assert "SinglePartition" not in plan, k


def test_window_panels_partition_on_entity(spark):
    plan = _plan(E.queries()["bank_feature_panel"](spark, SF))
    # one window exchange on the entity key over the aggregated panel
    assert plan.count("Exchange hashpartitioning(CERT") == 1


def test_pivots_take_the_levels_that_the_data_holds(spark, tmp_path):
    """Also levels that the oracle's list does not name."""
    import shutil
    from pyspark.sql import functions as F
    from lodestar.plans import registry
    registry.load_all()
    for t in ("lineitem", "customer", "nation", "region"):
        shutil.copy(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    o = spark.read.parquet(f"{SF}/orders.parquet")
    o.withColumn("o_orderdate", F.expr("o_orderdate + make_interval(40)").cast(o.schema["o_orderdate"].dataType)).write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{SF}/events.parquet").withColumn("event_type", F.concat("event_type", F.lit("_x"))).write.parquet(f"{tmp_path}/events.parquet")
    years = [int(c) for c in registry.QUERIES["pivot_counts"](spark, str(tmp_path)).columns if c != "institution"]
    assert years and min(years) > 2030
    assert all(c == "period" or c.endswith("_x") for c in registry.QUERIES["resample_quarter_mean"](spark, str(tmp_path)).columns)
