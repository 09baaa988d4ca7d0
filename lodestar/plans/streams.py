"""Streaming-twin queries (file stream over the given tables)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestar.plans.common import rounded
from lodestar.plans.registry import register
from lodestar.streaming import twins, velocity
from lodestar.session import prepare
from lodestar.sources.tables import table_path


def _glob(sf, name):  # noqa: D103
    p = table_path(sf, name)
    return p[:-len(".parquet")] + "*.parquet"


@register("stream_first_seen", section="X", sql="""
SELECT count(DISTINCT l_orderkey) AS n_loans FROM lineitem""")
def q_stream_first_seen(spark, sf):
    prepare(spark)
    schema = spark.read.parquet(table_path(sf, "lineitem")).schema
    out = twins.stream_first_seen(spark, _glob(sf, "lineitem"), schema, "l_orderkey", name=f"first_seen_{uuid.uuid4().hex[:8]}")
    return out.agg(F.count(F.lit(1)).alias("n_loans"))


@register("stream_group_count", section="X", sql="""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def q_stream_group_count(spark, sf):
    prepare(spark)
    schema = spark.read.parquet(table_path(sf, "events")).schema
    out = twins.stream_period_counts(spark, _glob(sf, "events"), schema, "ts", ["event_type"],
                                     name=f"period_counts_{uuid.uuid4().hex[:8]}")
    return rounded(out.select(F.col("window.start").cast("date").alias("day"), "event_type", "n"))


@register("stream_velocity", section="X", sql="""
WITH g AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL)
, r AS (SELECT *, CASE WHEN count(n) OVER w >= 2 THEN avg(n) OVER w END AS rolling_mean,
                  CASE WHEN count(n) OVER w >= 2 THEN stddev_samp(n) OVER w END AS rolling_std
        FROM g WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
, z AS (SELECT *, (n - rolling_mean) / NULLIF(rolling_std, 0) AS z_score FROM r)
SELECT CAST(day AS VARCHAR) AS day, event_type, n, round(rolling_mean, 6) AS rolling_mean,
       round(rolling_std, 6) AS rolling_std, round(z_score, 6) AS z_score,
       CAST(coalesce(z_score > 2.0, false) AS INTEGER) AS rising_flag FROM z""")
def q_stream_velocity(spark, sf):
    """Daily counts whose rolling z-score a stateful processor gives as each day closes."""
    prepare(spark)
    schema = spark.read.parquet(table_path(sf, "events")).schema
    out = velocity.stream_velocity(spark, _glob(sf, "events"), schema, "ts", ["event_type"])
    return rounded(out.select(F.col("start").cast("date").alias("day"), "event_type", "n", "rolling_mean", "rolling_std", "z_score", "rising_flag"))
