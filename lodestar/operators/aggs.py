"""Aggregation operators: grouped profiles, shares, quantiles, pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.scalars import safe_ratio


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill NULLs with the column's exact median over ``df`` (distributed exact quantile;
    one number per column comes back to the driver)."""
    from lodestar.operators.quantiles import exact_quantiles
    fills = {c: exact_quantiles(df, c, [0.5]).first()["value"] for c in cols}
    return df.select(*[F.coalesce(F.col(c), F.lit(fills[c])).alias(c) if c in fills else F.col(c)
                       for c in df.columns])


def value_share(df: DataFrame, by: Sequence[str], value: str, name: str = "pct") -> DataFrame:
    """Share (%) of each ``value`` within its ``by`` group; counts partial-aggregate first."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    if not by:
        total = counts.select(F.sum("n")).scalar()
        return counts.select(value, "n", safe_ratio(F.col("n"), total, 100.0).alias(name))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_tot"))
    j = counts.join(totals, list(by), "left")
    return j.select(*by, value, "n", safe_ratio(F.col("n"), F.col("_tot"), 100.0).alias(name))


def conditional_rate(cond: Column) -> Column:
    return F.avg(F.coalesce(cond.cast("int"), F.lit(0)))


def top_levels(df: DataFrame, c: str, n: int) -> DataFrame:
    """The n most frequent levels (ties by level) as a small frame."""
    return (df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
            .orderBy(F.col("_n").desc(), F.col(c)).limit(n).select(c))


def describe(df: DataFrame, by: Sequence[str], c: str) -> DataFrame:
    """count / mean / std / min / quartiles / max per group (pandas ``describe``)."""
    from lodestar.operators.quantiles import with_quantiles
    agg = df.groupBy(*by).agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                              F.min(c).alias("min"), F.max(c).alias("max"))
    return with_quantiles(agg, df, by, [(c, 0.25, "q25"), (c, 0.5, "q50"), (c, 0.75, "q75")])


def resample_mean_wide(long: DataFrame, series: str, date: str, value: str, period: str = "quarter",
                       names: Sequence[str] | None = None) -> DataFrame:
    """Mixed-frequency long series -> one row per period, one mean column per series
    (every series of the data, or ``names``)."""
    if period == "quarter":
        key = F.last_day(F.add_months(F.date_trunc("quarter", F.col(date)).cast("date"), 2))
    else:
        key = F.col(date).cast("date")
    return long.groupBy(key.alias("period")).pivot(series, list(names) if names else None).agg(F.avg(value))


def missingness(df: DataFrame, by: Sequence[str], cols: dict[str, str]) -> DataFrame:
    """Null share per column (run before imputing)."""
    return df.groupBy(*by).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(n) for c, n in cols.items()])


def pre_post_breakdown(df: DataFrame, by: str, date_col: str, cut: str) -> DataFrame:
    """Per-category pre/post counts, change and share of the total change (%)."""
    is_post = F.col(date_col) >= F.lit(cut).cast("timestamp")
    c = df.groupBy(by).agg(F.sum(F.when(is_post, 0).otherwise(1)).cast("long").alias("pre"),
                           F.sum(F.when(is_post, 1).otherwise(0)).cast("long").alias("post"))
    c = c.select("*", (F.col("post") - F.col("pre")).alias("change"))
    total = c.select(F.sum("change")).scalar()
    return c.select("*", safe_ratio(F.col("change") * 100.0, total).alias("pct_of_total_change"))


def seeded_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Deterministic sample of n rows: the n smallest MD5 values of the keys and the seed."""
    h = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary"))
    return df.select("*", h.alias("_h")).orderBy("_h", *keys).limit(n).drop("_h")
