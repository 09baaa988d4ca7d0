"""Window operators over entity-ordered panels.

All windows over the same panel share one ``partitionBy`` so Spark plans a
single exchange (hash on the entity key) and one sort for every column.
Frames are row based (the reference's lags skip calendar gaps); ``densify``
fills missing periods first when calendar semantics are wanted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.scalars import safe_ratio


def entity_window(keys: Sequence[str] | str, order: Sequence[str] | str):
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*order)


def lag_k(c: str, k: int, w) -> Column:
    return F.lag(c, k).over(w)


def lead_label(flag: str, k: int, w, variant: str = "exact") -> Column:
    """Flag ``k`` rows ahead (missing -> 0); ``variant='any'`` = max over rows 1..k."""
    if variant == "any":
        return F.coalesce(F.max(flag).over(w.rowsBetween(1, k)), F.lit(0)).cast("int")
    return F.coalesce(F.lead(flag, k).over(w), F.lit(0)).cast("int")


def pct_change_pad(c: str, w) -> Column:
    """pandas ``pct_change`` with padding: forward-fill, then x / prev - 1.

    A zero base gives +/-Infinity (0/0 gives NULL), as pandas does.
    """
    filled = F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    prev = F.lag(filled, 1).over(w)
    inf = F.lit(float("inf"))
    return (F.when(prev.isNull() | filled.isNull(), F.lit(None).cast("double"))
            .when(prev == 0, F.when(filled > 0, inf).when(filled < 0, -inf).otherwise(F.lit(None).cast("double")))
            .otherwise(filled / prev - 1))


def smoothed_growth(c: str, w, k: int = 1) -> Column:
    prev = F.lag(c, k).over(w)
    return (F.col(c) - prev) / (prev + 1)


def rolling_stats(c: str, w, n: int = 4, min_periods: int = 2, include_current: bool = True):
    """Trailing mean and sample std over ``n`` rows; NULL below ``min_periods``."""
    frame = w.rowsBetween(-(n - 1), 0) if include_current else w.rowsBetween(-n, -1)
    cnt = F.count(c).over(frame)
    mean = F.when(cnt >= min_periods, F.avg(c).over(frame))
    std = F.when(cnt >= min_periods, F.stddev_samp(c).over(frame))
    return mean, std


def velocity_zscore(df: DataFrame, value: str, keys: Sequence[str], order: str, n: int = 4,
                    min_periods: int = 2, include_current: bool = True, threshold: float = 2.0) -> DataFrame:
    w = entity_window(keys, order)
    mean, std = rolling_stats(value, w, n, min_periods, include_current)
    out = df.select("*", mean.alias("rolling_mean"), std.alias("rolling_std"))
    z = (F.col(value) - F.col("rolling_mean")) / F.nullif(F.col("rolling_std"), F.lit(0.0))
    return out.select("*", z.alias("z_score")).select(
        "*", F.coalesce((F.col("z_score") > threshold).cast("int"), F.lit(0)).alias("rising_flag"))


def within_demean(df: DataFrame, cols: Sequence[str], group: Sequence[str] | str, suffix: str = "_dm") -> DataFrame:
    """Subtract group means (fixed-effect absorption).

    Means come from a partial-aggregated ``groupBy`` joined back on the key, so
    a hot group (say a third of all rows) is never pulled into one window task.
    """
    g = [group] if isinstance(group, str) else list(group)
    means = df.groupBy(*g).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    out = df.join(means, g, "left")
    return out.select(*df.columns, *[(F.col(c) - F.col(f"_m_{c}")).alias(c + suffix) for c in cols])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Earliest row per key under a total order (ascending, NULLs first, like
    ``row_number() = 1``).

    Written as ``min(struct(order..., row))`` per key: a partial aggregation, so a
    hot key (even a third of all rows) is reduced inside every map task before
    the shuffle instead of being sorted in a single window task."""
    order = list(order)
    payload = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                      F.struct(*[F.col(c) for c in payload]).alias("_row"))
    agg = df.groupBy(*keys).agg(F.min(packed).alias("_m"))
    return agg.select(*keys, "_m._row.*").select(*df.columns)


def latest_period(df: DataFrame, date_col: str) -> DataFrame:
    """Rows at the global max date: a scalar subquery (partial max per task), no global sort."""
    return df.where(F.col(date_col) == df.select(F.max(date_col)).scalar())


def share_of_total(df: DataFrame, c: str, partition: Sequence[str] = (), name: str = "share") -> DataFrame:
    """part / total * 100. The grand total is a scalar subquery, never a
    single-partition window; per-group totals use a keyed window."""
    if not partition:
        total = df.select(F.sum(c)).scalar()
        return df.select("*", safe_ratio(F.col(c), total, 100.0).alias(name))
    totals = df.groupBy(*partition).agg(F.sum(c).alias("_total"))
    return (df.join(totals, list(partition), "left")
            .select(*df.columns, safe_ratio(F.col(c), F.col("_total"), 100.0).alias(name)))


def densify(df: DataFrame, key: str, period: str, step_months: int = 3) -> DataFrame:
    """Insert missing periods per key (calendar lags). Uses per-key sequence()."""
    bounds = df.groupBy(key).agg(F.min(period).alias("_lo"), F.max(period).alias("_hi"))
    grid = bounds.select(key, F.explode(F.expr(
        f"sequence(_lo, _hi, interval {step_months} month)")).alias(period))
    return grid.join(df, [key, period], "left")
