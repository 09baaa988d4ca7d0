"""Frame-shaping operators: column naming, projection, encoding, reshaping."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def normalize_name(name: str) -> str:
    return name.lower().replace(" ", "_").replace("?", "").replace("-", "_").strip()


def normalize_colnames(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalize_name(c) for c in df.columns])


def drop_dup_columns(df: DataFrame) -> DataFrame:
    """Keep the first of duplicate column names (positional rename, then select)."""
    tmp = [f"_c{i}" for i in range(len(df.columns))]
    seen, keep = set(), []
    for i, c in enumerate(df.columns):
        if c not in seen:
            seen.add(c)
            keep.append(F.col(tmp[i]).alias(c))
    return df.toDF(*tmp).select(*keep)


def select_available(df: DataFrame, wanted: Sequence[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """Project wanted columns that exist; add typed NULLs for the declared missing ones."""
    defaults = defaults or {}
    cols = []
    for c in wanted:
        if c in df.columns:
            cols.append(F.col(c))
        elif c in defaults:
            cols.append(F.lit(None).cast(defaults[c]).alias(c))
    return df.select(*cols)


def common_columns(*dfs: DataFrame) -> list[str]:
    first = dfs[0].columns
    return [c for c in first if all(c in d.columns for d in dfs[1:])]


def union_common(*dfs: DataFrame) -> DataFrame:
    """UNION ALL on the columns every input shares (first input's order)."""
    common = common_columns(*dfs)
    out = dfs[0].select(*common)
    for d in dfs[1:]:
        out = out.unionByName(d.select(*common))
    return out


def lookup_table(spark: SparkSession, mapping: dict, key: str, value: str) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in mapping.items()], f"{key} string, {value} string")


def map_with_default(df: DataFrame, lookup: DataFrame, on: str, key: str, value: str, default,
                     out: str) -> DataFrame:
    """Dictionary lookup with fallback: broadcast left join + coalesce.

    ``lookup`` is a fixed code table (bounded by its literal size), so the
    broadcast hint is safe at any data volume."""
    j = df.join(F.broadcast(lookup), df[on] == lookup[key], "left")
    return j.select(*[df[c] for c in df.columns], F.coalesce(lookup[value], F.lit(default)).alias(out))


def unpivot_nonblank(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name_col: str,
                     value_col: str) -> DataFrame:
    """Melt K columns to long rows, dropping NULL and blank values."""
    long = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        list(ids), list(cols), name_col, value_col)
    return long.where(F.col(value_col).isNotNull() & (F.trim(F.col(value_col)) != ""))


def nonconstant_features(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(group..., feature) rows for features whose sample std is > 0 in the group."""
    long = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("kv"))
    sd = long.groupBy(*by, F.col("kv.feature").alias("feature")).agg(F.stddev_samp("kv.v").alias("sd"))
    return sd.where(F.col("sd") > 0).select(*by, "feature")


def levels(df: DataFrame, c: str, max_levels: int = 10_000) -> list:
    """Distinct sorted levels of a categorical column (a small driver-side list).

    Guarded: a column with more levels than ``max_levels`` is not categorical."""
    lv = df.select(F.col(c).cast("string").alias(c)).where(F.col(c).isNotNull()).distinct()
    rows = lv.limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"{c} has more than {max_levels} levels; collapse rare levels first")
    return sorted(r[0] for r in rows)


def one_hot_drop_first(df: DataFrame, c: str, lvls: Sequence[str] | None = None, ref_level: str | None = None,
                       prefix: str | None = None):
    """Level dummies, dropping the lexicographically first (or ``ref_level``)."""
    lvls = list(lvls) if lvls is not None else levels(df, c)
    ref = ref_level if ref_level is not None else (lvls[0] if lvls else None)
    prefix = prefix or c
    names, cols = [], []
    for lv in lvls:
        if lv == ref:
            continue
        n = f"{prefix}_{re.sub(r'[^0-9A-Za-z_]', '_', str(lv))}"
        while n in names or n in df.columns:  # two levels may differ in odd characters only
            n += "_"
        names.append(n)
        cols.append(F.coalesce((F.col(c).cast("string") == F.lit(str(lv))).cast("int"), F.lit(0)).alias(n))
    return df.select("*", *cols), names


def interactions(df: DataFrame, terms: Iterable[Sequence[str]]) -> DataFrame:
    cols = []
    for t in terms:
        expr: Column = F.col(t[0])
        for x in t[1:]:
            expr = expr * F.col(x)
        cols.append(expr.alias("_x_".join(t)))
    return df.select("*", *cols)


def to_json_nulls(c: Column) -> Column:
    """Row -> JSON text with NULL fields written as null (NaN already NULL)."""
    return F.to_json(c, {"ignoreNullFields": "false"})
