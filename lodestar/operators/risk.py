"""Early-warning layer: CAMELS ratios, forward labels, splits, watchlist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import scalars as S
from lodestar.operators import windows as W

# ---------------------------------------------------------------- fixed values
FEATURES = ["texas_ratio", "nim", "cre_ratio", "tier1_leverage", "ltd_ratio", "roa", "log_asset",
            "texas_ratio_qoq", "nim_qoq", "DEP_qoq", "ASSET_qoq"]
QOQ_COLUMNS = ["texas_ratio", "nim", "DEP", "ASSET"]
DISTRESS_TEXAS = 100.0
CLIP_LO, CLIP_HI = -10.0, 10.0
TRAIN_END = "2019-12-31"
TEST_START = "2020-09-30"
# Illustrative fixed scoring coefficients (a fitted model replaces these).
FIXED_COEFS = {"texas_ratio": 0.25, "nim": -2.0, "cre_ratio": 0.5, "tier1_leverage": -3.0, "ltd_ratio": 0.2,
               "roa": -5.0, "log_asset": -0.1, "texas_ratio_qoq": 0.1, "nim_qoq": 0.0, "DEP_qoq": -0.1,
               "ASSET_qoq": -0.1}
FIXED_INTERCEPT = -3.0


def texas_ratio(texas_rule: str = "model"):
    """``model``: NULL when EQ + LNLSNTV = 0; ``api``: NULL when LNLSNTV = 0."""
    if texas_rule == "api":
        den = F.col("EQ") + F.nullif(F.col("LNLSNTV"), F.lit(0.0))
    else:
        den = F.col("EQ") + F.col("LNLSNTV")
    return S.safe_ratio(F.col("NCLNLS"), den, 100.0)


def camels_ratios(df: DataFrame, texas_rule: str = "model") -> DataFrame:
    a = F.col("ASSET")
    return df.select(
        "*",
        texas_ratio(texas_rule).alias("texas_ratio"),
        S.safe_ratio(F.col("INTINC") - F.col("EINTEXP"), a).alias("nim"),
        S.safe_ratio(F.col("LNRE"), a).alias("cre_ratio"),
        S.safe_ratio(F.col("RBCT1J"), a).alias("tier1_leverage"),
        S.safe_ratio(F.col("LNLSNET"), F.col("DEP")).alias("ltd_ratio"),
        S.safe_ratio(F.col("NETINC"), a).alias("roa"),
        F.log1p(a).alias("log_asset"),
    )


def bank_features(panel: DataFrame, texas_rule: str = "model", label_variant: str = "exact",
                  horizon: int = 4) -> DataFrame:
    """Ratios + padded q-o-q changes + forward distress label.

    One window spec (partition CERT, order REPDTE) serves every column, so the
    plan has exactly one exchange on CERT and one sort.
    """
    w = W.entity_window("CERT", "REPDTE")
    df = camels_ratios(panel, texas_rule)
    df = df.select("*", *[W.pct_change_pad(c, w).alias(f"{c}_qoq") for c in QOQ_COLUMNS],
                   S.indicator(F.col("texas_ratio") > DISTRESS_TEXAS).alias("distressed_now"))
    return df.select("*", W.lead_label("distressed_now", horizon, w, label_variant).alias("label"))


def complete_clipped(df: DataFrame, features: Sequence[str] = FEATURES, lo=CLIP_LO, hi=CLIP_HI) -> DataFrame:
    """Complete cases over ``features`` then clip them to [lo, hi]."""
    sub = df.dropna(subset=list(features))
    return sub.select(*[S.clip(c, lo, hi).alias(c) if c in features else F.col(c) for c in sub.columns])


def temporal_split(df: DataFrame, date_col: str = "REPDTE", train_end: str = TRAIN_END,
                   test_start: str = TEST_START):
    train = df.where(F.col(date_col) <= F.lit(train_end).cast("date"))
    test = df.where(F.col(date_col) >= F.lit(test_start).cast("date"))
    return train, test


def clipped_score(coefs, intercept: float, lo=CLIP_LO, hi=CLIP_HI):
    """sigmoid(b0 + sum(b * clip(x))) as one codegen'd expression."""
    z = F.lit(float(intercept))
    for c, b in coefs.items():
        z = z + F.lit(float(b)) * S.clip(c, lo, hi)
    return S.sigmoid(z)


def watchlist(features_df: DataFrame, coefs=None, intercept: float | None = None, top_n: int = 25,
              features: Sequence[str] = FEATURES) -> DataFrame:
    """Score the latest quarter's complete cases (clipped inputs) and keep the top N.

    The latest date is a scalar subquery; the top-N is a TakeOrdered (per-task
    heaps of N merged on the driver), never a global sort.
    """
    coefs = FIXED_COEFS if coefs is None else coefs
    intercept = FIXED_INTERCEPT if intercept is None else intercept
    latest = W.latest_period(features_df, "REPDTE").dropna(subset=list(features))
    out = latest.select("CERT", "STNAME", "CITY", clipped_score(coefs, intercept).alias("distress_prob"),
                        "texas_ratio", "tier1_leverage", "cre_ratio")
    return out.orderBy(F.col("distress_prob").desc(), F.col("CERT")).limit(top_n)
