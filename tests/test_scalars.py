import math

import pytest
from pyspark.sql import functions as F

from lodestar.functions import scalars as S
from lodestar.operators import quantiles as Q
from lodestar.operators import windows as W


def test_dti_variants(spark):
    vals = ["<20%", "20%-<30%", "30%-<36%", "36", "50%-60%", ">60%", "Exempt", None]
    df = spark.createDataFrame([(v,) for v in vals], "d string")
    rows = df.select(S.dti_midpoint("d", "A").alias("a"), S.dti_midpoint("d", "B").alias("b")).collect()
    assert [r.a for r in rows] == [20.0, None, None, 36.0, 55.0, 60.0, None, None]
    assert [r.b for r in rows] == [20.0, 25.0, 33.0, 36.0, 55.0, 60.0, None, None]


def test_pct_change_pad_and_clip(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, None, 2.0, 0.0, 3.0])], "k int, t int, x double")
    w = W.entity_window("k", "t")
    out = df.select("t", W.pct_change_pad("x", w).alias("p")).orderBy("t").collect()
    got = [r.p for r in out]
    assert got[0] is None and got[1] == 0.0 and got[2] == 1.0 and got[3] == -1.0 and math.isinf(got[4])
    clipped = df.select(W.pct_change_pad("x", w).alias("p")).select(S.clip("p", -10, 10).alias("c")) \
        .where(F.col("c").isNotNull()).agg(F.max("c")).first()[0]
    assert clipped == 10.0


def test_rolling_z_faithful_bound(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 1.0, 1.0, 100.0])], "g string, t int, n double")
    z = W.velocity_zscore(df, "n", ["g"], "t").orderBy("t").collect()
    assert abs(z[-1].z_score - 1.5) < 1e-12 and z[-1].rising_flag == 0
    const = spark.createDataFrame([("a", i, 5.0) for i in range(4)], "g string, t int, n double")
    assert all(r.z_score is None for r in W.velocity_zscore(const, "n", ["g"], "t").collect())


def test_qcut_drop_duplicates(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 2, 3, 4, 5, 6]], "x double")
    b = Q.qcut(df, "x", 4, duplicates="drop").orderBy("x").collect()
    assert [r.bucket for r in b] == [0, 0, 0, 0, 1, 1, 2, 2]


def test_exact_quantiles(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 10]], "x double")
    r = df.agg(F.percentile("x", F.lit(0.25)).alias("p25"), F.percentile("x", F.lit(0.5)).alias("p50")).first()
    assert r.p25 == 1.75 and r.p50 == 2.5


def test_hispanic_modes_and_safe_ratio(spark):
    from lodestar.sources.conform import application_features
    df = spark.createDataFrame([(1, "Not Hispanic or Latino", "White", "1", 10.0, 5.0, "<20%")],
                               "action_taken int, derived_ethnicity string, derived_race string, loan_purpose string, "
                               "income double, loan_amount double, debt_to_income_ratio string")
    assert application_features(df).first().is_hispanic == 1
    assert application_features(df, hispanic_mode="equal").first().is_hispanic == 0
    z = spark.createDataFrame([(1.0, 0.0)], "a double, b double").select(S.safe_ratio("a", "b").alias("r")).first()
    assert z.r is None


def test_texas_rules(spark):
    from lodestar.operators.risk import texas_ratio
    df = spark.createDataFrame([(5.0, 10.0, 0.0)], "NCLNLS double, EQ double, LNLSNTV double")
    r = df.select(texas_ratio("model").alias("m"), texas_ratio("api").alias("a")).first()
    assert r.m == 50.0 and r.a is None


def test_lead_label_tail_is_zero(spark):
    df = spark.createDataFrame([(1, t, 1) for t in range(6)], "k int, t int, f int")
    w = W.entity_window("k", "t")
    got = [r.l for r in df.select("t", W.lead_label("f", 4, w).alias("l")).orderBy("t").collect()]
    assert got == [1, 1, 0, 0, 0, 0]


def test_post_flag_uses_quarter_start(spark):
    from lodestar.operators.complaints import did_panel
    df = spark.createDataFrame([("X", "1998-06-15")], "institution string, d string") \
        .select("institution", F.to_timestamp("d").alias("date_received"))
    assert did_panel(df, "X", "1998-05-01").first().post == 0


def test_null_group_keys_dropped(spark):
    from lodestar.operators.complaints import velocity
    df = spark.createDataFrame([("A", None, "1998-01-01"), ("A", "p", "1998-01-01")], "institution string, product string, d string") \
        .select("institution", "product", F.to_timestamp("d").alias("date_received"))
    assert velocity(df).count() == 1


def test_closed_form_constants():
    from lodestar.plans.impact import MEDIAN_HOME_VALUE, TEN_YEAR_APPRECIATION_SHARE, equity_b
    assert round(MEDIAN_HOME_VALUE * TEN_YEAR_APPRECIATION_SHARE) == 114_720
    assert abs(equity_b() - 255_938) <= 2
    assert round(20_873 * 0.462 * (1.066 / 2.066)) == 4_976
    assert round(math.exp(-0.6135 * 0.6), 3) == 0.692


def test_value_share_sums_to_100(spark):
    from lodestar.operators.aggs import value_share
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "z")], "g string, v string")
    s = value_share(df, ["g"], "v").groupBy("g").agg(F.sum("pct").alias("t")).collect()
    assert all(abs(r.t - 100) < 1e-9 for r in s)


def test_normalizer_first_rule_wins(spark):
    rules = [("jpmorgan", "JPMorgan Chase"), ("chase", "Chase Other")]
    df = spark.createDataFrame([("jpmorgan chase",)], "n string")
    assert df.select(S.normalize_entity("n", rules).alias("c")).first().c == "JPMorgan Chase"


def test_distributed_exact_quantiles_match_pandas(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(0)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 3000), np.round(rng.normal(size=3000), 2))]
    rows += [(3, 1.0), (4, 2.0), (4, 5.0)]
    df = spark.createDataFrame(rows, "g int, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.q_index): r.value for r in Q.exact_quantiles(df, "x", probs, ["g"]).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "x"])
    for g, sub in pdf.groupby("g"):
        for i, p in enumerate(probs):
            assert abs(got[(g, i)] - sub.x.quantile(p)) < 1e-12
    glob = {r.q_index: r.value for r in Q.exact_quantiles(df, "x", probs).collect()}
    assert all(abs(glob[i] - pdf.x.quantile(p)) < 1e-12 for i, p in enumerate(probs))


def test_densify_gives_calendar_lags(spark):
    from lodestar.operators.complaints import complaint_panel
    df = spark.createDataFrame([(1, "2000-01-01", 5, 1.0), (1, "2000-07-01", 7, 1.0)],
                               "CERT long, q string, complaint_count long, timely_response double") \
        .select("CERT", F.to_date("q").alias("quarter"), "complaint_count", "timely_response")
    rows = {str(r.quarter): r for r in complaint_panel(df).collect()}
    assert rows["2000-07-01"].complaint_lag1 == 5.0          # row-based: skips the gap
    rows = {str(r.quarter): r for r in complaint_panel(df, densify=True).collect()}
    assert rows["2000-04-01"].complaint_count == 0 and rows["2000-07-01"].complaint_lag1 == 0.0


def test_synthetic_gap_zero_for_exact_donor(spark):
    import datetime
    from lodestar.operators.causal import synthetic_control, synthetic_gap
    d0 = datetime.date(2000, 1, 1)
    rows = []
    for t in range(8):
        d = d0.replace(year=2000 + t)
        a, b = float(t), float(10 - t)
        rows += [("A", d, a), ("B", d, b), ("C", d, 0.5 * a + 0.5 * b)]
    panel = spark.createDataFrame(rows, "u string, p date, v double")
    w = synthetic_control(panel, "u", "p", "v", datetime.date(2005, 1, 1), treated_units=["C"])
    gap = synthetic_gap(panel, w, "u", "p", "v").collect()
    assert max(abs(r.gap) for r in gap) < 1e-6


def test_one_hot_drops_alphabetical_first_level(spark):
    from lodestar.operators.frames import one_hot_drop_first
    df = spark.createDataFrame([("TX",), ("AL",), ("NY",), ("TX",)], "s string")
    _, names = one_hot_drop_first(df, "s")
    assert names == ["s_NY", "s_TX"]          # 'AL' (first alphabetically) is the reference
    _, names = one_hot_drop_first(df, "s", ref_level="TX")
    assert names == ["s_AL", "s_NY"]


def test_rare_and_null_levels_collapse_to_other(spark):
    from lodestar.operators.joins import rare_level_collapse
    rows = [("a",)] * 3 + [("b",)] + [(None,)] * 5
    df = spark.createDataFrame(rows, "c string")
    got = sorted((r.c, r.n) for r in rare_level_collapse(df, "c", 2).groupBy("c").count().withColumnRenamed("count", "n").collect())
    assert got == [("a", 3), ("other", 6)]


def test_exact_quantiles_skip_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,), (2.0,)], "x double")
    got = {r.q_index: r.value for r in Q.exact_quantiles(df, "x", [0.5, 0.25]).collect()}
    assert got == {0: 2.0, 1: 1.5}


def test_kth_smallest_exact_on_64bit_values(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    vals = rng.integers(-2**62, 2**62, size=2000)
    g = rng.integers(0, 2, size=2000)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(g, vals)], "g int, x long")
    ks = {0: 0, 1: int((g == 1).sum()) - 1}
    ranks = spark.createDataFrame(list(ks.items()), "g int, k long")
    got = {r.g: r.value for r in Q.kth_smallest(df, "x", ["g"], ranks).collect()}
    assert got == {k: int(np.sort(vals[g == k])[v]) for k, v in ks.items()}


@pytest.mark.parametrize("few", [0, 4096])
def test_radix_selection_of_odd_doubles(spark, few, monkeypatch):
    """Signs, zeros, tiny and huge values and long runs of one value; digit by digit, or the last ones at once."""
    import numpy as np
    import pandas as pd
    monkeypatch.setattr(Q, "FEW", few)
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=400) * 10.0 ** r.integers(-300, 300, 400), [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308],
                        np.full(300, 7.25), 1 + np.arange(200) * 2.0 ** -52])
    df = spark.createDataFrame([(float(v), "ab"[i % 2], None if i % 9 == 0 else i % 3) for i, v in enumerate(x)], "x double, g string, h int").repartition(5)
    probs = [0.0, 0.01, 1 / 3, 0.5, 0.77, 0.999, 1.0]
    pdf = df.toPandas()
    for by in ([], ["g"], ["g", "h"]):
        got = {(*[row[b] for b in by], row["q_index"]): row["value"] for row in Q.exact_quantiles(df, "x", probs, by).collect()}
        sub = {k if isinstance(k, tuple) else (k,): v for k, v in pdf.groupby(by)} if by else {(): pdf}
        assert len(got) == len(sub) * len(probs)
        for k, v in sub.items():
            s = np.sort(v.x.to_numpy())
            for i, p in enumerate(probs):
                pos = p * (len(s) - 1)
                lo, f = int(pos), pos - int(pos)
                want = s[lo] if f == 0 else (1 - f) * s[lo] + f * s[lo + 1]
                assert got[(*k, i)] == want
