"""Fits, models and plans against direct computations (numpy, closed forms) on small tables."""
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

import __spark_entry__ as E
from lodestar.operators import attribution as AT
from lodestar.operators import glm
from lodestar.operators import quantiles as Q
from lodestar.plans import causal, ml, sources
from lodestar.plans.scalars import prep
from lodestar.sources import conform as C

SF = "/root/testdata/sf0.001"
FULL = [*C.CREDIT_FEATURES, *C.RACE_FEATURES]


@pytest.fixture(scope="module")
def apps(spark):
    cols = ["institution", "activity_year", "state_code", "county_code", "loan_purpose", "loan_amount", "approved", *FULL]
    return prep(spark, SF).select(*cols).toPandas()


def newton(X, y):
    b = np.zeros(X.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-X @ b))
        b = b + np.linalg.lstsq((X * (p * (1 - p))[:, None]).T @ X, X.T @ (y - p), rcond=None)[0]
    p = np.clip(1 / (1 + np.exp(-X @ b)), 1e-15, 1 - 1e-15)
    ll = (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
    m = y.mean()
    return b, 1 - ll / (len(y) * (m * np.log(m) + (1 - m) * np.log(1 - m)))


def design(d, xs):
    d = d.dropna(subset=xs)
    return np.column_stack([np.ones(len(d)), d[xs].to_numpy(float)]), d["approved"].to_numpy(float)


# ---- nested and stratified fits

def test_stability_and_r2_equal_separate_fits(spark, apps):
    got = {r["spec"]: r for r in causal.q_coef_stability(spark, SF).collect()}
    base = None
    for spec, xs in causal.NESTED.items():
        b, r2 = newton(*design(apps, xs))
        coef = b[1 + xs.index("is_black")]
        base = coef if base is None else base
        assert got[spec]["coef"] == pytest.approx(coef, abs=1e-5) and got[spec]["r2"] == pytest.approx(r2, abs=1e-5)
        assert got[spec]["movement_pct"] == pytest.approx(abs(base - coef) / abs(base) * 100, abs=1e-2)
    r2s = {r["spec"]: r for r in causal.q_r2_decomposition(spark, SF).collect()}
    clean = apps.dropna(subset=FULL)
    want = {s: newton(*design(clean, xs))[1] for s, xs in causal.NESTED.items()}
    assert all(r2s[s]["r2"] == pytest.approx(want[s], abs=1e-5) for s in want)
    assert sum(r["share_pct"] or 0 for r in r2s.values()) == pytest.approx(100, abs=1e-3)


def test_two_stage_and_strata(spark, apps):
    two = {(r["institution"], r["stage"], r["term"]): r["coef"] for r in causal.q_logit_two_stage(spark, SF).collect()}
    for inst, d in apps.groupby("institution"):
        b, _ = newton(*design(d, FULL))
        assert two[inst, 2, "is_black"] == pytest.approx(b[1 + FULL.index("is_black")], abs=1e-5)
    strata = E.queries()["logit_full_by_stratum"](spark, SF).collect()
    for r in strata:
        col = {"institution": "institution", "year": "activity_year", "purpose": "loan_purpose"}.get(r["kind"])
        if col:
            d = apps[apps[col].astype(str) == r["level"]]
            xs = [x for x in FULL if d.dropna(subset=FULL)[x].std() > 0]
            b, _ = newton(*design(d.dropna(subset=FULL), xs))
            assert r["coef"] == pytest.approx(b[1 + xs.index("is_black")], abs=1e-4)
    assert {r["kind"] for r in strata} >= {"purpose", "income_band"}


def test_linear_probability_models(spark, apps):
    d = apps.dropna(subset=FULL)
    dummies = [np.asarray(d[c].astype(str) == v, float) for c in ("institution", "activity_year")
               for v in sorted(d[c].astype(str).unique())[1:]]
    X = np.column_stack([np.ones(len(d)), d[FULL].to_numpy(float), *dummies])
    b = np.linalg.lstsq(X, d["approved"].to_numpy(float), rcond=None)[0]
    assert causal.q_lpm_pooled_fe(spark, SF).first()["coef"] == pytest.approx(b[1 + FULL.index("is_black")], abs=1e-5)
    for r in causal.q_lpm_by_group(spark, SF).collect():
        g = d[d["institution"] == r["institution"]]
        years = [np.asarray(g["activity_year"] == v, float) for v in sorted(d["activity_year"].unique())[1:]]
        X = np.column_stack([np.ones(len(g)), g[FULL].to_numpy(float), *years])
        b = np.linalg.lstsq(X, g["approved"].to_numpy(float), rcond=None)[0]
        assert r["coef"] == pytest.approx(b[1 + FULL.index("is_black")], abs=1e-5)


def test_interaction_and_spec_table(spark, apps):
    lo, hi = apps["loan_amount"].quantile([0.25, 0.75])
    d = apps.assign(q1=(apps.loan_amount <= lo).astype(float), q4=(apps.loan_amount >= hi).astype(float)).dropna(subset=FULL)
    d["bq"], d["bd"] = d.is_black * d.q1, d.is_black * d.dti_mid
    xs = [*FULL, "q1", "q4", "bq", "bd"]
    b, _ = newton(*design(d, xs))
    r = causal.q_logit_interaction(spark, SF).first()
    assert r["combined_or"] == pytest.approx(np.exp(b[1 + xs.index("is_black")] + b[1 + xs.index("bq")]), rel=1e-4)
    spec = {x["label"]: x["coef"] for x in causal.q_spec_table(spark, SF).collect()}
    assert list(spec) == ["baseline", "purchase_only", "state_fe", "county_fe_lpm"]
    d = apps.dropna(subset=FULL)
    at = 1 + FULL.index("is_black")
    assert spec["baseline"] == pytest.approx(newton(*design(d, FULL))[0][at], abs=1e-5)
    some = d[d.loan_purpose == "1"]
    xs = [x for x in FULL if some[x].std() > 0]
    assert spec["purchase_only"] == pytest.approx(newton(*design(some, xs))[0][1 + xs.index("is_black")], abs=1e-5)
    xs = [x for x in FULL if d[x].std() > 0]
    states = np.column_stack([np.asarray(d.state_code == v, float) for v in sorted(d.state_code.unique())[1:]])
    X, y = design(d, xs)
    assert spec["state_fe"] == pytest.approx(newton(np.column_stack([X, states]), y)[0][1 + xs.index("is_black")], abs=1e-5)
    n = apps.groupby("county_code")["county_code"].transform("count")
    county = apps["county_code"].where(n >= 50, "other")
    e = d[[*xs, "approved"]].astype(float)
    e = e - e.groupby(county.loc[d.index]).transform("mean")
    b = np.linalg.lstsq(np.column_stack([np.ones(len(e)), e[xs]]), e["approved"], rcond=None)[0]
    assert spec["county_fe_lpm"] == pytest.approx(b[1 + xs.index("is_black")], abs=1e-5)


def test_absorbed_logit_equals_the_dummy_fit(spark):
    """Forty levels of unequal size, an aliased term, one constant within levels, and levels of one outcome."""
    from lodestar.operators import effects as FX
    rng = np.random.default_rng(3)
    n = 4000
    g = (40 * rng.random(n) ** 2).astype(int)
    a = rng.normal(size=(n, 3))
    y = (rng.random(n) < 1 / (1 + np.exp(-(a @ [.5, -1, 0] + np.sin(g))))).astype(float)
    rows = [(f"g{i}", float(t), *map(float, x), float(x[0] + x[1]), float(i)) for i, t, x in zip(g, y, a)]
    rows += [("all", 1.0, *map(float, rng.normal(size=5))) for _ in range(30)] + [(None, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("g1", None, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, y double, a double, b double, c double, ab double, byg double")
    got = {r["term"]: r for r in FX.logit_absorbed(df, "y", ["a", "b", "ab", "c", "byg"], "g").collect()}
    some = [i for i in range(40) if 0 < y[g == i].mean() < 1]
    kept = np.isin(g, some)
    X = np.column_stack([a, *[(g == i).astype(float) for i in some]])[kept]
    b, _ = newton(X, y[kept])
    p = 1 / (1 + np.exp(-X @ b))
    V = np.linalg.inv((X * (p * (1 - p))[:, None]).T @ X)
    for i, t in enumerate("abc"):
        assert got[t]["coef"] == pytest.approx(b[i], abs=1e-8) and got[t]["se"] == pytest.approx(np.sqrt(np.diag(V))[i], rel=1e-6)
    assert got["ab"]["coef"] is None and got["byg"]["coef"] is None and got["a"]["n"] == kept.sum() and got["a"]["converged"]


def test_absorbed_logit_of_many_levels(spark):
    """100,000 levels of three rows: no level list, and the conditional sign of the effect."""
    from lodestar.operators import effects as FX
    df = spark.range(300_000).select((F.col("id") % 100_000).alias("g"), (F.xxhash64("id") % 1000 / 500.0).alias("x"), "id")
    df = df.withColumn("y", ((F.col("x") + F.xxhash64("id", F.lit(1)) % 1000 / 300.0) > 0).cast("int"))
    r = FX.logit_absorbed(df, "y", ["x"], "g").first()
    assert r["converged"] and r["coef"] > 0.1 and 0 < r["se"] < r["coef"] / 10 and 100_000 < r["n"] < 300_000


def test_event_study_takes_every_year(spark):
    from lodestar.operators import causal as CA
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(0, 2)), int(rng.integers(0, 2)), int(y), int(rng.integers(0, 2)))
            for y in (1990, 1995, 1996, 2030) for _ in range(80)]
    df = spark.createDataFrame(rows, "g int, t int, yr int, y int")
    got = CA.event_study(df, "y", "g", "t", "yr", 1995).collect()
    assert {r["yr"] for r in got} == {1990, 1996, 2030}


def test_rate_premium(spark):
    q = E.queries()["rate_premium_explained"](spark, SF).first()
    from lodestar.plans.impact import SMALL_BALANCE_UPB, priced
    d = priced(spark, SF).select("original_rate", "original_upb", "fico", "original_dti", "original_ltv", "llpa_bps").toPandas()
    d = d.astype(float).dropna()
    X = np.column_stack([np.ones(len(d)), d.fico, d.original_dti, d.original_ltv, np.log(d.original_upb),
                         (d.original_upb < SMALL_BALANCE_UPB).astype(float)])
    a = np.linalg.lstsq(X, d.original_rate * 100, rcond=None)[0][5]
    b = np.linalg.lstsq(np.column_stack([X, d.llpa_bps]), d.original_rate * 100, rcond=None)[0][5]
    if np.ptp(X[:, 5]):
        assert q["premium_a"] == pytest.approx(a, abs=1e-3) and q["premium_b"] == pytest.approx(b, abs=1e-3)
    else:
        assert q["premium_a"] is None


def test_synthetic_gap_has_every_year(spark):
    gap = causal.q_synthetic_gap(spark, SF).collect()
    assert len({r["activity_year"] for r in gap}) == len(gap) > 3
    assert all(r["gap"] == pytest.approx(r["actual"] - r["synthetic"], abs=1e-5) for r in gap)


# ---- quantiles

def test_quantiles_with_a_value_that_half_the_rows_hold(spark):
    x = [7.0] * 500 + [float(i % 97) for i in range(500)]
    df = spark.createDataFrame([(v, "ab"[i % 2]) for i, v in enumerate(x)], "x double, g string")
    got = [r["value"] for r in Q.exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.9, 1.0]).orderBy("q_index").collect()]
    assert got == pytest.approx(list(np.quantile(x, [0.0, 0.25, 0.5, 0.9, 1.0])))


def test_quantile_passes_shuffle_histograms_only(spark, tmp_path):
    """No pass shuffles rows: what crosses an exchange are bins, and later passes read open bins by a broadcast join."""
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    for by in ([], ["l_returnflag"]):
        plan = Q.exact_quantiles(df, "l_extendedprice", [0.25, 0.5], by)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "lineitem" not in plan  # answers are stored
    seen = []
    real = Q.stored

    def spy(frame, name):
        seen.append((name, frame._jdf.queryExecution().executedPlan().toString()))
        return real(frame, name)
    Q.stored, held = spy, Q.stored
    try:
        Q.exact_quantiles(df, "l_extendedprice", [0.25, 0.5], ["l_returnflag"]).collect()
    finally:
        Q.stored = held
    passes = [p for n, p in seen if n == "radix"]
    assert 1 < len(passes) <= 4
    for p in passes:
        # an exchange stands above the partial count of bins, or holds what came of it
        assert "partial_count" in p and "SortMergeJoin" not in p.split("partial_count", 1)[1]


# ---- sources

def test_years_without_files_and_unexpected_files(spark):
    counts = spark.createDataFrame([(1993, 5), (2040, 2)], "source_year int, n long")
    got = {r["source_year"]: (r["n"], r["missing"], r["unexpected"]) for r in sources.with_expected_years(counts, [1992, 1993]).collect()}
    assert got == {1992: (0, 1, 0), 1993: (5, 0, 0), 2040: (2, 0, 1)}


def test_profile_reports_types(spark):
    df = spark.createDataFrame([(1, "x"), (2, "3"), (None, "x")], "a int, b string")
    got = {r["column_name"]: r.asDict() for r in sources.profile(df).collect()}
    assert got["a"]["dtype"] == "int" and got["a"]["n_nonnull"] == 2 and got["b"]["n_distinct"] == 2
    assert got["b"]["numeric_share"] == pytest.approx(1 / 3)


def test_seeded_sample_repeats(spark):
    from lodestar.operators import aggs
    df = spark.range(1000).withColumnRenamed("id", "k")
    a, b = (sorted(r["k"] for r in aggs.seeded_sample(d, ["k"], 50, seed=42).collect()) for d in (df, df.repartition(9)))
    assert a == b and len(set(a)) == 50
    assert a != sorted(r["k"] for r in aggs.seeded_sample(df, ["k"], 50, seed=43).collect())


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from lodestar import session

    class Context:
        master = "yarn"
        def getCheckpointDir(self):
            return None
        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())


# ---- models

@pytest.fixture(scope="module")
def binary(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(600, 3))
    y = (X[:, 0] + 0.5 * X[:, 1] * X[:, 2] + rng.normal(size=600) > 0).astype(int)
    return spark.createDataFrame([(i, i % 4, *map(float, X[i]), int(y[i])) for i in range(600)],
                                 "CERT int, REPDTE int, a double, b double, c double, label int")


def test_forest_attribution_adds_up_to_the_probability(spark, binary):
    model = ml.fit_rf(binary, trees=7, feats=["a", "b", "c"])
    long, base = AT.shap_values(binary, ["a", "b", "c"], model.stages[-1], ["CERT"])
    total = {r["CERT"]: r["s"] for r in long.groupBy("CERT").agg(F.sum("phi").alias("s")).collect()}
    p = {r["CERT"]: r["p1"] for r in ml.prob1(model.transform(binary)).select("CERT", "p1").collect()}
    assert max(abs(total[i] + base - p[i]) for i in p) < 1e-9


def test_calibration_averages_fold_probabilities(spark, binary, monkeypatch):
    monkeypatch.setattr(ml, "FEATS", ["a", "b", "c"])
    monkeypatch.setattr(ml.fit_gbt, "__defaults__", (3, ["a", "b", "c"], *ml.fit_gbt.__defaults__[2:]))
    fits = ml.fit_platt(binary, rounds=3)
    assert len(fits) == 3
    got = {r["CERT"]: r["p_cal"] for r in ml.platt_probability(fits, binary).collect()}
    one = [{r["CERT"]: 1 / (1 + np.exp(-(a + b * r["p1"]))) for r in ml.prob1(m.transform(binary)).collect()} for m, a, b in fits]
    assert all(got[i] == pytest.approx(np.mean([o[i] for o in one])) for i in got)
    with pytest.raises(ValueError):
        ml.fit_platt(binary.withColumn("label", F.lit(1)).limit(30).unionByName(
            binary.where("CERT < 0")), rounds=1)


def test_metrics_and_split(spark, binary):
    d = ml.split_rows(binary, ["CERT", "REPDTE"])
    n = {(r["split"], r["label"]): r["count"] for r in d.groupBy("split", "label").count().collect()}
    assert sum(n[s, x] for s, x in n if s == "test") == 120
    pred = binary.select(F.col("a").alias("p1"), "label", F.col("CERT").alias("id"))
    name, auc, ap, top, train, test = ml.model_metrics(pred, "m", 5)
    rows = pred.toPandas()
    pos, neg = rows.p1[rows.label == 1], rows.p1[rows.label == 0]
    assert auc == pytest.approx((pos.to_numpy()[:, None] > neg.to_numpy()[None, :]).mean()) and (train, test) == (5, 600)
    assert top == pytest.approx(rows.sort_values("p1", ascending=False).label.head(50).mean())


def test_application_models_against_direct_sums(spark, monkeypatch):
    models = {}

    def keep(name, fit):
        def run(*args, **kw):
            models[name] = fit(*args, **kw)
            return models[name]
        return run
    monkeypatch.setattr(ml.fit_application_gbt, "__defaults__", (3,))
    monkeypatch.setattr(ml.fit_rf, "__defaults__", (3, ml.FEATS, True))
    monkeypatch.setattr(ml, "fit_application_gbt", keep("gbt", ml.fit_application_gbt))
    monkeypatch.setattr(ml, "fit_rf", keep("rf", ml.fit_rf))
    d, train, test, feats = ml.application_split(spark, SF)
    rows = test.toPandas()
    got = {r["model"]: r for r in ml.q_model_comparison(spark, SF).collect()}
    assert list(got) == ["logit", "gbt", "rf"]
    fitted = train.toPandas()
    beta, _ = newton(np.column_stack([np.ones(len(fitted)), fitted[feats]]), fitted["label"].to_numpy(float))
    p = {"logit": 1 / (1 + np.exp(-(beta[0] + rows[feats].to_numpy() @ beta[1:]))),
         "gbt": 1 / (1 + np.exp(-models["gbt"].margin(rows[feats].to_numpy())))}
    scored = ml.prob1(models["rf"].transform(test)).select("app_id", "p1").toPandas().set_index("app_id")["p1"]
    p["rf"] = scored[rows["app_id"]].to_numpy()
    y = rows["label"].to_numpy() == 1
    auc = {}
    for name, s in p.items():
        s = np.round(s, 12)
        pairs = s[y][:, None] - s[~y][None, :]
        auc[name] = (pairs > 0).mean() + (pairs == 0).mean() / 2
        assert got[name]["auc"] == pytest.approx(auc[name], abs=2e-6)
        levels = np.unique(s)[::-1]
        precise = sum((y & (s == v)).sum() / y.sum() * y[s >= v].mean() for v in levels)
        assert got[name]["average_precision"] == pytest.approx(precise, abs=2e-6)
        assert (got[name]["n_train"], got[name]["n_test"]) == (len(fitted), len(rows))
        assert got[name]["auc_range"] == pytest.approx(got["rf"]["auc_range"])
    assert got["rf"]["auc_range"] == pytest.approx(max(auc.values()) - min(auc.values()), abs=4e-6)
    assert got["logit"]["protected_or"] == pytest.approx(np.exp(beta[1 + feats.index("is_black")]), abs=1e-5)
    assert got["gbt"]["protected_or"] is None
    row = ml.q_model_counterfactual(spark, SF).first()
    marked = rows[rows["is_black"] == 1][feats]
    prob = lambda X: 1 / (1 + np.exp(-models["gbt"].margin(X.to_numpy())))
    excess = prob(marked.assign(is_black=0.0)) - prob(marked)
    assert row["n"] == len(marked) and row["total_excess"] == pytest.approx(excess.sum(), abs=1e-5)
    assert row["mean_excess"] == pytest.approx(excess.mean(), abs=1e-6)
    d.unpersist()


# ---- streams

def test_first_seen_follows_file_order(spark, tmp_path):
    from lodestar.streaming import twins
    for k, part in enumerate([[(1, "a"), (2, "b")], [(1, "c"), (3, "d")], [(3, "e"), (2, "f")]]):
        spark.createDataFrame(part, "k long, v string").coalesce(1).write.parquet(f"{tmp_path}/f{k}")
    import shutil
    for k in range(3):
        part = next((tmp_path / f"f{k}").glob("part-*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        shutil.copy(part, tmp_path / "in" / f"part-{k}.parquet")
    schema = spark.createDataFrame([], "k long, v string").schema
    got = twins.stream_first_seen(spark, str(tmp_path / "in"), schema, "k")
    assert {(r["k"], r["v"]) for r in got.collect()} == {(1, "a"), (2, "b"), (3, "d")}


def test_period_counts_join_closed_and_open_windows(spark, tmp_path):
    from datetime import datetime, timedelta
    from lodestar.streaming import twins
    rows = [(datetime(2024, 1, 1) + timedelta(hours=7 * i), "xy"[i % 2]) for i in range(60)]
    spark.createDataFrame(rows, "ts timestamp, e string").repartition(3).write.parquet(f"{tmp_path}/e")
    schema = spark.read.parquet(f"{tmp_path}/e").schema
    got = {(r["window"]["start"].date(), r["e"]): r["n"] for r in
           twins.stream_period_counts(spark, f"{tmp_path}/e", schema, "ts", ["e"]).collect()}
    want = {}
    for t, e in rows:
        want[t.date(), e] = want.get((t.date(), e), 0) + 1
    assert got == want


# ---- linear attribution

def test_dependent_attribution_equals_all_subsets_and_orders(spark, monkeypatch):
    """Each value by its definition: what a feature adds to the expectation, over all orders of six dependent ones."""
    import itertools
    from lodestar.operators import attribution as A
    rng = np.random.default_rng(2)
    n, k = 400, 6
    X = rng.normal(size=(n, k)) @ rng.normal(size=(k, k)) * [1, 2, .5, 3, 1, .1] + 50
    names = [f"x{i}" for i in range(k)]
    beta = rng.normal(size=k)
    df = spark.createDataFrame([tuple(map(float, r)) for r in X], ", ".join(f"{x} double" for x in names)).repartition(3)
    got = A.linear_attribution(df, dict(zip(names, map(float, beta)))).toPandas()
    x, mean, cov = got[names].to_numpy(), X.mean(axis=0), np.cov(X.T, bias=True)

    def value(S, row):
        S, R = list(S), [i for i in range(k) if i not in S]
        given = mean[R] + (cov[np.ix_(R, S)] @ np.linalg.solve(cov[np.ix_(S, S)], row[S] - mean[S]) if S else 0)
        return beta[S] @ row[S] + beta[R] @ given
    for i in (0, 17):
        want = np.zeros(k)
        for order in itertools.permutations(range(k)):
            v = [value(sorted(order[:j]), x[i]) for j in range(k + 1)]
            want[list(order)] += np.diff(v) / math.factorial(k)
        assert got.loc[i, [f"phi_{c}" for c in names]].to_numpy(float) == pytest.approx(want, abs=1e-8)
    assert got[[f"phi_{c}" for c in names]].sum(axis=1).to_numpy() == pytest.approx((x - mean) @ beta, abs=1e-8)
    exact = A.dependent_transform(beta, cov)
    monkeypatch.setattr(A, "EXACT_FEATURES", 3)
    assert np.abs(A.dependent_transform(beta, cov) - exact).max() < .1 * np.abs(exact).max()


def test_dependent_attribution_on_fitted_coefficients(spark):
    rows = {r["feature"]: r["mean_abs_contribution"] for r in ml.q_linear_attribution_dependent(spark, SF).collect()}
    assert len(rows) == 9 and all(v >= 0 for v in rows.values()) and any(rows.values())


def test_model_rows_are_stored_once(spark):
    """Fits read stored rows, not the panel's joins and shuffles again; a forest's partitions follow the cores."""
    from lodestar.plans import ml
    for df in (*ml.ml_frame(spark, SF), *ml.application_split(spark, SF)[:3]):
        files = df.inputFiles()
        assert files and not any(f.startswith(f"file://{SF}") for f in files)
    few = ml.sized(spark.range(3000), rows=10)
    assert few.rdd.getNumPartitions() <= max(2, spark.sparkContext.defaultParallelism)
