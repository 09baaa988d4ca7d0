import math

import numpy as np
from pyspark.sql import functions as F

from lodestar.operators import glm


def _cells(spark, a, b, c, d, group="g"):
    rows = [(group, 1, 1)] * a + [(group, 1, 0)] * b + [(group, 0, 1)] * c + [(group, 0, 0)] * d
    return spark.createDataFrame(rows, "g string, x int, y int")


def test_logit_matches_2x2_closed_form(spark):
    df = _cells(spark, 30, 20, 50, 60).unionByName(_cells(spark, 10, 15, 40, 35, "h"))
    fit = glm.logit(df, "y", ["x"], by=["g"])
    r = {(row.g, row.term): row for row in fit.collect()}
    for g, (a, b, c, d) in {"g": (30, 20, 50, 60), "h": (10, 15, 40, 35)}.items():
        assert abs(r[(g, "x")].coef - math.log(a * d / (b * c))) < 1e-8
        assert abs(r[(g, "x")].se - math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)) < 1e-8


def test_min_n_guard(spark):
    df = _cells(spark, 5, 5, 5, 4)
    assert glm.logit(df, "y", ["x"], by=["g"], min_n=20).count() == 0
    assert glm.logit(df, "y", ["x"], by=["g"], min_n=19).count() == 2


def test_separation_gives_null_row(spark):
    df = _cells(spark, 10, 0, 5, 5)
    rows = glm.logit(df, "y", ["x"], by=["g"]).where("term = 'x'").collect()
    assert len(rows) == 1 and rows[0].coef is None and not rows[0].converged


def test_hc3_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    y = 1 + 2 * x + rng.normal(size=200) * (1 + np.abs(x))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    fit = {r.term: r for r in glm.ols(df, "y", ["x"], cov_type="HC3").collect()}
    X = np.column_stack([np.ones(200), x])
    A = np.linalg.inv(X.T @ X)
    b = A @ X.T @ y
    e = y - X @ b
    h = np.einsum("ij,jk,ik->i", X, A, X)
    V = A @ (X.T * (e / (1 - h)) ** 2) @ X @ A
    assert abs(fit["x"].coef - b[1]) < 1e-9
    assert abs(fit["x"].se - math.sqrt(V[1, 1])) < 1e-9


def test_classical_ols_p_uses_t(spark):
    df = spark.createDataFrame([(float(i), float(i) * 0.5 + (i % 3)) for i in range(12)], "x double, y double")
    r = glm.ols(df, "y", ["x"]).where("term = 'x'").first()
    assert 0 <= r.p <= 1 and r.r2 > 0.5


def _newton(X, y, steps=100):
    b = np.zeros(X.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-X @ b))
        b = b + np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X, X.T @ (y - p))
    return b


def test_steep_slope_is_no_separation(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=20_000) * 0.005
    y = (rng.random(20_000) < 1 / (1 + np.exp(-120 * x))).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    fit = {r.term: r for r in glm.logit(df, "y", ["x"]).collect()}
    b = _newton(np.column_stack([np.ones(len(x)), x]), y)
    assert fit["x"].converged and abs(fit["x"].coef - b[1]) < 1e-6 and abs(fit["const"].coef - b[0]) < 1e-6


def test_aliased_and_constant_terms_are_null_and_the_rest_is_fitted(spark):
    """Group a: w = 3.3 z; group b: the dummy d is constant."""
    rng = np.random.default_rng(6)
    rows = []
    for g in "ab":
        for i in range(300):
            z = float(rng.normal())
            rows.append((g, z, 3.3 * z if g == "a" else float(rng.normal()), int(i % 3 == 0) if g == "a" else 0,
                         float(1 + 2 * z + rng.normal()), int(rng.random() < 0.4)))
    df = spark.createDataFrame(rows, "g string, z double, w double, d int, y double, o int")
    for fit in (glm.ols(df, "y", ["z", "w", "d"], by=["g"]), glm.ols(df, "y", ["z", "w", "d"], by=["g"], cov_type="HC3"),
                glm.logit(df, "o", ["z", "w", "d"], by=["g"])):
        r = {(x.g, x.term): x for x in fit.collect()}
        assert r["a", "w"].coef is None and r["b", "d"].coef is None
        assert all(r[k].coef is not None and r[k].se > 0 for k in r if k not in {("a", "w"), ("b", "d")})
    X = np.array([(1, x[1], x[3]) for x in rows if x[0] == "a"])
    b = np.linalg.lstsq(X, np.array([x[4] for x in rows if x[0] == "a"]), rcond=None)[0]
    r = {x.term: x for x in glm.ols(df.where("g = 'a'"), "y", ["z", "w", "d"]).collect()}
    assert abs(r["z"].coef - b[1]) < 1e-9 and abs(r["d"].coef - b[2]) < 1e-9


def test_placebo_permutes_globally_whatever_the_partitions(spark):
    from lodestar.operators import causal as CA
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.random() < 0.5), int(rng.random() < 0.3), float(rng.normal())) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, y int, f int, z double")
    fits = [sorted(map(tuple, CA.placebo_permutation(d, "y", ["f", "z"], "f", "id", n_draws=12).collect()))
            for d in (df, df.repartition(7), df.coalesce(1))]
    assert [r[0] for r in fits[0]] == list(range(12))
    for other in fits[1:]:
        assert np.allclose(np.array(fits[0], float), np.array(other, float), atol=1e-9)
    # margins are kept, each draw is a set of its own, and a missed bracket is ranked in full
    m = sum(r[2] for r in rows)
    design = df.select(F.xxhash64("id", F.lit(42)).alias("_h"))
    h = np.array([r[0] for r in design.collect()], np.int64)
    for width in (6.0, 1e-6):
        cuts = CA.placebo_cuts(design, len(rows), m, 12, width)
        sets = [frozenset(np.flatnonzero(CA._draw_hash(h, d) <= cuts[d]).tolist()) for d in range(12)]
        assert {len(s) for s in sets} == {m} and len(set(sets)) == 12


def test_simplex_weights():
    from lodestar.operators.causal import _simplex_ls
    rng = np.random.default_rng(1)
    A = rng.normal(size=(20, 4))
    b = A @ np.array([0.2, 0.5, 0.3, 0.0])
    w = _simplex_ls(A, b)
    assert abs(w.sum() - 1) < 1e-9 and (w >= -1e-12).all()
    sse = np.sum((A @ w - b) ** 2)
    assert all(sse <= np.sum((A[:, j] - b) ** 2) + 1e-9 for j in range(4))


def test_tree_shap_additivity(spark):
    """sum(phi) + base equals the GBT raw margin for every row."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from lodestar.operators import attribution as AT
    rng = np.random.default_rng(5)
    X = rng.normal(size=(400, 3))
    y = ((X[:, 0] + 0.5 * X[:, 1] * X[:, 2] + rng.normal(size=400) * 0.3) > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, X[i]), int(y[i])) for i in range(400)], "id int, a double, b double, c double, y int")
    va = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features")
    model = GBTClassifier(labelCol="y", maxIter=8, maxDepth=3, seed=1).fit(va.transform(df))
    long, base = AT.shap_values(df, ["a", "b", "c"], model, ["id"])
    tot = {r.id: r.s for r in long.groupBy("id").agg(F.sum("phi").alias("s")).collect()}
    margin = {r.id: r.m for r in model.transform(va.transform(df))
              .select("id", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    assert max(abs(tot[i] + base - margin[i]) for i in margin) < 1e-9


def test_absorbed_twfe_equals_dummies_on_unbalanced_panel(spark):
    """One absorbed effect and dummies for the other reproduce the dummy-variable coefficient and
    cluster-robust error on an unbalanced panel."""
    from lodestar.operators import causal as CA
    rng = np.random.default_rng(11)
    rows = []
    for e in range(8):
        for t in range(7):
            if rng.random() < 0.2:
                continue  # unbalanced
            treat, post = int(e < 3), int(t >= 4)
            rows.append((f"e{e:02d}", f"t{t:02d}", treat, post, float(0.3 * e + 0.1 * t + 0.5 * treat * post
                                                                        + rng.normal())))
    panel = spark.createDataFrame(rows, "e string, t string, treat int, post int, y double")
    a = CA.did_twfe_absorbed(panel, "y", "treat", "post", "e", "t").first()
    df = panel.withColumn("treat_post", (F.col("treat") * F.col("post")).cast("double"))
    from lodestar.operators import frames
    df, en = frames.one_hot_drop_first(df, "e", prefix="fe_e")
    df, tn = frames.one_hot_drop_first(df, "t", prefix="fe_t")
    d = glm.term(glm.ols(df, "y", ["treat_post", *en, *tn], cov_type="cluster", cluster="e"), "treat_post").first()
    assert abs(a.coef - d.coef) < 1e-8 and abs(a.se - d.se) < 1e-8


def test_ridge_inputs_use_population_std(spark):
    from pyspark.ml.functions import vector_to_array
    from lodestar.plans.ml import FEATS, fit_ridge
    rng = np.random.default_rng(4)
    X = rng.normal(size=(60, len(FEATS))) * 3 + 1
    y = (X[:, 0] + rng.normal(size=60) > 1).astype(int)
    df = spark.createDataFrame([(*map(float, X[i]), int(y[i])) for i in range(60)],
                               ", ".join(f"{c} double" for c in FEATS) + ", label int")
    scaled = fit_ridge(df).transform(df).select(vector_to_array("scaled")[0].alias("z"))
    z = np.array([r.z for r in scaled.collect()])
    assert abs(z.mean()) < 1e-9 and abs(z.std() - 1) < 1e-9


def test_placebo_equals_separate_fits_with_all_controls(spark):
    """Eight controls, one of them aliased, and the flag: each draw's coefficient and error as its own fit has them."""
    from lodestar.operators import causal as CA
    rng = np.random.default_rng(4)
    n = 3000
    X = np.column_stack([rng.normal(size=n), rng.lognormal(size=n), rng.normal(size=n) * 50, *(rng.random(n) < p for p in (.3, .5, .2, .1))]).astype(float)
    X = np.column_stack([X, X[:, 3] + X[:, 4]])
    flag = (rng.random(n) < .15).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(.3 + .5 * X[:, 0] - .1 * X[:, 1] - .7 * flag)))).astype(float)
    names = [f"x{i}" for i in range(8)]
    df = spark.createDataFrame([(i, float(a), float(f), *map(float, r)) for i, (a, f, r) in enumerate(zip(y, flag, X))],
                               "id long, y double, f double, " + ", ".join(f"{x} double" for x in names)).repartition(5)
    got = {r["draw"]: r for r in CA.placebo_permutation(df, "y", [*names[:4], "f", *names[4:]], "f", "id", n_draws=9, actual=True).collect()}
    h = np.array([r["h"] for r in df.select("id", F.xxhash64("id", F.lit(42)).alias("h")).orderBy("id").collect()], np.int64)
    m = int(flag.sum())
    assert sorted(got) == list(range(-1, 9))
    for d in range(-1, 9):
        z = CA._draw_hash(h, d)
        on = (z <= np.sort(z)[m - 1]).astype(float) if d >= 0 else flag
        assert on.sum() == m
        A = np.column_stack([np.ones(n), X[:, :7], on])
        b = _newton(A, y)
        p = 1 / (1 + np.exp(-A @ b))
        se = np.sqrt(np.linalg.inv((A * (p * (1 - p))[:, None]).T @ A)[-1, -1])
        assert abs(got[d]["coef"] - b[-1]) < 1e-8 and abs(got[d]["se"] - se) < 1e-8
    none = CA.placebo_permutation(df.withColumn("f", F.lit(0.0)), "y", ["x0", "f"], "f", "id", n_draws=3).collect()
    assert len(none) == 3 and all(r["coef"] is None for r in none)


def test_counted_rows_and_kinds_equal_the_rows_themselves(spark):
    """A fit on distinct rows with their numbers, and one on rows with a level of each kind, against one on all rows."""
    from lodestar.operators import glm
    rng = np.random.default_rng(8)
    rows = [(int(rng.random() < 0.3 + 0.2 * x), int(x), g, None if i % 7 == 0 else h)
            for i, (x, g, h) in enumerate(zip(rng.integers(0, 2, 900), rng.choice(["a", "b"], 900), rng.choice(["c", "d", "e"], 900)))]
    df = spark.createDataFrame(rows, "y int, x int, g string, h string")
    cols = ["coef", "se", "n", "r2", "converged"]

    def got(fit, by):
        return {tuple(r[k] for k in [*by, "term"]): [r[c] for c in cols] for r in fit.collect()}

    want = got(glm.logit(df, "y", ["x"], by=["g"]), ["g"])
    cells = df.groupBy("g", "y", "x").agg(F.count(F.lit(1)).alias("times"))
    few = got(glm.logit(cells, "y", ["x"], by=["g"], times="times"), ["g"])
    assert want.keys() == few.keys() and all(np.allclose(want[k], few[k]) for k in want)

    long = df.select("y", "x", F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("level")) for c in "gh"])).alias("s"))
    long = long.select("y", "x", "s.*").dropna(subset=["level"])
    by = ["kind", "level"]
    want = got(glm.logit(long, "y", ["x"], by=by), by)
    wide = df.select(F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), "g", "h",
                     *[F.lit(None).cast("string").alias(c) for c in by])
    each = got(glm.logit(wide, "y", ["x"], by=by, blocks=glm.blocks_by_kind({"g": "g", "h": "h"}, "y", ["x"])), by)
    assert len(want) == 10 and want.keys() == each.keys() and all(np.allclose(want[k], each[k]) for k in want)
