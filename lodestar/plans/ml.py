"""Early-warning model queries: scaling, metrics, attribution, Spark ML models."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lodestar.operators import boosting, forest
from lodestar.operators import metrics as M
from lodestar.operators import risk as R
from lodestar.plans.common import cte, rounded
from lodestar.plans.registry import register
from lodestar.plans.risk import _score_sql, features, features_sql
from lodestar.session import stored
from lodestar.sources import conform as C

FEATS = R.FEATURES
COMPLETE_SQL = " AND ".join(f"{c} IS NOT NULL" for c in FEATS)


def scored(spark, sf):
    """All complete bank-quarters with the fixed-coefficient distress score."""
    df = features(spark, sf).dropna(subset=FEATS)
    return df.select("CERT", "REPDTE", "label", *FEATS,
                     R.clipped_score(R.FIXED_COEFS, R.FIXED_INTERCEPT).alias("score"))


SCORED_SQL = cte(f=features_sql()) + f", s AS (SELECT CERT, REPDTE, label, {_score_sql()} AS score FROM f WHERE {COMPLETE_SQL})"


@register("roc_auc", section="M", sql=SCORED_SQL + """
, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ar FROM s)
SELECT round((sum(CASE WHEN label = 1 THEN ar ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0)
             / (sum(label) * (count(*) - sum(label))), 6) AS auc,
       CAST(sum(label) AS BIGINT) AS n_pos, CAST(count(*) - sum(label) AS BIGINT) AS n_neg FROM r""")
def q_roc_auc(spark, sf):
    return rounded(M.roc_auc(scored(spark, sf), "score", "label"))


@register("average_precision", section="M", sql=SCORED_SQL + """
, c AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM s GROUP BY 1)
, g AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM c)
SELECT round(sum(pos / (SELECT sum(label) FROM s) * tp / (tp + fp)), 6) AS average_precision FROM g""")
def q_average_precision(spark, sf):
    return rounded(M.average_precision(scored(spark, sf), "score", "label"))


@register("precision_at_k", section="M", sql=SCORED_SQL + """
SELECT round(avg(label), 6) AS precision_at_k, count(*) AS k,
       round(avg(label) / (SELECT avg(label) FROM s), 6) AS lift
FROM (SELECT label FROM s ORDER BY score DESC, CERT, REPDTE LIMIT 50)""")
def q_precision_at_k(spark, sf):
    return rounded(M.precision_at_k(scored(spark, sf), "score", "label", 50, ["CERT", "REPDTE"]))


@register("standard_scale", section="M", sql=cte(f=features_sql()) + f"""
, s AS (SELECT * FROM f WHERE {COMPLETE_SQL})
SELECT CERT, CAST(REPDTE AS VARCHAR) AS REPDTE, """ + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM s)) / NULLIF((SELECT stddev_pop({c}) FROM s), 0), 6) AS {c}"
    for c in ["texas_ratio", "nim", "roa", "log_asset"]) + " FROM s")
def q_standard_scale(spark, sf):
    df = features(spark, sf).dropna(subset=FEATS).select("CERT", "REPDTE", "texas_ratio", "nim", "roa", "log_asset")
    return rounded(M.standard_scale(df, ["texas_ratio", "nim", "roa", "log_asset"]))


@register("linear_attribution", section="M", sql=cte(f=features_sql()) + f"""
, s AS (SELECT {', '.join(f"CASE WHEN {c} > 10 THEN 10.0 WHEN {c} < -10 THEN -10.0 ELSE {c} END AS {c}" for c in FEATS)}
        FROM f WHERE {COMPLETE_SQL})
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(abs({b} * ({c} - (SELECT avg({c}) FROM s)))), 6) AS mean_abs_contribution FROM s"
    for c, b in R.FIXED_COEFS.items()))
def q_linear_attribution(spark, sf):
    """phi_j = beta_j (x_j - E x_j) per row (independence form), mean |phi| per feature."""
    from lodestar.functions.scalars import clip
    df = features(spark, sf).dropna(subset=FEATS).select(*[clip(c, -10, 10).alias(c) for c in FEATS])
    means = df.select(F.struct(*[F.avg(c).alias(c) for c in FEATS])).scalar()
    phi = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"),
                                                 F.abs(F.lit(b) * (F.col(c) - means[c])).alias("v"))
                                        for c, b in R.FIXED_COEFS.items()])).alias("kv"))
    return rounded(phi.groupBy(F.col("kv.feature").alias("feature")).agg(F.avg("kv.v").alias("mean_abs_contribution")))


@register("linear_attribution_dependent", section="M")
def q_linear_attribution_dependent(spark, sf):
    """Mean |phi| per feature of the treated institution's full-control logit, with what is missing from a subset of features
    expected from those in it."""
    from lodestar.operators import attribution, glm
    from lodestar.plans.causal import CREDIT, RACE, TREAT
    from lodestar.plans.scalars import prep
    xs = [*CREDIT, *RACE]
    df = prep(spark, sf).where(F.col("institution") == TREAT).select("approved", *xs).dropna()
    coefs = {r["term"]: r["coef"] for r in glm.logit(df, "approved", xs).select("term", "coef").collect()}
    phi = attribution.linear_attribution(df, {x: coefs.get(x) for x in xs})
    mean = phi.select(F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.abs(F.col(f"phi_{x}")).alias("v")) for x in xs])).alias("kv"))
    return rounded(mean.groupBy(F.col("kv.feature").alias("feature")).agg(F.avg("kv.v").alias("mean_abs_contribution")))


# ---------------------------------------------------------------- Spark ML models (rows-only)

TRAIN_END, TEST_START = "1999-12-31", "2000-06-30"


def ml_frame(spark, sf):
    from lodestar.functions.scalars import clip
    df = features(spark, sf).dropna(subset=FEATS)
    # stored: a fit reads its rows several times, and the features cost a shuffle of the panel each time
    df = stored(df.select("CERT", "REPDTE", "STNAME", "CITY", "label", *[clip(c, -10, 10).alias(c) for c in FEATS]), "bank_rows")
    train, test = R.temporal_split(df, train_end=TRAIN_END, test_start=TEST_START)
    return df, train, test


def balanced_weights(df, label="label"):
    """sklearn 'balanced' class weights: N / (2 n_c), as a column."""
    n = df.select(F.struct(F.count(F.lit(1)).alias("n"), F.sum(label).alias("n1"))).scalar()
    w1 = n["n"] / (2.0 * n["n1"])
    w0 = n["n"] / (2.0 * (n["n"] - n["n1"]))
    return df.withColumn("w", F.when(F.col(label) == 1, w1).otherwise(w0))


def _assembler(feats=FEATS):
    return VectorAssembler(inputCols=list(feats), outputCol="features")


def fit_ridge(train, C_inv=1.0, feats=FEATS):
    """L2 logistic regression (C = 1) with class-balanced weights on z-scored inputs.

    Spark's StandardScaler divides by the sample std; an ElementwiseProduct by
    sqrt(n / (n - 1)) turns that into the population std that the reference's
    scaler uses, so the penalised problem is the same."""
    import math
    from pyspark.ml.feature import ElementwiseProduct, StandardScaler
    from pyspark.ml.linalg import Vectors
    tw = balanced_weights(train)
    stats = tw.select(F.struct(F.sum("w").alias("sw"), F.count(F.lit(1)).alias("n"))).first()[0]
    sum_w, n = stats["sw"], stats["n"]
    factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    lr = LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="w", regParam=1.0 / (C_inv * sum_w),
                            elasticNetParam=0.0, standardization=False, maxIter=200)
    pipe = Pipeline(stages=[_assembler(feats),
                            StandardScaler(inputCol="features", outputCol="zs", withMean=True, withStd=True),
                            ElementwiseProduct(inputCol="zs", outputCol="scaled",
                                               scalingVec=Vectors.dense([factor] * len(feats))),
                            lr])
    return pipe.fit(tw)


#: fixed values: rounds, trees, depths, learning rate, shares of rows and columns, smallest leaf of the source's models
GBT = {"rounds": 300, "depth": 4, "rate": 0.05, "rows": 0.8, "columns": 0.8}
FOREST = {"trees": 500, "depth": 10}
MIN_LEAF = 50
#: rows beyond which a forest keeps no draws of each row
LARGE = 200_000


def sized(df, rows=50_000):
    """``df`` stored, in partitions of ``rows`` rows or, with more of them, one for each core: training reads it once per
    level, and each partition hands on the sums of all nodes, however few its rows."""
    d = stored(df, "training_rows")
    return d.repartition(max(1, min(-(-d.count() // rows), max(2, df.sparkSession.sparkContext.defaultParallelism))))


def fit_gbt(train, rounds=GBT["rounds"], feats=FEATS, min_leaf=1, weighted=True, validation=0.0, columns=GBT["columns"], reg=1.0,
            min_hessian=1.0):
    """Boosted trees with second-order steps, rows and columns drawn per tree. ``weighted``: label 1 weighs
    rows of label 0 per row of label 1. ``validation``: share of the rows held out to stop early."""
    return boosting.fit(train, feats, "label", rounds, GBT["depth"], GBT["rate"], GBT["rows"], columns, reg, min_hessian, min_leaf,
                        None if weighted else 1.0, validation)


def fit_rf(train, trees=FOREST["trees"], feats=FEATS, weighted=True):
    """Spark ML's forest; beyond LARGE rows it is grown by ``operators.forest``, where the binned rows fit into a task's memory."""
    feats = list(feats)
    bad = F.lit(False)
    for f in feats:
        bad = bad | F.col(f).isNull() | F.isnan(F.col(f).cast("double"))
    t = train.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n1"), F.count(F.when(bad | F.col("label").isNull(), 1)).alias("bad")).first()
    if t["n"] > LARGE and not t["bad"] and 0 < t["n1"] < t["n"]:  # else as Spark ML has it
        w = (t["n"] / (2.0 * (t["n"] - t["n1"])), t["n"] / (2.0 * t["n1"])) if weighted else (1.0, 1.0)
        model = forest.fit(train, feats, "label", trees, FOREST["depth"], MIN_LEAF, w)
        if model is not None:
            return model
    d = sized(balanced_weights(train) if weighted else train.withColumn("w", F.lit(1.0)))
    rf = RandomForestClassifier(labelCol="label", weightCol="w", numTrees=trees, maxDepth=FOREST["depth"],
                                featureSubsetStrategy="sqrt", minInstancesPerNode=MIN_LEAF, seed=42)
    return Pipeline(stages=[_assembler(feats), rf]).fit(d)


def model_metrics(pred, name, train_n):
    """AUC, average precision, precision at 50 and row counts of scored test rows (p1, label, id)."""
    pred = stored(pred.select("p1", "label", "id"), "scored_rows")  # the model scores once
    auc = M.roc_auc(pred, "p1", "label").first()
    ap = M.average_precision(pred, "p1", "label").first()
    top = M.precision_at_k(pred, "p1", "label", 50, ["id"]).first()
    return (name, auc["auc"], ap["average_precision"], top["precision_at_k"], int(train_n), int(auc["n_pos"] + auc["n_neg"]))


METRICS = "model string, auc double, average_precision double, precision_at_50 double, n_train long, n_test long"


def bank_model_metrics(spark, sf, name, fit):
    _, train, test = ml_frame(spark, sf)
    pred = prob1(fit(train).transform(test)).withColumn("id", F.struct("CERT", "REPDTE"))
    return rounded(spark.createDataFrame([model_metrics(pred, name, train.count())], METRICS))


def prob1(pred):
    """Scored rows with the probability of label 1 as p1 (boosted trees give it themselves)."""
    return pred if "p1" in pred.columns else pred.select("*", vector_to_array("probability")[1].alias("p1"))


@register("logit_ridge_balanced", section="M")
def q_logit_ridge_balanced(spark, sf):
    _, train, _ = ml_frame(spark, sf)
    model = fit_ridge(train)
    lr = model.stages[-1]
    rows = [(f, float(b)) for f, b in zip(FEATS, lr.coefficients.toArray())] + [("const", float(lr.intercept))]
    return spark.createDataFrame(rows, "term string, coef double")


@register("gbt_classifier", section="M")
def q_gbt_classifier(spark, sf):
    return bank_model_metrics(spark, sf, "gbt", fit_gbt)


@register("rf_classifier", section="M")
def q_rf_classifier(spark, sf):
    return bank_model_metrics(spark, sf, "rf", fit_rf)


def fit_platt(train, rounds=GBT["rounds"], folds=3):
    """Calibrated boosted trees: per hash fold a model of the other folds and a one-regressor
    logit of the label on its probability over the fold. Returns [(model, const, slope)]."""
    from multiprocessing.pool import ThreadPool
    from pyspark import inheritable_thread_target
    from lodestar.operators import glm
    train = train.withColumn("fold", F.pmod(F.xxhash64("CERT", "REPDTE", F.lit(42)), F.lit(folds)))

    def fold(k):
        m = fit_gbt(train.where(F.col("fold") != k), rounds)
        held = prob1(m.transform(train.where(F.col("fold") == k))).select("label", "p1")
        c = {r["term"]: r["coef"] for r in glm.logit(held, "label", ["p1"]).select("term", "coef").collect()}
        if c.get("const") is None or c.get("p1") is None:
            raise ValueError(f"no calibration for fold {k}: its labels are separated or constant")
        return m, c["const"], c["p1"]

    with ThreadPool(folds) as pool:  # a fold's small jobs leave cores idle
        return pool.map(inheritable_thread_target(train.sparkSession)(fold), range(folds))


def platt_probability(fits, df):
    """Mean of the fold models' calibrated probabilities, as column p_cal."""
    out = df.withColumn("p_cal", F.lit(0.0))
    names = out.columns
    for m, const, slope in fits:
        out = prob1(m.transform(out)).withColumn(
            "p_cal", F.col("p_cal") + 1 / (1 + F.exp(-(F.lit(const) + F.lit(slope) * F.col("p1")))) / len(fits)).select(*names)
    return out


@register("platt_calibrate", section="M")
def q_platt_calibrate(spark, sf):
    """Three-fold sigmoid calibration of the boosted trees, scored on the later period."""
    _, train, test = ml_frame(spark, sf)
    pred = platt_probability(fit_platt(train), test)
    return rounded(pred.agg(F.avg("p_cal").alias("mean_calibrated"), F.avg("label").alias("base_rate"),
                            F.count(F.lit(1)).alias("n")))


def split_allocation(counts: dict, test_size: float = 0.2) -> dict:
    """Train rows per class: n_train = n - ceil(test_size n), split by floor
    proportional shares plus largest remainders (ties by class) in integer arithmetic."""
    import math
    n = sum(counts.values())
    n_train = n - math.ceil(test_size * n)
    base = {c: (n_train * k) // n for c, k in counts.items()}
    rem = n_train - sum(base.values())
    order = sorted(counts, key=lambda c: (-((n_train * counts[c]) % n), c))
    for c in order[:rem]:
        base[c] += 1
    return base


@register("stratified_split", section="M", sql=SCORED_SQL + """
, c AS (SELECT label, count(*) AS n_c FROM s GROUP BY 1)
, t AS (SELECT sum(n_c) AS n, sum(n_c) - CAST(ceil(0.2 * sum(n_c)) AS BIGINT) AS n_train FROM c)
, a AS (SELECT label, n_c, (n_train * n_c) // n AS base, (n_train * n_c) % n AS r, n_train FROM c, t)
, b AS (SELECT *, row_number() OVER (ORDER BY r DESC, label) AS o,
               n_train - (SELECT sum(base) FROM a) AS rem FROM a)
, f2 AS (SELECT label, n_c, base + CASE WHEN o <= rem THEN 1 ELSE 0 END AS n_tr FROM b)
SELECT 'train' AS split, label, CAST(n_tr AS BIGINT) AS n FROM f2 WHERE n_tr > 0
UNION ALL SELECT 'test', label, CAST(n_c - n_tr AS BIGINT) FROM f2 WHERE n_c - n_tr > 0""")
def q_stratified_split(spark, sf):
    """80/20 split with exact per-class sizes: within each class the rows with the
    smallest seeded hash go to train, the cut being an exact distributed k-th
    order statistic (no global rank, no per-class sort in one task)."""
    df, _, _ = ml_frame(spark, sf)
    return split_rows(df, ["CERT", "REPDTE"]).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


def split_rows(df, ids, test_size=0.2):
    """``df`` (with a label) with a column split, train or test, stratified by label."""
    from lodestar.operators.quantiles import kth_smallest
    d = df.withColumn("u", F.xxhash64(*ids, F.lit(42)))
    counts = {r["label"]: r["n"] for r in d.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # classes
    alloc = split_allocation(counts, test_size)
    ranks = df.sparkSession.createDataFrame([(int(c), int(t) - 1) for c, t in alloc.items() if t > 0], "label int, k long")
    cuts = {r["label"]: r["value"] for r in kth_smallest(d.select("label", "u"), "u", ["label"], ranks).collect()}  # classes
    train = F.lit(False)
    for c, v in cuts.items():
        train = train | ((F.col("label") == c) & (F.col("u") <= v))
    return d.withColumn("split", F.when(train, "train").otherwise("test")).drop("u")


def application_split(spark, sf):
    """Complete-case applications with all features, stored, and the stratified split."""
    from lodestar.plans.scalars import prep
    feats = [*C.CREDIT_FEATURES, *C.RACE_FEATURES]
    df = prep(spark, sf).select("app_id", F.col("approved").cast("int").alias("label"),
                                *[F.col(c).cast("double").alias(c) for c in feats]).dropna()
    d = split_rows(stored(df, "application_rows"), ["app_id"])
    return d, d.where("split = 'train'"), d.where("split = 'test'"), feats


def fit_application_gbt(train, feats, rounds=GBT["rounds"]):
    return fit_gbt(train, rounds, feats, min_leaf=MIN_LEAF, weighted=False, validation=0.1, columns=1.0, reg=0.0, min_hessian=0.0)


@register("model_counterfactual", section="M")
def q_model_counterfactual(spark, sf):
    """Excess denials of protected test applicants: predictions of the boosted trees with
    the protected flag set to 0, minus those as they are; the model is fitted on the
    training rows. Both predictions are made in one pass over a row."""
    _, train, test, feats = application_split(spark, sf)
    model = fit_application_gbt(train, feats)
    both = test.where("is_black = 1").select("*", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("flag")) \
        .withColumn("is_black", F.col("flag"))
    p = prob1(model.transform(both))
    sign = F.when(F.col("flag") == 0, F.col("p1")).otherwise(-F.col("p1"))
    row = p.agg(F.sum(sign).alias("total_excess"), F.countDistinct("app_id").alias("n")).first()
    n = row["n"]
    return rounded(spark.createDataFrame([(row["total_excess"], row["total_excess"] / n if n else None, n)],
                                         "total_excess double, mean_excess double, n long"))


@register("model_comparison", section="M")
def q_model_comparison(spark, sf):
    """Logit, boosted trees and forest on applications: stratified 80/20 split, AUC, average
    precision, precision at 50, sizes, and for the logit the protected odds ratio."""
    from lodestar.operators import glm
    _, train, test, feats = application_split(spark, sf)
    fit = {r["term"]: r for r in glm.logit(train, "label", feats).collect()}
    z = F.lit(fit["const"]["coef"])
    for f in feats:
        z = z + F.lit(fit[f]["coef"] or 0.0) * F.col(f)
    preds = {"logit": test.withColumn("p1", 1 / (1 + F.exp(-z))),
             "gbt": prob1(fit_application_gbt(train, feats).transform(test)),
             "rf": prob1(fit_rf(train, feats=feats, weighted=False).transform(test))}
    n = train.count()
    rows = [model_metrics(p.withColumn("id", F.col("app_id")), name, n) for name, p in preds.items()]
    spread = max(r[1] for r in rows) - min(r[1] for r in rows)
    b = fit["is_black"]
    odds = {"logit": (b["odds_ratio"], b["or_lo"], b["or_hi"], b["p"])}
    return rounded(spark.createDataFrame(
        [(*r, *odds.get(r[0], (None,) * 4), spread) for r in rows],
        METRICS + ", protected_or double, or_lo double, or_hi double, p double, auc_range double"))


@register("early_warning_watchlist", section="Q")
def q_early_warning_watchlist(spark, sf):
    """Fitted ridge model scores the latest quarter; top 25 (complete cases, clipped)."""
    df, train, _ = ml_frame(spark, sf)
    model = fit_ridge(train)
    latest = df.where(F.col("REPDTE") == df.select(F.max("REPDTE")).scalar())
    pred = prob1(model.transform(latest))
    return rounded(pred.select("CERT", "STNAME", "CITY", F.col("p1").alias("distress_prob"), "texas_ratio",
                               "tier1_leverage", "cre_ratio")
                   .orderBy(F.col("distress_prob").desc(), "CERT").limit(25))


@register("tree_attribution", section="M")
def q_tree_attribution(spark, sf):
    """Mean |SHAP| per feature for the boosted-tree early-warning model over every
    complete bank-quarter, ranked, with the mean among positive-label rows."""
    from lodestar.operators import attribution as AT
    from pyspark.sql import Window
    df, train, _ = ml_frame(spark, sf)
    model = fit_gbt(train)
    long, base = AT.shap_values(df, FEATS, model, ["CERT", "REPDTE", "label"])
    imp = AT.mean_abs_shap(long, "label")
    w = Window.orderBy(F.col("mean_abs_shap").desc(), "feature")  # one row per feature (11 rows)
    return rounded(imp.select("*", F.row_number().over(w).alias("rank"), F.lit(base).alias("base_value")))
