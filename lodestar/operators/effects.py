"""Logit with one effect for each level of a key, however many levels there are.

The level block of the Hessian is diagonal, so a Newton step needs no dummy
columns: per level the sums of w, w x, r (and of w x x', r x) are one partial
aggregation; eliminating the levels (a Schur complement) leaves a k x k system for the
regressors, and each level's own step follows from its sums. Level effects stay in a
table that is joined to the rows again; the driver sees k x k numbers a step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from lodestar.operators import glm
from lodestar.session import discard, stored


def logit_absorbed(df: DataFrame, y: str, xs: Sequence[str], level: str, max_iter: int = 30, tol: float = 1e-12) -> DataFrame:
    """Coefficients of ``xs`` in a logit of ``y`` with an effect for each ``level``; columns as ``glm.logit`` has them.

    Rows with a null take no part, nor do levels whose outcomes are all equal: their effect has no finite estimate, and they
    say nothing of the others. Regressors that the levels and the ones before them explain have NULL estimates. Equal to the fit
    with a dummy for each level but one; r2 is against a common rate. Runs a job per step."""
    xs, spark = list(xs), df.sparkSession
    k = len(xs)
    rows = df.select(F.col(level).cast("string").alias("_l"), F.col(y).cast("double").alias("_y"),
                     *[F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)]).dropna().persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rate = F.avg("_y")
        effects = stored(rows.groupBy("_l").agg(F.log(rate / (1 - rate)).alias("_a"), rate.alias("_r"), F.count(F.lit(1)).alias("_n"))
                         .where("_r > 0 AND _r < 1").select("_l", "_a", "_n", (F.col("_r") * F.col("_n")).alias("_s")), "effects")
        t = effects.agg(F.sum("_n").alias("n"), F.sum("_s").alias("s")).first()
        n = int(t["n"] or 0)
        if not n:
            return glm._to_df(spark, glm._coef_rows((), xs, None, None, 0, None, False), rows, [])
        share = t["s"] / n
        null = n * (share * math.log(share) + (1 - share) * math.log(1 - share))
        effects = effects.select("_l", "_a")
        beta, mask, se, like, done = np.zeros(k), None, np.full(k, np.nan), None, False
        x = [F.col(f"_x{i}") for i in range(k)]
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        for _ in range(max_iter):
            eta = F.col("_a")
            for i in range(k):
                eta = eta + F.lit(float(beta[i])) * x[i]
            one = rows.join(effects, "_l").withColumn("_e", eta).withColumn("_p", 1 / (1 + F.exp(-F.col("_e"))))
            one = one.withColumn("_w", F.col("_p") * (1 - F.col("_p"))).withColumn("_d", F.col("_y") - F.col("_p"))
            w, d = F.col("_w"), F.col("_d")
            per = stored(one.groupBy("_l", "_a").agg(
                F.sum(w).alias("A"), F.sum(d).alias("R"), F.sum(F.col("_y") * F.col("_e") - F.greatest(F.col("_e"), F.lit(0.0))
                                                                  - F.log1p(F.exp(-F.abs("_e")))).alias("L"),
                *[F.sum(w * x[i]).alias(f"B{i}") for i in range(k)], *[F.sum(d * x[i]).alias(f"G{i}") for i in range(k)],
                *[F.sum(w * x[i] * x[j]).alias(f"C{i}_{j}") for i, j in pairs]), "level-sums")
            b = [F.col(f"B{i}") for i in range(k)]
            v = per.agg(F.sum("L").alias("L"), F.sum(F.col("R") * F.col("R") / F.col("A")).alias("own"),
                        *[F.sum(F.col(f"G{i}") - b[i] * F.col("R") / F.col("A")).alias(f"g{i}") for i in range(k)],
                        *[F.sum(F.col(f"C{i}_{j}") - b[i] * b[j] / F.col("A")).alias(f"h{i}_{j}") for i, j in pairs],
                        *[F.sum(f"C{i}_{i}").alias(f"c{i}") for i in range(k)]).first()
            H = np.zeros((k, k))
            for i, j in pairs:
                H[i, j] = H[j, i] = v[f"h{i}_{j}"]
            g = np.array([v[f"g{i}"] for i in range(k)])
            if mask is None:  # within the levels; what is left of a column by rounding alone is nothing
                within = np.array([H[i, i] > 1e-12 * v[f"c{i}"] for i in range(k)])
                mask = np.zeros(k, bool)
                mask[np.flatnonzero(within)[glm.independent(H[np.ix_(within, within)])]] = True
            inv = glm._scaled_inverse(H[np.ix_(mask, mask)]) if mask.any() else np.zeros((0, 0))
            step = np.zeros(k)
            step[mask] = inv @ g[mask]
            fall = float(g @ step) + v["own"]
            if not math.isfinite(fall) or not np.isfinite(step).all():
                break
            like, se = v["L"], np.full(k, np.nan)
            se[mask] = np.sqrt(np.diag(inv))
            beta = beta + step
            old = effects
            effects = stored(per.select("_l", (F.col("_a") + (F.col("R") - sum((F.lit(float(s)) * c for s, c in zip(step, b)), F.lit(0.0)))
                                                 / F.col("A")).alias("_a")), "effects")
            discard(old, per)
            if fall < tol * max(1.0, n * 1e-3):
                done = True
                break
        discard(effects)
        found = np.where(mask, beta, np.nan) if done else None
        r2 = 1 - like / null if done and null else None
        return glm._to_df(spark, glm._coef_rows((), xs, found, se if done else None, n, r2, done), rows, [])
    finally:
        rows.unpersist()
