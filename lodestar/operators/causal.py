"""Causal-design operators built on the grouped GLM engine.

Fixed effects with few levels are materialised as dummies (levels are a
checked, small driver-side list); large fixed-effect sets should be absorbed
with ``windows.within_demean`` instead.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from lodestar.operators import frames, glm


def did_twfe(panel: DataFrame, y: str, treat: str, post: str, entity: str, period: str,
             cov_type: str = "HC3") -> DataFrame:
    """y ~ treat x post + entity FE + period FE (dummies, first level dropped), HC3."""
    df = panel.withColumn("treat_post", (F.col(treat) * F.col(post)).cast("double"))
    df, e_names = frames.one_hot_drop_first(df, entity, prefix="fe_e")
    df, p_names = frames.one_hot_drop_first(df, period, prefix="fe_t")
    fit = glm.ols(df, y, ["treat_post", *e_names, *p_names], cov_type=cov_type)
    return glm.term(fit, "treat_post").select(
        "term", "coef", "se", "p", "ci_lo", "ci_hi", "n",
        ((F.exp("coef") - 1) * 100).alias("implied_pct"))


def absorb_fixed_effects(df: DataFrame, cols: Sequence[str], fes: Sequence[str], keep: Sequence[str] = (),
                         max_iter: int = 500, tol: float = 1e-10, checkpoint_every: int = 5) -> DataFrame:
    """Alternating projections: subtract group means of ``cols`` for each fixed
    effect in turn until every group mean is below ``tol`` (Frisch-Waugh-Lovell:
    OLS on the result equals the dummy-variable fit, without dummy columns).

    Each sweep is partial-aggregated ``groupBy`` + join back; the lineage is cut
    with a reliable ``checkpoint()`` (shared checkpoint folder) every few sweeps.
    Convergence is linear and can take many sweeps on unbalanced panels; prefer
    absorbing one effect and keeping the smaller one as dummies when it is bounded."""
    fes, cols = list(fes), list(cols)
    cur = df.select(*dict.fromkeys([*keep, *fes]), *[F.col(c).cast("double").alias(c) for c in cols])
    for it in range(1, max_iter + 1):
        for fe in fes:
            means = cur.groupBy(fe).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
            cur = cur.join(means, fe).select(*[x for x in cur.columns if x not in cols],
                                             *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in cols])
        if it % checkpoint_every and it != 1:
            continue
        if it > 1:
            cur = cur.checkpoint(eager=True)
        # after a sweep the last effect's means are 0; check the others
        worst = 0.0
        for fe in fes[:-1]:
            m = cur.groupBy(fe).agg(F.greatest(*[F.abs(F.avg(c)) for c in cols], F.lit(0.0)).alias("_a"))
            worst = max(worst, m.select(F.max("_a")).first()[0] or 0.0)
        if worst < tol:
            break
    return cur


def did_twfe_absorbed(panel: DataFrame, y: str, treat: str, post: str, entity: str, period: str) -> DataFrame:
    """TWFE DiD without entity dummies, errors clustered by entity with the degrees
    of freedom of the dummy-variable model.

    The larger effect is absorbed exactly by within-demeaning (one partial
    aggregation + join); the smaller one (usually the calendar) enters as
    demeaned dummies, so no iteration is needed. For two large effects see
    ``absorb_fixed_effects``."""
    from lodestar.operators import windows as W
    df = panel.withColumn("treat_post", (F.col(treat) * F.col(post)).cast("double"))
    n_e = df.select(F.countDistinct(entity)).first()[0]
    n_t = df.select(F.countDistinct(period)).first()[0]
    big, small = (entity, period) if n_e >= n_t else (period, entity)
    df, names = frames.one_hot_drop_first(df, small, prefix="fe_s")
    d = W.within_demean(df, [y, "treat_post", *names], big)
    xs = ["treat_post_dm", *[f"{c}_dm" for c in names]]
    fit = glm.ols(d, f"{y}_dm", xs, intercept=False, cov_type="cluster", cluster=entity, absorbed_params=max(n_e, n_t))
    out = glm.term(fit, "treat_post_dm").withColumn("term", F.lit("treat_post"))
    return out.select("term", "coef", "se", "p", "ci_lo", "ci_hi", "n",
                      ((F.exp("coef") - 1) * 100).alias("implied_pct"))


def saturated_terms(df: DataFrame, flags: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """All products of the binary flags (main effects and every interaction)."""
    from itertools import combinations
    cols = []
    names = list(flags)
    for r in range(2, len(flags) + 1):
        for combo in combinations(flags, r):
            n = "_x_".join(combo)
            e = F.lit(1.0)
            for c in combo:
                e = e * F.col(c)
            cols.append(e.cast("double").alias(n))
            names.append(n)
    return df.select("*", *cols), names


def did_triple(df: DataFrame, y: str, a: str, b: str, c: str, by: Sequence[str] = (),
               cov_type: str = "HC3") -> DataFrame:
    """Saturated triple-difference LPM; returns the a x b x c coefficient."""
    d, names = saturated_terms(df, [a, b, c])
    fit = glm.ols(d, y, names, by=by, cov_type=cov_type)
    return glm.term(fit, f"{a}_x_{b}_x_{c}")


def event_study(df: DataFrame, y: str, group: str, treat: str, period: str, ref_period, controls: Sequence[str] = (),
                cov_type: str = "HC3", model: str = "lpm") -> DataFrame:
    """group x treat x period interactions relative to ``ref_period``, for every period of the data."""
    periods = sorted(int(p) for p in frames.levels(df, period))
    d = df
    cols = []
    for t in periods:
        if t == ref_period:
            continue
        cols.append((F.col(period) == F.lit(t)).cast("double").alias(f"p_{t}"))
    d = d.select("*", *cols)
    xs = [group, treat, f"{group}_x_{treat}", *controls]
    d = d.withColumn(f"{group}_x_{treat}", (F.col(group) * F.col(treat)).cast("double"))
    inter = []
    for t in periods:
        if t == ref_period:
            continue
        d = d.withColumn(f"{group}_x_p_{t}", F.col(group) * F.col(f"p_{t}")) \
             .withColumn(f"{treat}_x_p_{t}", F.col(treat) * F.col(f"p_{t}")) \
             .withColumn(f"ddd_{t}", F.col(group) * F.col(treat) * F.col(f"p_{t}"))
        xs += [f"p_{t}", f"{group}_x_p_{t}", f"{treat}_x_p_{t}", f"ddd_{t}"]
        inter.append(f"ddd_{t}")
    fit = glm.ols(d, y, xs, cov_type=cov_type) if model == "lpm" else glm.logit(d, y, xs)
    out = fit.where(F.col("term").startswith("ddd_"))
    return out.select(F.regexp_extract("term", r"ddd_(.*)", 1).cast("int").alias(period), "coef", "se", "p",
                      "ci_lo", "ci_hi", F.exp("coef").alias("odds_ratio"))


def pretrend_test(es: DataFrame, period: str, first_post) -> DataFrame:
    pre = es.where(F.col(period) < F.lit(first_post))
    return pre.agg(F.bool_and(F.col("p") > 0.05).alias("all_pre_insignificant"),
                   F.max(F.abs(F.col("odds_ratio") - 1)).alias("max_abs_or_dev")).select(
        "*", F.when(F.col("all_pre_insignificant"), "PASS").otherwise("MIXED").alias("verdict"))


def oster_delta(b_u: float, b_c: float, r_u: float, r_c: float, rmax_mult: float) -> float | None:
    rmax = min(rmax_mult * r_c, 0.99)
    den = (b_u - b_c) * (r_c - r_u)
    if abs(den) < 1e-10:
        return None
    return b_c * (rmax - r_c) / den


# ---------------------------------------------------------------- placebo permutation

_GOLDEN = 0x9E3779B97F4A7C15


def _draw_hash(h: np.ndarray, draw: int) -> np.ndarray:
    """63 bits that order the rows anew for each draw (splitmix64 of the row's hash)."""
    z = h.view(np.uint64) + np.uint64((draw + 1) * _GOLDEN & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def placebo_cuts(design: DataFrame, n: int, m: int, n_draws: int, width: float = 6.0) -> np.ndarray:
    """Per draw the m-th smallest of the n rows' draw hashes.

    The hashes are uniform, so rank m lies within a few standard deviations of
    m / n: one pass counts the rows below that bracket and emits those inside
    (about 2 * width * sqrt(n) / 2 per draw), which Spark ranks per draw. Draws
    whose bracket misses are ranked over all rows."""
    from pyspark.sql import Window
    whole = float(1 << 63)

    def cuts(draws: list[int], lo: int, hi: int) -> dict[int, int]:
        def batch(draw, z, below):
            return pa.RecordBatch.from_arrays([pa.array(draw, pa.int32()), pa.array(z, pa.int64()), pa.array(below, pa.int64())], ["draw", "z", "below"])

        def fn(it):
            below = np.zeros(len(draws), np.int64)
            for b in it:
                h, inside = b.column(0).to_numpy(), []
                for i, d in enumerate(draws):
                    z = _draw_hash(h, d)
                    z = z[z <= hi]
                    keep = z >= lo
                    below[i] += len(z) - int(keep.sum())
                    inside.append(z[keep])
                z = np.concatenate(inside)
                yield batch(np.repeat(draws, [len(x) for x in inside]), z, np.zeros(len(z), np.int64))
            yield batch(draws, np.full(len(draws), -1), below)

        rows = design.select("_h").mapInArrow(fn, "draw int, z long, below long")
        under = rows.where("z < 0").groupBy("draw").agg(F.sum("below").alias("u"))
        rank = F.row_number().over(Window.partitionBy("draw").orderBy("z"))
        found = rows.where("z >= 0").withColumn("r", rank).join(under, "draw").where(F.col("r") + F.col("u") == m)
        return {r["draw"]: r["z"] for r in found.select("draw", "z").collect()}  # one number per draw

    c = m / n
    w = width * math.sqrt(max(c * (1 - c), 1.0 / n) / n) + 2.0 / n
    got = cuts(list(range(n_draws)), int(max(0.0, c - w) * whole), min((1 << 63) - 1, int(min(1.0, c + w) * whole)))
    missed = [d for d in range(n_draws) if d not in got]
    if missed:
        got |= cuts(missed, 0, (1 << 63) - 1)
    return np.array([got[d] for d in range(n_draws)], np.int64)


#: rows whose products with all draws are formed at once; Newton steps at most; draws solved together; rows that a start is fitted on
PLACEBO_ROWS, PLACEBO_STEPS, PLACEBO_BLOCK, PLACEBO_START = 512, 25, 64, 20_000


def _placebo_sums(coefs: np.ndarray, live: np.ndarray):
    """A task's sums for one Newton step of the live draws, a row for each PLACEBO_BLOCK of them: the fixed columns' part of the
    Hessian (upper triangle), its flag column, and the gradient. The products of the fixed columns are formed once for a
    block of rows and weighted for all draws by one matrix product."""
    fixed = len(coefs) - 1
    upper = np.triu_indices(fixed)
    every = len(live) == live[-1] + 1

    def fn(batches):
        total = np.zeros((len(upper[0]) + 2 * fixed + 2, len(live)))
        parts = np.split(total, np.cumsum([len(upper[0]), fixed, 1, fixed]))
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns[:-1]]
            flags = np.frombuffer(b"".join(batch.columns[-1].to_pylist()), np.uint8).reshape(len(cols[0]), -1)
            for lo in range(0, len(flags), PLACEBO_ROWS):
                y, *x = (c[lo:lo + PLACEBO_ROWS] for c in cols)
                X = np.column_stack([np.ones(len(y)), *x])
                Z = np.unpackbits(flags[lo:lo + PLACEBO_ROWS], axis=1, count=int(live[-1]) + 1)
                Z = (Z if every else Z[:, live]).astype(np.float64)
                mu = Z * (coefs[fixed] / 2)
                mu += X @ (coefs[:fixed] / 2)
                np.tanh(mu, out=mu)
                mu += 1
                mu /= 2
                w = mu * (1 - mu)
                np.subtract(y[:, None], mu, out=mu)  # residuals
                parts[0] += (X[:, upper[0]] * X[:, upper[1]]).T @ w
                parts[3] += X.T @ mu
                parts[4] += np.einsum("ij,ij->j", mu, Z)
                w *= Z
                parts[1] += X.T @ w
                parts[2] += w.sum(axis=0)
        begin = np.arange(0, len(live), PLACEBO_BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(begin, pa.int32()), pa.array(np.full(len(begin), TaskContext.get().partitionId()), pa.int32()), pa.array(
            [total[:, i:i + PLACEBO_BLOCK].ravel() for i in begin], pa.list_(pa.float64()))], ["block", "task", "vec"])
    return fn


def _placebo_step(fixed: int, live: np.ndarray):
    """Newton steps of a block of draws from the tasks' sums: (draw, decrement, information on the flag, step)."""
    q = fixed * (fixed + 1) // 2

    def solve(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("task").combine_chunks()
        v = rows["vec"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).sum(axis=0).reshape(q + 2 * fixed + 2, -1)
        n = v.shape[1]
        H = np.zeros((n, fixed + 1, fixed + 1))
        i, j = np.triu_indices(fixed)
        H[:, i, j] = H[:, j, i] = v[:q].T
        H[:, :fixed, fixed] = H[:, fixed, :fixed] = v[q:q + fixed].T
        H[:, fixed, fixed] = v[q + fixed]
        g = v[q + fixed + 1:].T
        d = np.sqrt(np.maximum(np.einsum("kii->ki", H), 1e-300))
        H /= d[:, :, None] * d[:, None, :]
        out = np.full((n, fixed + 3), np.nan)
        for k in range(n):
            try:
                inv = np.linalg.inv(H[k]) / np.outer(d[k], d[k])
                step = inv @ g[k]
                out[k] = g[k] @ step, 1 / inv[fixed, fixed], *step
            except np.linalg.LinAlgError:
                pass
        begin = rows["block"][0].as_py()
        return pa.table({"draw": pa.array(live[begin:begin + n], pa.int32()), "out": pa.array(list(out), pa.list_(pa.float64()))})
    return solve


def _start(X: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps on a sample, as far as they go: a start for the fits on all rows."""
    b = np.zeros(X.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-X @ b))
        step = np.linalg.lstsq((X * (p * (1 - p))[:, None]).T @ X, X.T @ (y - p), rcond=None)[0]
        if not np.isfinite(step).all() or np.abs(X @ (b + step)).max() > 15:
            break
        b = b + step
    return b


def placebo_permutation(df: DataFrame, y: str, xs: Sequence[str], flag: str, key: str, n_draws: int = 500,
                        seed: int = 42, actual: bool = False) -> DataFrame:
    """Refit the logit n_draws times with the 0/1 flag permuted over all rows; one row per draw
    (and with ``actual`` one for the flag as it is, as draw -1).

    A permuted flag is a random set of as many rows as the flag marks: those
    with the smallest draw hashes of ``key``. It depends on neither partitions
    nor row order, margins are kept exactly (rows that share a key share its
    hash), and the rows are read batch by batch, never copied per draw: a row carries its flags of all draws as bits. All draws
    take a Newton step in one pass over the rows, as matrix products, starting from a fit without the flag (on a bounded
    sample by hash: it is where they start only). Terms that the ones before them explain are left out; a draw that
    separates the outcomes gives nulls."""
    spark = df.sparkSession
    fixed = [x for x in xs if x != flag]
    design = (df.select(F.xxhash64(F.col(key), F.lit(seed)).alias("_h"), F.col(y).cast("double").alias(y),
                        *[F.col(x).cast("double").alias(x) for x in [*fixed, flag]]).dropna()
              .repartition(spark.sparkContext.defaultParallelism, "_h").persist(StorageLevel.MEMORY_AND_DISK))

    def gram(batches):
        total, bad, k = np.zeros((len(fixed) + 2,) * 2), 0, len(fixed) + 1
        for b in batches:
            X = np.column_stack([np.ones(b.num_rows), *(c.to_numpy() for c in b.columns)])
            bad += int((~np.isin(X[:, k], (0.0, 1.0))).sum())
            total += X.T @ X
        yield pa.RecordBatch.from_arrays([pa.array([[*total.ravel(), bad]], pa.list_(pa.float64()))], ["vec"])

    marked = None
    try:
        sums = glm._sum_partials(design.select(*fixed, flag).mapInArrow(gram, "vec array<double>"), [])[()]
        XX = sums[:-1].reshape(len(fixed) + 2, -1)
        n, m = int(XX[0, 0]), int(XX[0, -1])
        if sums[-1]:
            raise ValueError(f"{flag} must be a 0/1 flag")
        done: dict[int, tuple] = {}
        if 0 < m < n:
            mask = glm.independent(XX[:-1, :-1])
            terms = [x for x, ok in zip(fixed, mask[1:]) if ok]
            cuts = placebo_cuts(design, n, m, n_draws)
            few = design.where(F.pmod("_h", F.lit(1 << 30)) <= int(min(1.0, PLACEBO_START / n) * (1 << 30))).select(y, *terms).toArrow()
            cols = [c.to_numpy() for c in few.columns]
            k = len(terms) + 1
            base = _start(np.column_stack([np.ones(few.num_rows), *cols[1:]]), cols[0])

            def mark(batches):
                for batch in batches:
                    h = batch.column(0).to_numpy()
                    on = np.empty((len(h), n_draws + 1), bool)
                    on[:, 0] = batch.column(1).to_numpy() == 1
                    for d in range(n_draws):
                        on[:, d + 1] = _draw_hash(h, d) <= cuts[d]
                    flags = pa.array([r.tobytes() for r in np.packbits(on, axis=1)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*batch.columns[2:], flags], [*batch.schema.names[2:], "_flags"])

            kinds = ", ".join(f"`{c}` double" for c in (y, *terms)) + ", _flags binary"
            marked = design.select("_h", flag, y, *terms).mapInArrow(mark, kinds).persist(StorageLevel.MEMORY_AND_DISK)
            live = np.arange(0 if actual else 1, n_draws + 1)
            coefs = np.repeat(np.append(base, 0.0)[:, None], n_draws + 1, axis=1)
            before, last = np.full(n_draws + 1, np.inf), np.zeros_like(coefs)
            for _ in range(PLACEBO_STEPS):
                got = marked.mapInArrow(_placebo_sums(coefs[:, live], live), "block int, task int, vec array<double>") \
                    .groupBy("block").applyInArrow(_placebo_step(k, live), "draw int, out array<double>").collect()  # a short row a draw
                for r in got:
                    d, (fall, info, *step) = r["draw"], r["out"]
                    if not np.isfinite([fall, info, *step]).all():
                        done[d] = (None, None)
                    elif fall > 4 * before[d]:  # too far: back by half
                        last[:, d] /= 2
                        coefs[:, d] -= last[:, d]
                    else:
                        before[d], last[:, d] = fall, step
                        coefs[:, d] += step
                        if fall < 1e-12:
                            separate = info < glm.SEPARATION_CUT * m * (1 - m / n)
                            done[d] = (None, None) if separate else (float(coefs[k, d]), 1 / math.sqrt(info))
                live = np.array([d for d in live if d not in done])
                if not len(live):
                    break
        rows = [(d - 1, c, None if c is None else math.exp(c), se) for d in range(0 if actual else 1, n_draws + 1)
                for c, se in [done.get(d, (None, None))]]
        return spark.createDataFrame(rows, "draw int, coef double, odds_ratio double, se double")
    finally:
        design.unpersist()
        if marked is not None:
            marked.unpersist()


def placebo_summary(draws: DataFrame, actual_coef: float) -> DataFrame:
    """Spread of the draws; p_value: share of draws whose odds ratio is at most the actual
    one; p_two_sided: share at least as far from 1 in log odds. Failed draws don't count."""
    from lodestar.operators.quantiles import with_quantiles
    draws = draws.where(F.col("coef").isNotNull())
    agg = draws.agg(F.count(F.lit(1)).alias("n_draws"), F.avg("odds_ratio").alias("mean_or"),
                    F.stddev_pop("coef").alias("sd_coef"),
                    F.avg((F.col("coef") <= actual_coef).cast("int")).alias("p_value"),
                    F.avg((F.abs("coef") >= abs(actual_coef)).cast("int")).alias("p_two_sided"))
    return with_quantiles(agg, draws, [], [("odds_ratio", 0.025, "or_p2_5"), ("odds_ratio", 0.975, "or_p97_5")])


# ---------------------------------------------------------------- synthetic control

def _simplex_ls(A: np.ndarray, b: np.ndarray, iters: int = 5000) -> np.ndarray:
    """min ||A w - b||^2 s.t. w >= 0, sum w = 1 by projected gradient."""
    m = A.shape[1]
    w = np.full(m, 1.0 / m)
    L = np.linalg.norm(A, 2) ** 2 + 1e-12
    for _ in range(iters):
        g = A.T @ (A @ w - b)
        v = w - g / L
        u = np.sort(v)[::-1]
        css = np.cumsum(u)
        rho = np.nonzero(u * np.arange(1, m + 1) > (css - 1))[0][-1]
        theta = (css[rho] - 1) / (rho + 1.0)
        w_new = np.maximum(v - theta, 0)
        if np.max(np.abs(w_new - w)) < 1e-12:
            w = w_new
            break
        w = w_new
    return w


MAX_SYNTH_UNITS = 5_000


def synthetic_control(panel: DataFrame, unit: str, period: str, value: str, treat_period,
                      treated_units: Sequence[str]) -> DataFrame:
    """Donor weights on the simplex fit on the pre-period, one ``applyInPandas``
    group per treated unit (all units in turn: placebo in space).

    The panel is already aggregated (unit x period), so each group holds
    periods x units numbers; the unit list is a checked, bounded level list."""
    units = frames.levels(panel, unit, MAX_SYNTH_UNITS)
    treated = list(treated_units)
    wide = panel.groupBy(period).pivot(unit, units).agg(F.first(value))
    long = wide.select(period, F.explode(F.array(*[F.lit(u) for u in treated])).alias("treated_unit"),
                       F.array(*[F.col(f"`{u}`").cast("double") for u in units]).alias("vals"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        tu = pdf["treated_unit"].iloc[0]
        pdf = pdf.sort_values(period)
        V = np.array([[np.nan if v is None else float(v) for v in row] for row in pdf["vals"]], dtype=float)
        i = units.index(tu)
        pre = (pdf[period] < treat_period).to_numpy()
        donors = [j for j in range(len(units)) if j != i]
        A, b = V[pre][:, donors], V[pre][:, i]
        ok = ~np.isnan(A).any(axis=1) & ~np.isnan(b)
        w = _simplex_ls(A[ok], b[ok])
        return pd.DataFrame({"treated_unit": tu, "donor": [units[j] for j in donors], "weight": w,
                             "pre_sse": float(np.sum((A[ok] @ w - b[ok]) ** 2))})

    return long.groupBy("treated_unit").applyInPandas(
        fit, "treated_unit string, donor string, weight double, pre_sse double")


def synthetic_gap(panel: DataFrame, weights: DataFrame, unit: str, period: str, value: str) -> DataFrame:
    """Treated minus synthetic outcome per period (weights joined to donor series)."""
    donors = weights.join(panel.select(F.col(unit).alias("donor"), period, F.col(value).alias("_dv")), "donor")
    synth = donors.groupBy("treated_unit", period).agg(F.sum(F.col("weight") * F.col("_dv")).alias("synthetic"))
    actual = panel.select(F.col(unit).alias("treated_unit"), period, F.col(value).alias("actual"))
    return actual.join(synth, ["treated_unit", period]).select(
        "treated_unit", period, "actual", "synthetic", (F.col("actual") - F.col("synthetic")).alias("gap"))
