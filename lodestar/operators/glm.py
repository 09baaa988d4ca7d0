"""Grouped linear and logistic models with inference, fitted for many groups at once.

Execution model
---------------
* The design (group keys, y, x's) is one lazy DataFrame, persisted once.
* Every pass is a single Spark job: ``mapInPandas`` accumulates, per input
  partition and per group, the sufficient statistics in numpy and emits ONE
  flat ``array<double>`` per (partition, group). ``posexplode`` +
  ``groupBy(group, pos).sum`` tree-reduces those partials across the cluster,
  so a hot group (even a third of all rows) is spread over every task that
  holds its rows; a last grouped step assembles a group's vector, checks its
  rank and solves it on the executors. The driver gets one short row per group
  (n, log-likelihood, Newton step, standard errors), after a check of the
  number of groups; betas travel back to executors in the task closure.
* Rank: columns are taken in order, on their own scale; one that the earlier
  ones explain (a constant column of a group, an aliased term) gets a NULL
  estimate and the others are fitted without it.
* Logit: Newton-Raphson with step halving, stopped by the size of the step in
  units of the linear predictor (scale-free). Separation shows as information
  that vanishes relative to the design's own, whatever the scale of the
  coefficients, and yields NULL estimates for the group, never exceptions.
* OLS: one Gram pass, then a pass of residual sums at the estimates (with the
  leverage-weighted meat for HC3); cluster-robust adds a pass of per-cluster
  score sums (grouped by cluster in Spark, then the outer products summed per
  group in Spark).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

Z975 = 1.959963984540054
MAX_GROUPS_IN_CLOSURE = 200_000

COEF_SCHEMA_FIELDS = [("term", "string"), ("coef", "double"), ("se", "double"), ("stat", "double"),
                      ("p", "double"), ("ci_lo", "double"), ("ci_hi", "double"), ("odds_ratio", "double"),
                      ("or_lo", "double"), ("or_hi", "double"), ("n", "long"), ("r2", "double"),
                      ("converged", "boolean")]


# ---------------------------------------------------------------- distributions

def norm_sf2(z: float) -> float:
    """Two-sided normal p-value."""
    return math.erfc(abs(z) / math.sqrt(2.0)) if z is not None and math.isfinite(z) else float("nan")


def _betacf(a, b, x, itmax=300, eps=3e-16):
    fpmin = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > fpmin else fpmin)
    h = d
    for m in range(1, itmax + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > fpmin else fpmin)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > fpmin else fpmin
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > fpmin else fpmin)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > fpmin else fpmin
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
    bt = math.exp(lbt)
    if x < (a + 1) / (a + b + 2):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, 1 - x) / b


def t_sf2(t: float, df: float) -> float:
    """Two-sided Student-t p-value."""
    if t is None or not math.isfinite(t) or df <= 0:
        return float("nan")
    return betainc_reg(df / 2.0, 0.5, df / (df + t * t))


def t_ppf975(df: float) -> float:
    """97.5 % t quantile by bisection on the survival function."""
    if df > 1e6:
        return Z975
    lo, hi = 0.0, 50.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if t_sf2(mid, df) > 0.05:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


# ---------------------------------------------------------------- executor-side accumulation

def _design(pdf: pd.DataFrame, xs: Sequence[str], intercept: bool) -> np.ndarray:
    X = pdf[list(xs)].to_numpy(dtype=np.float64, copy=False) if xs else np.empty((len(pdf), 0))
    if intercept:
        X = np.column_stack([np.ones(len(pdf)), X])
    return X


def _group_iter(pdf: pd.DataFrame, by: Sequence[str]):
    if not by:
        yield (), pdf
        return
    for key, sub in pdf.groupby(list(by), sort=False, dropna=False):
        yield (key if isinstance(key, tuple) else (key,)), sub


def _emit(acc: dict, by: Sequence[str]) -> pd.DataFrame:
    keys = list(acc)
    out = {b: [k[i] for k in keys] for i, b in enumerate(by)}
    out["vec"] = [acc[k].tolist() for k in keys]
    return pd.DataFrame(out)


def _sum_partials(part: DataFrame, by: Sequence[str], finish: Callable[[tuple, np.ndarray], np.ndarray] | None = None) -> dict:
    """Sum the partitions' vectors per group and apply ``finish(key, vector)`` on the
    executors; returns one (short) vector per group, after a check of their number."""
    s = part.select(*by, F.posexplode("vec").alias("pos", "v")).groupBy(*by, "pos").agg(F.sum("v").alias("v"))
    cols = [*by, "vec"]

    def assemble(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("pos")["v"].to_numpy(dtype=np.float64)
        out = {b: [key[i]] for i, b in enumerate(by)}
        out["vec"] = [v if finish is None else finish(tuple(key), v)]
        return pd.DataFrame(out)[cols]

    got = s.groupBy(*by).applyInPandas(assemble, _vec_schema(part, by)).limit(MAX_GROUPS_IN_CLOSURE + 1).collect()
    _check_groups(len(got))
    return {tuple(r[b] for b in by): np.array(r["vec"], dtype=np.float64) for r in got}


#: share of a column's length that the earlier columns must leave unexplained
RANK_CUT = 1e-11
#: least information of a fit, relative to the design's own, that is not separation
SEPARATION_CUT = 1e-9


def independent(XX: np.ndarray) -> np.ndarray:
    """Mask of the columns, taken in order, that the earlier ones do not explain (from X'X)."""
    d = np.sqrt(np.clip(np.diag(XX), 0, None))
    scale = np.where(d > 0, d, 1.0)
    C = XX / np.outer(scale, scale)
    keep: list[int] = []
    L = np.zeros_like(C)
    for j in range(len(C)):
        if d[j] == 0:
            continue
        row = np.zeros(len(keep))
        for a, i in enumerate(keep):
            row[a] = (C[j, i] - row[:a] @ L[i, :a]) / L[i, a]
        rest = C[j, j] - row @ row
        if rest > RANK_CUT:
            L[j, :len(keep)] = row
            L[j, len(keep)] = math.sqrt(rest)
            keep.append(j)
    mask = np.zeros(len(C), bool)
    mask[keep] = True
    return mask


def _scaled_inverse(H: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.diag(H))
    return np.linalg.inv(H / np.outer(d, d)) / np.outer(d, d)


def _vec_schema(part_df: DataFrame, by: Sequence[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in part_df.schema.fields}
    return ", ".join([f"`{b}` {types[b]}" for b in by] + ["vec array<double>"])


BlockFn = Callable[[pd.DataFrame], object]


def _blocks_default(by, y, xs, intercept, times=None):
    def blocks(pdf):
        for key, sub in _group_iter(pdf, by):
            yield (key, _design(sub, xs, intercept), sub[y].to_numpy(dtype=np.float64),
                   *([sub[times].to_numpy(dtype=np.float64)] if times else []))
    return blocks


def blocks_by_kind(kinds: dict[str, str], y: str, xs: Sequence[str], intercept: bool = True):
    """Blocks of groups (kind, level) for rows that belong to one level of each kind: ``kinds`` names each kind's
    column (text; null: no level). A row is held and sent once, not once for each kind."""
    def blocks(pdf):
        X, yv = _design(pdf, xs, intercept), pdf[y].to_numpy(dtype=np.float64)
        for kind, c in kinds.items():
            codes, levels = pd.factorize(pdf[c])
            for i, level in enumerate(levels):
                at = np.flatnonzero(codes == i)
                yield (kind, level), X[at], yv[at]
    return blocks


def _gram_pass(design: DataFrame, by, blocks_factory, k: int, with_inverse: bool) -> dict:
    """n, estimates (NaN: aliased) and, if asked for, (X'X)^-1 per group."""
    def fn(it):
        acc = {}
        for pdf in it:
            if len(pdf) == 0:
                continue
            for key, X, yv in blocks_factory(pdf):
                v = np.concatenate([[len(yv), yv.sum()], X.T @ yv, (X.T @ X).ravel()])
                acc[key] = acc[key] + v if key in acc else v
        if acc:
            yield _emit(acc, by)

    def solve(key, v):
        n, sy, Xy, XX = v[0], v[1], v[2:2 + k], v[2 + k:].reshape(k, k)
        use = independent(XX)
        beta, A = np.full(k, np.nan), np.zeros((k, k))
        if use.any():
            inv = _scaled_inverse(XX[np.ix_(use, use)])
            beta[use] = inv @ Xy[use]
            A[np.ix_(use, use)] = inv
        return np.concatenate([[n, sy], beta, A.ravel() if with_inverse else []])

    return _sum_partials(design.mapInPandas(fn, _vec_schema(design, by)), by, solve)


def _logit_pass(design: DataFrame, by, blocks_factory, betas: dict, k: int, zero_default: bool = False) -> dict:
    """Per group at the given betas (or at 0 for every group): n, sum y, log-likelihood,
    separated (0/1), largest step in units of the linear predictor, Newton step, standard
    errors (NaN: aliased)."""
    zero = np.zeros(k)

    def fn(it):
        acc = {}
        for pdf in it:
            if len(pdf) == 0:
                continue
            for key, X, yv, *times in blocks_factory(pdf):
                b = betas.get(key)
                if b is None:
                    if not zero_default:
                        continue
                    b = zero
                eta = X @ b
                p = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
                f = times[0] if times else np.ones(len(yv))  # rows that a row stands for
                ll = float(np.sum(f * (yv * eta - np.logaddexp(0.0, eta))))
                w = f * p * (1 - p)
                v = np.concatenate([[f.sum(), f @ yv, ll], X.T @ (f * (yv - p)), ((X * w[:, None]).T @ X).ravel(),
                                    ((X * f[:, None] if times else X).T @ X).ravel()])
                acc[key] = acc[key] + v if key in acc else v
        if acc:
            yield _emit(acc, by)

    def newton(key, v):
        n, sy, ll, g = v[0], v[1], v[2], v[3:3 + k]
        H, XX = v[3 + k:3 + k + k * k].reshape(k, k), v[3 + k + k * k:].reshape(k, k)
        use = independent(XX)
        step, se, separated, size = np.zeros(k), np.full(k, np.nan), 0.0, 0.0
        if use.any():
            at = np.ix_(use, use)
            rms = np.sqrt(np.diag(XX)[use])
            root = np.linalg.inv(np.linalg.cholesky(XX[at] / np.outer(rms, rms)))
            info = 4 * root @ (H[at] / np.outer(rms, rms)) @ root.T
            if not np.all(np.isfinite(info)) or np.linalg.eigvalsh((info + info.T) / 2)[0] < SEPARATION_CUT:
                separated = 1.0
            else:
                inv = _scaled_inverse(H[at])
                step[use] = inv @ g[use]
                se[use] = np.sqrt(np.clip(np.diag(inv), 0, None))
                size = float(np.max(np.abs(step[use]) * rms / math.sqrt(n)))
        return np.concatenate([[n, sy, ll, separated, size], step, se])

    return _sum_partials(design.mapInPandas(fn, _vec_schema(design, by)), by, newton)


# ---------------------------------------------------------------- public API

def _prepare(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    cols = list(dict.fromkeys([*by, y, *xs, *extra]))
    d = df.select(*[F.col(c) if c in by or c in extra and c not in xs and c != y else F.col(c).cast("double")
                    for c in cols])
    return d.dropna(subset=[y, *xs])


def _py(v):
    if v is None:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    v = float(v)
    return v if math.isfinite(v) else None


def _coef_rows(key, terms, beta, se, n, r2, converged, dist="normal", df_resid=None, logit=True):
    """Coefficient rows; ``beta`` / ``se`` None or NaN: no estimate."""
    rows = [tuple(_py(x) if not isinstance(x, str) else x for x in r)
            for r in _coef_rows_raw(key, terms, beta, se, n, r2, converged, dist, df_resid, logit)]
    return rows


def _coef_rows_raw(key, terms, beta, se, n, r2, converged, dist="normal", df_resid=None, logit=True):
    rows = []
    crit = Z975 if dist == "normal" else t_ppf975(df_resid)
    for i, t in enumerate(terms):
        b = None if beta is None else float(beta[i])
        s = None if (beta is None or se is None) else float(se[i])
        if b is None or s is None or not math.isfinite(b) or not math.isfinite(s) or s == 0:
            rows.append((*key, t, b, s, None, None, None, None, None, None, None, int(n), r2, converged))
            continue
        stat = b / s
        p = norm_sf2(stat) if dist == "normal" else t_sf2(stat, df_resid)
        lo, hi = b - crit * s, b + crit * s
        if logit:
            orr, olo, ohi = math.exp(min(b, 700)), math.exp(min(lo, 700)), math.exp(min(hi, 700))
        else:
            orr = olo = ohi = None
        rows.append((*key, t, b, s, stat, p, lo, hi, orr, olo, ohi, int(n), r2, converged))
    return rows


def _to_df(spark, rows, design: DataFrame, by: Sequence[str]) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in design.schema.fields}
    schema = ", ".join([f"`{b}` {types[b]}" for b in by] + [f"{n} {t}" for n, t in COEF_SCHEMA_FIELDS])
    return spark.createDataFrame(rows, schema)


def _check_groups(n_groups: int):
    if n_groups > MAX_GROUPS_IN_CLOSURE:
        raise ValueError(f"{n_groups} groups exceed the closure bound {MAX_GROUPS_IN_CLOSURE}; "
                         "coarsen the grouping")


def logit(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = (), intercept: bool = True,
          min_n: int = 0, max_iter: int = 50, tol: float = 1e-9, blocks: Callable | None = None,
          persist: bool = True, times: str | None = None) -> DataFrame:
    """Unpenalised logistic regression per group: coef, se, z, p, OR with 95 % CI, McFadden R2.
    ``times``: column with the number of equal rows that a row stands for."""
    by = list(by)
    terms = (["const"] if intercept else []) + list(xs)
    k = len(terms)
    design = df if blocks is not None else _prepare(df, y, xs, by, [times] if times else [])
    if persist:
        design = design.persist(StorageLevel.MEMORY_AND_DISK)
    factory = blocks or _blocks_default(by, y, xs, intercept, times)
    try:
        # the first pass (every group at beta = 0) also yields n and sum(y) per group
        res = _logit_pass(design, by, factory, {}, k, zero_default=True)
        state = {key: {"beta": np.zeros(k), "prev": None, "ll": -np.inf, "halvings": 0, "done": False, "ok": True,
                       "n": v[0], "sy": v[1], "se": None}
                 for key, v in res.items() if v[0] >= max(min_n, 1)}
        for it in range(max_iter):
            active = {key: s["beta"] for key, s in state.items() if not s["done"]}
            if not active:
                break
            if it > 0:
                res = _logit_pass(design, by, factory, active, k)
            for key in active:
                s, v = state[key], res.get(key)
                if v is None or v[3]:
                    s["done"], s["ok"] = True, False
                    continue
                ll, size, step = v[2], v[4], v[5:5 + k]
                if ll < s["ll"] - 1e-12 * (1 + abs(s["ll"])) and s["halvings"] < 30 and s["prev"] is not None and size >= tol:
                    s["beta"] = (s["beta"] + s["prev"]) / 2
                    s["halvings"] += 1
                    continue
                s["halvings"] = 0
                s["prev"], s["ll"], s["se"] = s["beta"], ll, v[5 + k:]
                s["beta"] = s["beta"] + step
                s["done"] = bool(size < tol)
        rows = []
        for key, s in state.items():
            n, ybar = s["n"], s["sy"] / s["n"]
            ll0 = n * (ybar * math.log(ybar) + (1 - ybar) * math.log(1 - ybar)) if 0 < ybar < 1 else float("nan")
            if not s["ok"] or s["se"] is None:
                rows += _coef_rows(key, terms, None, None, n, None, False)
                continue
            r2 = 1 - s["ll"] / ll0 if math.isfinite(ll0) and ll0 != 0 else None
            rows += _coef_rows(key, terms, np.where(np.isnan(s["se"]), np.nan, s["beta"]), s["se"], n, r2, s["done"])
        return _to_df(df.sparkSession, rows, design, by)
    finally:
        if persist:
            design.unpersist()


def ols(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = (), intercept: bool = True,
        cov_type: str = "classical", cluster: str | None = None, min_n: int = 0, persist: bool = True,
        absorbed_params: int = 0) -> DataFrame:
    """OLS per group with classical (t), HC3 (normal) or cluster-robust (normal) inference.

    ``absorbed_params`` counts parameters removed by demeaning (fixed effects) so the
    residual degrees of freedom match the dummy-variable fit."""
    by = list(by)
    terms = (["const"] if intercept else []) + list(xs)
    k = len(terms)
    extra = [cluster] if cluster else []
    hc3, clustered = cov_type.upper() == "HC3", cov_type == "cluster"
    design = _prepare(df, y, xs, by, extra)
    if persist:
        design = design.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        g = _gram_pass(design, by, _blocks_default(by, y, xs, intercept), k, hc3 or clustered)
        # n, mean of y, estimates, inverse (HC3 and cluster only)
        fits = {key: (v[0], v[1] / v[0], v[2:2 + k], v[2 + k:].reshape(k, k) if len(v) > 2 + k else None)
                for key, v in g.items() if v[0] >= max(min_n, (~np.isnan(v[2:2 + k])).sum() + 1)}
        sums = _residual_pass(design, by, y, xs, intercept, fits, k, hc3)
        if clustered:
            meat, n_clusters = _cluster_pass(design, by, y, xs, intercept, cluster,
                                             {key: np.nan_to_num(f[2]) for key, f in fits.items()}, k)
        rows = []
        for key, (n, _, beta, A) in fits.items():
            if key not in sums:
                continue
            ssr, sst, se = sums[key][0], sums[key][1], sums[key][2:]
            r2 = 1 - ssr / sst if sst > 0 else None
            params = int((~np.isnan(beta)).sum())
            if hc3:
                rows += _coef_rows(key, terms, beta, se, n, r2, True, logit=False)
            elif clustered:
                G = n_clusters.get(key, 0)
                if G < 2 or key not in meat:
                    rows += _coef_rows(key, terms, beta, None, n, r2, True, logit=False)
                    continue
                c = G / (G - 1) * (n - 1) / (n - params - absorbed_params)
                cov = c * A @ meat[key].reshape(k, k) @ A
                rows += _coef_rows(key, terms, beta, np.sqrt(np.clip(np.diag(cov), 0, None)), n, r2, True, logit=False)
            else:
                dfr = n - params - absorbed_params
                rows += _coef_rows(key, terms, beta, se * math.sqrt(ssr / dfr), n, r2, True, dist="t", df_resid=dfr,
                                   logit=False)
        return _to_df(df.sparkSession, rows, design, by)
    finally:
        if persist:
            design.unpersist()


def _residual_pass(design, by, y, xs, intercept, fits: dict, k: int, hc3: bool) -> dict:
    """Per group at the estimates: residual and total (centred) sums of squares, then per
    term the HC3 standard error, or the root of (X'X)^-1's diagonal."""
    def fn(it):
        acc = {}
        for pdf in it:
            if len(pdf) == 0:
                continue
            for key, sub in _group_iter(pdf, by):
                f = fits.get(key)
                if f is None:
                    continue
                _, mean, beta, A = f
                X = _design(sub, xs, intercept)
                yv = sub[y].to_numpy(dtype=np.float64)
                e = yv - X @ np.nan_to_num(beta)
                m = X
                if hc3:
                    h = np.einsum("ij,ij->i", X @ A, X)
                    m = X * (e / (1 - h))[:, None]
                v = np.concatenate([[e @ e, (yv - mean) @ (yv - mean)], (m.T @ m).ravel()])
                acc[key] = acc[key] + v if key in acc else v
        if acc:
            yield _emit(acc, by)

    def errors(key, v):
        M = v[2:].reshape(k, k)
        use = ~np.isnan(fits[key][2])
        se = np.full(k, np.nan)
        if hc3:
            A = fits[key][3]
            se[use] = np.sqrt(np.clip(np.diag(A @ M @ A), 0, None))[use]
        elif use.any():
            se[use] = np.sqrt(np.clip(np.diag(_scaled_inverse(M[np.ix_(use, use)])), 0, None))
        return np.concatenate([v[:2], se])

    return _sum_partials(design.mapInPandas(fn, _vec_schema(design, by)), by, errors)


def _cluster_pass(design, by, y, xs, intercept, cluster, betas: dict, k: int):
    """Per-cluster score sums s_g = sum x e (tree-reduced by Spark), then sum s_g s_g' per group."""
    keys = [*by, cluster]

    def fn(it):
        acc = {}
        for pdf in it:
            if len(pdf) == 0:
                continue
            for key, sub in _group_iter(pdf, keys):
                b = betas.get(tuple(key[:len(by)]))
                if b is None:
                    continue
                X = _design(sub, xs, intercept)
                e = sub[y].to_numpy(dtype=np.float64) - X @ b
                v = X.T @ e
                acc[key] = acc[key] + v if key in acc else v
        if acc:
            yield _emit(acc, keys)
    part = design.mapInPandas(fn, _vec_schema(design, keys))
    ex = part.select(*keys, F.posexplode("vec").alias("pos", "v"))
    s = ex.groupBy(*keys, "pos").agg(F.sum("v").alias("v"))
    sg = s.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("vs")).select(
        *keys, F.transform("vs", lambda x: x["v"]).alias("s"))
    outer = sg.select(*by, F.posexplode(F.flatten(F.transform(
        "s", lambda a: F.transform("s", lambda b: a * b)))).alias("pos", "v"))
    m = outer.groupBy(*by, "pos").agg(F.sum("v").alias("v"))
    mg = m.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("vs"))
    meat = {tuple(r[b] for b in by): np.array([x["v"] for x in r["vs"]]) for r in mg.collect()}
    cnt = sg.groupBy(*by).agg(F.count(F.lit(1)).alias("G")).collect()
    return meat, {tuple(r[b] for b in by): r["G"] for r in cnt}


def term(df: DataFrame, name: str) -> DataFrame:
    """Rows of one term from a coefficient table."""
    return df.where(F.col("term") == name)
