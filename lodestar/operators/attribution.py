"""Tree-ensemble attribution: path-dependent TreeSHAP for Spark ML tree models.

The fitted model is written with its standard ML writer under the shared
checkpoint folder; its node table (``treeID, nodeData{...}``) is read back.
The table size is bounded by the model (trees x 2^(depth+1) nodes), not by
the data, so it travels to executors in the task closure. SHAP values are
computed row by row inside ``mapInPandas`` (the polynomial-time TreeSHAP
recursion, node covers = weighted training counts) and aggregated in Spark.
Values add up to the model's raw margin (boosted trees) or to the probability
of class 1 (classification forests and trees): sum(phi) + base.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassificationModel, RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.boosting import BoostedTrees
from lodestar.operators.forest import Forest
from lodestar.session import scratch_path

MAX_NODES = 2_000_000


def load_trees(model, spark) -> tuple[list[dict], list[float]]:
    """Node arrays per tree, plus tree weights: of a saved Spark ML tree ensemble, or of boosted trees, which are in memory."""
    if isinstance(model, (BoostedTrees, Forest)):  # covers: Hessian sums, the rate is in the leaves' values; a forest's: weights
        share = 1.0 if isinstance(model, BoostedTrees) else 1.0 / len(model.trees)
        return [{c: np.array(getattr(t, c)) for c in ("feature", "threshold", "left", "right", "value", "cover")} for t in model.trees], [share] * len(model.trees)
    forest = isinstance(model, (RandomForestClassificationModel, DecisionTreeClassificationModel))
    if forest and model.numClasses != 2:
        raise ValueError("attribution covers two classes")
    path = scratch_path(spark, "tree_model")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    n = nodes.count()
    if n > MAX_NODES:
        raise ValueError(f"model has {n} nodes; too large to ship to executors")
    rows = nodes.select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats",
                        "nodeData.rawCount", "nodeData.leftChild", "nodeData.rightChild",
                        "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold").collect()
    by_tree: dict[int, list] = {}
    for r in rows:
        by_tree.setdefault(r["treeID"], []).append(r)
    trees = []
    for tid in sorted(by_tree):
        rs = by_tree[tid]
        size = max(r["id"] for r in rs) + 1
        t = {k: np.zeros(size) for k in ("value", "cover", "threshold")}
        t["left"] = np.full(size, -1, dtype=np.int64)
        t["right"] = np.full(size, -1, dtype=np.int64)
        t["feature"] = np.full(size, -1, dtype=np.int64)
        for r in rs:
            i = r["id"]
            t["value"][i] = r["prediction"]
            stats = r["impurityStats"] or []
            if forest:  # class weights: their sum covers the node, class 1's share is its value
                t["cover"][i] = sum(stats)
                t["value"][i] = stats[1] / sum(stats) if sum(stats) else 0.0
            else:
                t["cover"][i] = stats[0] if stats else float(r["rawCount"] or 0)
            t["left"][i], t["right"][i] = r["leftChild"], r["rightChild"]
            if r["leftChild"] >= 0:
                t["feature"][i] = r["featureIndex"]
                t["threshold"][i] = r["leftCategoriesOrThreshold"][0]
        trees.append(t)
    if forest:  # the mean of the trees' class-1 shares
        return trees, [1.0 / len(trees)] * len(trees)
    return trees, list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0] * len(trees)


def expected_value(t: dict, node: int = 0) -> float:
    if t["left"][node] < 0:
        return t["value"][node]
    c = t["cover"][node]
    lft, rgt = t["left"][node], t["right"][node]
    return (t["cover"][lft] * expected_value(t, lft) + t["cover"][rgt] * expected_value(t, rgt)) / c


# -- TreeSHAP path bookkeeping: each element is [feature, zero_fraction, one_fraction, pweight]

def _extend(path, zero, one, feat):
    depth = len(path)
    path = [list(e) for e in path] + [[feat, zero, one, 1.0 if depth == 0 else 0.0]]
    for i in range(depth - 1, -1, -1):
        path[i + 1][3] += one * path[i][3] * (i + 1) / (depth + 1)
        path[i][3] = zero * path[i][3] * (depth - i) / (depth + 1)
    return path


def _unwind(path, idx):
    depth = len(path) - 1
    one, zero = path[idx][2], path[idx][1]
    out = [list(e) for e in path]
    nxt = out[depth][3]
    for i in range(depth - 1, -1, -1):
        if one != 0:
            tmp = out[i][3]
            out[i][3] = nxt * (depth + 1) / ((i + 1) * one)
            nxt = tmp - out[i][3] * zero * (depth - i) / (depth + 1)
        else:
            out[i][3] = out[i][3] * (depth + 1) / (zero * (depth - i))
    for i in range(idx, depth):
        out[i][0], out[i][1], out[i][2] = out[i + 1][0], out[i + 1][1], out[i + 1][2]
    return out[:depth]


def _unwound_sum(path, idx):
    depth = len(path) - 1
    one, zero = path[idx][2], path[idx][1]
    nxt = path[depth][3]
    total = 0.0
    for i in range(depth - 1, -1, -1):
        if one != 0:
            tmp = nxt * (depth + 1) / ((i + 1) * one)
            total += tmp
            nxt = path[i][3] - tmp * zero * (depth - i) / (depth + 1)
        elif zero != 0:
            total += (path[i][3] / zero) / ((depth - i) / (depth + 1))
    return total


def tree_shap(x: np.ndarray, t: dict, n_features: int) -> np.ndarray:
    phi = np.zeros(n_features)

    def rec(node, path, zero, one, feat):
        path = _extend(path, zero, one, feat)
        if t["left"][node] < 0:
            v = t["value"][node]
            for i in range(1, len(path)):
                w = _unwound_sum(path, i)
                phi[path[i][0]] += w * (path[i][2] - path[i][1]) * v
            return
        f = t["feature"][node]
        lft, rgt = t["left"][node], t["right"][node]
        hot, cold = (lft, rgt) if x[f] <= t["threshold"][node] else (rgt, lft)
        c = t["cover"][node]
        iz, io = 1.0, 1.0
        k = next((i for i in range(len(path)) if path[i][0] == f), None)
        if k is not None:
            iz, io = path[k][1], path[k][2]
            path = _unwind(path, k)
        rec(hot, path, iz * t["cover"][hot] / c, io, f)
        rec(cold, path, iz * t["cover"][cold] / c, 0.0, f)

    rec(0, [], 1.0, 1.0, -1)
    return phi


def ensemble_shap(x: np.ndarray, trees, weights, n_features: int) -> np.ndarray:
    out = np.zeros(n_features)
    for t, w in zip(trees, weights):
        out += w * tree_shap(x, t, n_features)
    return out


#: features on a leaf's path up to which the values of all its patterns are held
PATTERN_FEATURES = 6


def leaf_paths(t: dict) -> list[tuple]:
    """Per leaf its value and, per feature on its path: feature, share of the covers that goes along, bounds (lo, hi; None: none).
    A row goes along a feature's steps where its value is at most hi and not at most lo."""
    out, todo = [], [(0, {})]
    while todo:
        node, path = todo.pop()
        if t["left"][node] < 0:
            out.append((float(t["value"][node]), [(f, *rest) for f, rest in path.items()]))
            continue
        f, bound, cover = int(t["feature"][node]), float(t["threshold"][node]), t["cover"][node]
        zero, lo, hi = path.get(f, (1.0, None, None))
        for kid, ends in ((t["left"][node], (lo, bound if hi is None else min(hi, bound))), (t["right"][node], (bound if lo is None else max(lo, bound), hi))):
            todo.append((int(kid), {**path, f: (zero * t["cover"][kid] / cover, *ends)}))
    return out


def leaf_values(value: float, zeros: np.ndarray, along: np.ndarray) -> np.ndarray:
    """A leaf's part of each path feature's Shapley value, for rows that go along (1) its features' steps or not (0)."""
    d = along.shape[1]
    weight = [math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)]
    out = np.empty(along.shape)
    for i in range(d):
        known = [np.ones(len(along))]  # by number of known features, products of theirs and of the others' shares
        for j in range(d):
            if j != i:
                known = [a * zeros[j] + b * along[:, j] for a, b in zip([*known, 0.0], [0.0, *known])]
        out[:, i] = (along[:, i] - zeros[i]) * value * sum(w * e for w, e in zip(weight, known))
    return out


def shap_tables(trees) -> list[list[tuple]]:
    """Per tree and leaf: value, features, shares, bounds, and the values of all patterns (None beyond PATTERN_FEATURES features)."""
    out = []
    for t in trees:
        leaves = []
        for value, path in leaf_paths(t):
            if path:
                feats, zeros, lo, hi = zip(*path)
                d, zeros = len(feats), np.array(zeros)
                table = leaf_values(value, zeros, (np.arange(1 << d)[:, None] >> np.arange(d)) & 1) if d <= PATTERN_FEATURES else None
                leaves.append((value, feats, zeros, lo, hi, table))
        out.append(leaves)
    return out


def batch_shap(X: np.ndarray, trees, weights, n_features: int, tables=None) -> np.ndarray:
    """SHAP for a batch of rows. What a leaf adds to a row's values depends only on which features' steps of its path the row
    goes along, so a leaf's values are worked out once per pattern of these and looked up for the rows."""
    out = np.zeros((n_features, len(X)))
    if len(X) == 0:
        return out.T
    cols = list(np.ascontiguousarray(X.T))
    for leaves, w in zip(shap_tables(trees) if tables is None else tables, weights):
        for value, feats, zeros, lo, hi, table in leaves:
            goes = []
            for f, a, b in zip(feats, lo, hi):
                ok = cols[f] <= b if b is not None else True
                goes.append(ok if a is None else ok & ~(cols[f] <= a))
            pattern = np.zeros(len(X), np.int64)
            for i, g in enumerate(goes):
                pattern |= g.astype(np.int64) << i
            if table is None:
                seen, pattern = np.unique(pattern, return_inverse=True)
                here = leaf_values(value, zeros, (seen[:, None] >> np.arange(len(feats))) & 1)
            else:
                here = table
            for i, f in enumerate(feats):
                out[f] += (w * here[:, i])[pattern]
    return out.T


def shap_values(df: DataFrame, features: Sequence[str], model, keys: Sequence[str]) -> tuple[DataFrame, float]:
    """Per-row SHAP values as long rows (keys..., feature, phi) and the base value."""
    spark = df.sparkSession
    trees, weights = load_trees(model, spark)
    base = float(sum(w * expected_value(t) for t, w in zip(trees, weights))) + getattr(model, "bias", 0.0)
    feats = list(features)
    nf = len(feats)
    tables = shap_tables(trees)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def fn(it):
        for pdf in it:
            X = pdf[feats].to_numpy(dtype=np.float64)
            phis = batch_shap(X, None, weights, nf, tables)
            out = pdf[list(keys)].copy()
            out["phi"] = list(phis)
            yield out

    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["phi array<double>"])
    wide = df.select(*keys, *feats).mapInPandas(fn, schema)
    long = wide.select(*keys, F.posexplode("phi").alias("idx", "phi"))
    names = F.array(*[F.lit(f) for f in feats])
    return long.select(*keys, F.get(names, F.col("idx")).alias("feature"), "phi"), base


def mean_abs_shap(long: DataFrame, subgroup_flag: str | None = None) -> DataFrame:
    """Mean |phi| per feature, and over rows whose ``subgroup_flag`` is 1, in one
    aggregation over a single SHAP pass."""
    aggs = [F.avg(F.abs("phi")).alias("mean_abs_shap")]
    if subgroup_flag is not None:
        aggs.append(F.avg(F.when(F.col(subgroup_flag) == 1, F.abs("phi"))).alias("mean_abs_shap_subgroup"))
    return long.groupBy("feature").agg(*aggs)


# ---------------------------------------------------------------- linear models with dependent features

#: features up to which all subsets are taken; orders of the features drawn beyond
EXACT_FEATURES, ORDERS = 12, 1000


def dependent_transform(beta: np.ndarray, cov: np.ndarray, seed: int = 0) -> np.ndarray:
    """The k x k matrix T with phi = T (x - mean): Shapley values of a linear model when the features outside a subset S take their
    expectation given those within, mean_R + cov_RS cov_SS^-1 (x_S - mean_S). A subset's expectation is linear in x, so each
    value is a weighted sum of differences of coefficient vectors: over all subsets up to EXACT_FEATURES features, else
    over ORDERS orders of the features and their reverses (fixed by ``seed``)."""
    k = len(beta)
    held: dict[int, np.ndarray] = {}

    def given(subset: int) -> np.ndarray:
        """Coefficients on x - mean of the expectation given the subset."""
        if subset not in held:
            s = [i for i in range(k) if subset >> i & 1]
            r = [i for i in range(k) if not subset >> i & 1]
            out = np.zeros(k)
            if s:
                out[s] = beta[s] + np.linalg.pinv(cov[np.ix_(s, s)], hermitian=True) @ cov[np.ix_(s, r)] @ beta[r]
            held[subset] = out
        return held[subset]

    t = np.zeros((k, k))
    if k <= EXACT_FEATURES:
        weight = [1.0 / k]  # of a subset of that size without the feature: its share of all orders
        for n in range(1, k):
            weight.append(weight[-1] * n / (k - n))
        for subset in range(1 << k):
            for i in range(k):
                if not subset >> i & 1:
                    t[i] += weight[subset.bit_count()] * (given(subset | 1 << i) - given(subset))
        return t
    draw = np.random.default_rng(seed)
    for _ in range(ORDERS):
        order = draw.permutation(k)
        for way in (order, order[::-1]):
            subset = 0
            for i in way.tolist():
                t[i] += (given(subset | 1 << i) - given(subset)) / (2 * ORDERS)
                subset |= 1 << i
            held.clear()
    return t


def moments(df: DataFrame, xs: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and (population) covariance of the columns, in one pass; rows with a null don't count. Sums are
    taken around the first row's values."""
    from lodestar.operators.glm import _sum_partials
    d = df.select(*[F.col(x).cast("double").alias(x) for x in xs]).dropna()
    one = d.first()
    if one is None:
        return 0, np.zeros(len(xs)), np.zeros((len(xs),) * 2)
    origin = np.array(one, np.float64)

    def add(batches):
        total = np.zeros((len(xs) + 1,) * 2)
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), np.column_stack([c.to_numpy() for c in b.columns]) - origin])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["vec"])

    m = _sum_partials(d.mapInArrow(add, "vec array<double>"), [])[()].reshape(len(xs) + 1, -1)
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    return int(n), origin + mean, m[1:, 1:] / n - np.outer(mean, mean)


def linear_attribution(df: DataFrame, coefs: dict[str, float], name: str = "phi_") -> DataFrame:
    """``df`` with a column ``phi_<feature>`` for each coefficient: its Shapley value in the linear predictor, given how
    the features go together in ``df`` (``dependent_transform``); a row's values add up to its predictor less the mean one."""
    xs = list(coefs)
    _, mean, cov = moments(df, xs)
    t = dependent_transform(np.array([coefs[x] or 0.0 for x in xs]), cov)
    centred = [F.col(x).cast("double") - F.lit(float(m)) for x, m in zip(xs, mean)]
    phi = {f"{name}{x}": sum((F.lit(float(w)) * c for w, c in zip(row, centred) if w), F.lit(0.0)) for x, row in zip(xs, t)}
    return df.withColumns(phi)
