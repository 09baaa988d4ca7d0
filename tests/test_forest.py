"""Forests of large tables."""
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.operators import attribution, forest
from lodestar.operators import metrics as M
from lodestar.plans import ml

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(8)
    X = np.c_[r.normal(size=(6000, 3)).round(1), r.integers(0, 3, 6000)]
    y = (X[:, 0] + 0.7 * X[:, 1] * (X[:, 3] == 1) + r.normal(size=6000) > 0.4).astype(int)
    return spark.createDataFrame(pd.DataFrame(X, columns=NAMES).assign(label=y, id=range(6000)))


@pytest.mark.parametrize("weighted", [True, False])
def test_large_forest_agrees_with_spark_ml(rows, weighted, monkeypatch):
    train, test = rows.where("id % 4 <> 0"), rows.where("id % 4 = 0")
    auc, mean = [], []
    for large in (10**9, 100):
        monkeypatch.setattr(ml, "LARGE", large)
        model = ml.fit_rf(train, trees=30, feats=NAMES, weighted=weighted)
        assert isinstance(model, forest.Forest) == (large == 100)
        p = ml.prob1(model.transform(test)).select("p1", "label", "id")
        auc.append(M.roc_auc(p, "p1", "label").first()["auc"])
        mean.append(p.agg(F.avg("p1")).first()[0])
    assert auc[0] == pytest.approx(auc[1], abs=0.015) and mean[0] == pytest.approx(mean[1], abs=0.015) and auc[1] > 0.7


def test_large_forest_is_the_same_under_any_partitioning(rows):
    args = (NAMES, "label", 5, 6, 20)
    one = forest.fit(rows, *args)
    other = forest.fit(rows.orderBy(F.desc("b")).repartition(7), *args)
    assert [t.threshold == u.threshold or np.array_equal(t.threshold, u.threshold, equal_nan=True) for t, u in zip(one.trees, other.trees)] == [True] * 5
    assert [t.value for t in one.trees] == [t.value for t in other.trees] and [t.feature for t in one.trees] == [t.feature for t in other.trees]
    assert forest.fit(rows, *args, held=100) is None  # too many patterns for a task


def test_large_forest_attribution_adds_up(rows):
    model = forest.fit(rows, NAMES, "label", 3, 4, 50, (0.8, 1.3))
    some = rows.where("id < 40")
    long, base = attribution.shap_values(some, NAMES, model.stages[-1], ["id"])
    total = {r["id"]: r["s"] for r in long.groupBy("id").agg(F.sum("phi").alias("s")).collect()}
    p = {r["id"]: r["p1"] for r in model.transform(some).collect()}
    assert len(p) == 40 and max(abs(total[i] + base - p[i]) for i in p) < 1e-9


def test_trees_split_where_gini_falls_most():
    """Without draws to speak of: each split is the best of all, children have the least rows, and counts add up."""
    class All:
        def poisson(self, n):
            return n

        def random(self, shape):
            return np.zeros(shape)
    r = np.random.default_rng(4)
    X, n = r.integers(0, 6, (300, 3)).astype(np.uint8), r.integers(1, 4, 300)
    y = (r.random(300) < 0.2 + 0.1 * X[:, 1]).astype(np.uint8)
    cuts, w = [np.arange(5.0)] * 3, np.array([1.0, 2.0])
    tree = forest.grow(X, y, n, cuts, w, 3, 3, 20, All())

    def impurity(at):
        c = np.bincount(y[at], n[at], 2) * w
        return c.sum() * (1 - ((c / c.sum()) ** 2).sum()) if c.sum() else 0.0
    todo, splits = [(0, np.arange(300))], 0
    while todo:
        i, at = todo.pop()
        f, cut, lo, hi, counts, gain = tree[i]
        assert counts.tolist() == np.bincount(y[at], n[at], 2).tolist()
        if f < 0:
            continue
        best = max(impurity(at) - impurity(at[X[at, g] <= c]) - impurity(at[X[at, g] > c]) for g in range(3) for c in range(5)
                   if min(n[at[X[at, g] <= c]].sum(), n[at[X[at, g] > c]].sum()) >= 20)
        assert gain * (counts * w).sum() == pytest.approx(best)
        splits += 1
        todo += [(lo, at[X[at, f] <= cut]), (hi, at[X[at, f] > cut])]
    assert splits >= 3
    kept = forest.merged(tree, w)
    assert not any(t[0] >= 0 and kept[t[2]][0] < 0 and kept[t[3]][0] < 0 and kept[t[2]][6] == kept[t[3]][6] for t in kept)
    assert sum(Counter(x for t in kept if t[0] >= 0 for x in t[2:4]).values()) == len(kept) - 1
