"""Histogram boosting against direct sums over all rows in numpy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import attribution as AT
from lodestar.operators import boosting as B

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    X = np.round(rng.normal(size=(2000, 4)), 2)
    X[:, 3] = rng.integers(0, 2, 2000)
    y = (X[:, 0] + X[:, 1] * X[:, 3] + rng.logistic(size=2000) > 0.8).astype(int)
    return spark.createDataFrame([(i, *map(float, X[i]), int(y[i])) for i in range(2000)], "id int, a double, b double, c double, d double, y int")


def thresholds(x, bins=256):
    x = np.sort(x + 0.0)
    bits = x.view(np.int64)
    step = np.where(bits < 0, bits ^ ((1 << 63) - 1), bits) >> 42
    before = np.searchsorted(step, step)  # rows in lower steps
    ranges = before * (bins - 1) // len(x)
    return np.array([x[ranges == r].max() for r in np.unique(ranges)])[:-1]


def direct(df, rounds, depth, rate, rows, columns, reg, min_hessian, min_leaf, weight, seed=42):
    """Trees by exhaustive search: every node's rows, every feature and threshold."""
    pdf = df.withColumn("_h", F.xxhash64(*df.columns)).toPandas()
    X, y, ids = pdf[NAMES].to_numpy(), pdf["y"].to_numpy(float), pdf["_h"].to_numpy()
    weight = (y == 0).sum() / (y == 1).sum() if weight is None else weight
    w = np.where(y == 1, weight, 1.0)
    cuts = [thresholds(X[:, j]) for j in range(4)]
    margin = np.full(len(y), np.log((w * y).sum() / (w * (1 - y)).sum()))
    shapes = []
    for number in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        drawn, cols = B.drawn(ids, number, rows, seed), B.drawn_columns(4, number, columns, seed)
        step, shape = np.zeros(len(y)), {}

        def grow(here, level, path):
            use = here & drawn
            step[here] = -rate * g[use].sum() / (h[use].sum() + reg)
            best = None
            for j in cols if level < depth else []:
                for cut in cuts[j]:
                    left = use & (X[:, j] <= cut)
                    right = use & ~left
                    if min(left.sum(), right.sum()) < min_leaf or min(h[left].sum(), h[right].sum()) < min_hessian:
                        continue
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + reg) for s in (left, right)) - g[use].sum() ** 2 / (h[use].sum() + reg)
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                        best = gain, j, cut
            if best:
                shape[path] = best[1:]
                grow(here & (X[:, best[1]] <= best[2]), level + 1, path + "l")
                grow(here & ~(X[:, best[1]] <= best[2]), level + 1, path + "r")

        grow(np.ones(len(y), bool), 0, "")
        margin = margin + step
        shapes.append(shape)
    return dict(zip(pdf["id"], 1 / (1 + np.exp(-margin)))), shapes


def shape_of(tree, node=0, path=""):
    if tree.feature[node] < 0:
        return {}
    return {path: (tree.feature[node], tree.threshold[node])} | shape_of(tree, tree.left[node], path + "l") | shape_of(tree, tree.right[node], path + "r")


@pytest.mark.parametrize("rows, columns, reg, min_hessian, min_leaf, weight", [(0.8, 0.8, 1.0, 1.0, 1, None), (1.0, 1.0, 0.0, 0.0, 50, 1.0)])
def test_trees_equal_exhaustive_search(spark, table, monkeypatch, rows, columns, reg, min_hessian, min_leaf, weight):
    if rows < 1:  # over several tasks, with margins written in between; the other fit runs in one task
        monkeypatch.setattr(B, "PARTITION_ROWS", 900)
        monkeypatch.setattr(B, "KEEP", 2)
    args = dict(rounds=5, depth=3, rate=0.3, rows=rows, columns=columns, reg=reg, min_hessian=min_hessian, min_leaf=min_leaf)
    model = B.fit(table, NAMES, "y", positive_weight=weight, **args)
    want, shapes = direct(table, weight=weight, **args)
    for tree, shape in zip(model.trees, shapes, strict=True):
        got = shape_of(tree)
        assert got.keys() == shape.keys()
        assert all(got[p][0] == shape[p][0] and got[p][1] == pytest.approx(shape[p][1], abs=1e-12) for p in shape)
    p = {r["id"]: r["p1"] for r in model.transform(table).collect()}
    assert max(abs(p[i] - want[i]) for i in want) < 1e-7


def test_cached_margins_change_nothing(spark, table, monkeypatch):
    """Blocks are unpacked from files once between two writings, and margins follow in the cache."""
    args, before = dict(rounds=7, depth=3, rows=0.7, columns=0.5, validation=0.2), set(spark.sparkContext._jsc.getPersistentRDDs())
    one = B.fit(table, NAMES, "y", **args)
    unpacked = []
    monkeypatch.setattr(B, "PARTITION_ROWS", 300)
    monkeypatch.setattr(B, "KEEP", 5)
    monkeypatch.setattr(B, "FRESH", 2)
    state = B._Rows._state
    monkeypatch.setattr(B._Rows, "_state", lambda self, blocks: (unpacked.append(len(self.fresh)), state(self, blocks)))
    many = B.fit(table.repartition(5), NAMES, "y", **args)
    assert [(t.feature, t.cut, t.value) for t in one.trees] == [(t.feature, t.cut, t.value) for t in many.trees] and len(many.trees) == 7
    assert one.history == pytest.approx(many.history) and len(unpacked) == 5  # at first, after 2, 4, 5 and 7 trees
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= before


def test_model_does_not_depend_on_partitions(spark, table, monkeypatch):
    one = B.fit(table.coalesce(1), NAMES, "y", rounds=3, rows=0.7, columns=0.5)
    monkeypatch.setattr(B, "PARTITION_ROWS", 300)
    monkeypatch.setattr(B, "DIRECT", 2)
    many = B.fit(table.repartition(7, "c"), NAMES, "y", rounds=3, rows=0.7, columns=0.5)
    assert [(t.feature, t.cut, t.threshold[:1], t.value) for t in one.trees] == [(t.feature, t.cut, t.threshold[:1], t.value) for t in many.trees]


def test_stops_when_held_out_rows_gain_no_more(spark, table):
    model = B.fit(table, NAMES, "y", rounds=60, rate=0.8, depth=4, validation=0.2, patience=3)
    assert 3 < len(model.trees) < 60 and len(model.history) == len(model.trees) + 1
    last, before = model.history[-1], model.history[-4:-1]
    assert not any(last + 1e-4 < x for x in before)
    out = table.where(F.pmod(F.xxhash64(F.xxhash64(*table.columns), F.lit("held")), F.lit(1_000_000)) < 200_000)
    rows = model.transform(out).select("p1", "y").toPandas()
    loss = -np.mean(np.where(rows.y == 1, np.log(rows.p1), np.log(1 - rows.p1)))
    assert loss == pytest.approx(last, abs=1e-5)


def test_attribution_adds_up_to_the_margin(spark, table):
    model = B.fit(table, NAMES, "y", rounds=4, rate=0.3)
    long, base = AT.shap_values(table, NAMES, model, ["id"])
    total = {r["id"]: r["s"] for r in long.groupBy("id").agg(F.sum("phi").alias("s")).collect()}
    p = {r["id"]: r["p1"] for r in model.transform(table).collect()}
    assert max(abs(total[i] + base - np.log(p[i] / (1 - p[i]))) for i in p) < 1e-9


def test_odd_tables(spark, table):
    empty = B.fit(table.limit(0), NAMES, "y")
    assert not empty.trees and {r["p1"] for r in empty.transform(table).select("p1").distinct().collect()} == {0.5}
    assert not B.fit(table.where("y = 1"), NAMES, "y").trees
    holed = table.unionByName(spark.createDataFrame([(9000, None, 1.0, 1.0, 1.0, 1), (9001, float("nan"), 0.0, 0.0, 0.0, 0), (9002, 1.0, 1.0, 1.0, 1.0, None)],
                                                    table.schema))
    a, b = B.fit(holed, NAMES, "y", rounds=2), B.fit(table, NAMES, "y", rounds=2)
    assert [t.value for t in a.trees] == [t.value for t in b.trees]
    assert a.transform(holed).where("p1 IS NULL").count() == 0 and a.transform(a.transform(holed)).columns == [*holed.columns, "p1"]
    flat = B.fit(table.withColumn("a", F.lit(1.0)), ["a"], "y", rounds=2)  # nothing to split on
    assert all(t.feature == [-1] for t in flat.trees)


def test_a_task_for_each_core_and_trees_applied_once(spark, table, monkeypatch):
    """With many rows a level has no more tasks than cores, and all its jobs read the tree's cached rows."""
    monkeypatch.setattr(B, "PARTITION_ROWS", 10)
    seen = []
    level = B._Rows.level

    def watched(self, *args):
        out = level(self, *args)
        seen.append((self.part.getNumPartitions(), self.part.is_cached, self.part.id()))
        return out
    monkeypatch.setattr(B._Rows, "level", watched)
    many = B.fit(table, NAMES, "y", rounds=3, depth=3)
    assert all(n <= max(2, spark.sparkContext.defaultParallelism) and cached for n, cached, _ in seen)
    assert len({i for *_, i in seen}) == 3 < len(seen)  # a cached part a tree
    monkeypatch.setattr(B, "PARTITION_ROWS", 200_000)
    one = B.fit(table, NAMES, "y", rounds=3, depth=3)
    assert [(t.feature, t.cut, t.value) for t in many.trees] == [(t.feature, t.cut, t.value) for t in one.trees]


def test_leaf_patterns_give_the_recursion_s_values():
    """Deep trees that split a feature again, beyond the held tables too; rows at thresholds and NaN."""
    rng = np.random.default_rng(5)

    def tree(depth, k):
        t = {c: [] for c in ("feature", "threshold", "left", "right", "value", "cover")}

        def grow(level, cover):
            i = len(t["value"])
            for c, v in (("feature", -1), ("threshold", np.nan), ("left", -1), ("right", -1), ("value", rng.normal()), ("cover", cover)):
                t[c].append(v)
            if level < depth:
                share = rng.uniform(0.1, 0.9)
                t["feature"][i], t["threshold"][i] = int(rng.integers(k)), round(rng.normal(), 1)
                t["left"][i] = grow(level + 1, cover * share)
                t["right"][i] = grow(level + 1, cover * (1 - share))
            return i
        grow(0, 100.0)
        return {c: np.array(v) for c, v in t.items()}

    for depth, k in ((3, 2), (4, 11), (8, 11)):
        X = np.round(rng.normal(size=(40, k)), 1)
        X[3, 1] = np.nan
        trees, weights = [tree(depth, k) for _ in range(2)], [0.5, 2.0]
        want = np.array([AT.ensemble_shap(x, trees, weights, k) for x in X])
        assert np.allclose(AT.batch_shap(X, trees, weights, k), want, atol=1e-10)
        assert np.allclose(AT.batch_shap(X, None, weights, k, AT.shap_tables(trees)), want, atol=1e-10)
