"""Random forest of two classes for large tables.

Spark ML keeps each row with a draw count for every tree, and passes over all of them once a level. Here features are cut
into bins once, rows of equal bins and label are one pattern with a count, and a task holds all patterns and grows some of
the trees, each on its own draws: a pattern of n rows is drawn as often as the sum of n Poisson(1) draws, which is one
Poisson(n) draw. Draws follow from the patterns and the tree's number, so that a forest is the same under any
partitioning. The rule of growth is Spark ML's: 32 bins, Gini, a random subset of the features at each node, least
rows of a child, sibling leaves of one prediction merged.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.boosting import Tree, _cuts
from lodestar.session import discard, stored_parts

#: bins of a feature; bytes of patterns that a task holds at most, patterns sent together, drawn rows summed at once
BINS, HELD, BLOCK, CHUNK = 32, 1 << 28, 1 << 16, 1 << 16


def binned(columns: Sequence, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of Arrow columns, a row of bytes each."""
    X = np.empty((len(columns[0]), len(cuts)), np.uint8)
    for i, (x, c) in enumerate(zip(columns, cuts)):
        X[:, i] = np.searchsorted(c, x.to_numpy(zero_copy_only=False), side="left")
    return X


@dataclass
class Forest:
    """A fitted model; trees' values are class 1's shares of the weight."""
    features: list[str]
    cuts: list[np.ndarray]
    trees: list[Tree]

    @property
    def stages(self) -> list:
        """As a pipeline's model has them: the last one is the forest."""
        return [self]

    def flat(self) -> list[tuple[np.ndarray, ...]]:
        """Per tree (feature, cut, children, value, depth); a leaf is its own child."""
        out = []
        for t in self.trees:
            feature, here = np.array(t.feature), np.arange(len(t.feature))
            leaf = feature < 0
            kids = np.stack([np.where(leaf, here, t.left), np.where(leaf, here, t.right)], axis=1)
            depth = np.zeros(len(here), int)
            for i in np.flatnonzero(~leaf):  # children come after their parent
                depth[kids[i]] = depth[i] + 1
            out.append((np.where(leaf, 0, feature), np.array(t.cut, np.uint8), kids.ravel(), np.array(t.value), int(depth.max())))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the probability of label 1 as column p1 (a column of that name is replaced)."""
        names, k, cuts = [c for c in df.columns if c != "p1"], len(self.cuts), self.cuts
        shared = df.sparkSession.sparkContext.broadcast(self.flat())  # some 30 bytes a node

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                X, at = binned(b.columns[len(names):], cuts).ravel(), np.arange(b.num_rows) * k
                p = np.zeros(b.num_rows)
                for feature, cut, kids, value, depth in shared.value:
                    node = np.zeros(b.num_rows, np.int64)
                    for _ in range(depth):
                        node = kids[2 * node + (X[at + feature[node]] > cut[node])]
                    p += value[node]
                yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], pa.array(p / len(shared.value))], names=[*names, "p1"])

        rows = df.select(*names, *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(self.features)])
        schema = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
        return rows.mapInArrow(score, f"{schema}, p1 double")


def patterns(rows: DataFrame, cuts: Sequence[np.ndarray], label: str, features: Sequence[str]) -> DataFrame:
    """(bins, n): a byte for each feature's bin and one for the label, and how many rows have them. Stored."""
    k = len(cuts)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            X = np.column_stack([binned(b.columns[:k], cuts), b.column(k).to_numpy(zero_copy_only=False).astype(np.uint8)])
            found, n = np.unique(X.view(f"V{k + 1}").ravel(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.tolist(), pa.binary()), pa.array(n, pa.int64())], names=["bins", "n"])

    cols = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    parts = rows.select(*cols, F.col(label).cast("int").alias("y")).mapInArrow(counted, "bins binary, n long")
    return stored_parts([parts.groupBy("bins").agg(F.sum("n").alias("n"))], "forest-patterns")


def gini(counts: np.ndarray) -> np.ndarray:
    """Impurity of class weights along the last axis; none of an empty node."""
    total = counts.sum(axis=-1)
    p = counts / np.where(total > 0, total, 1)[..., None]
    return np.where(total > 0, 1 - (p * p).sum(axis=-1), 0.0)


def grow(X: np.ndarray, y: np.ndarray, n: np.ndarray, cuts: Sequence[np.ndarray], weights: np.ndarray, depth: int, subset: int, min_leaf: int,
         rng: np.random.Generator) -> list[list]:
    """A tree's nodes [feature, cut, left, right, class counts, gain], children after their parent, of patterns ``X`` (a row of bins
    each) with labels ``y`` and counts ``n``."""
    k, width, ncut = X.shape[1], max(len(c) for c in cuts) + 1, np.array([len(c) for c in cuts])
    drawn = rng.poisson(n)
    at = np.flatnonzero(drawn)
    flat, at, y, c = X.ravel(), at * k, y[at].astype(np.int64), drawn[at].astype(np.float64)
    node = np.zeros(len(at), np.int64)  # place among the open nodes
    tree: list[list] = [[-1, 0, -1, -1, np.bincount(y, c, 2), -1.0]]
    open_ = np.array([0])
    for _ in range(depth):
        if not len(open_):
            break
        a = len(open_)
        feats = np.sort(np.argsort(rng.random((a, k)), axis=1)[:, :subset], axis=1)
        hist = np.zeros((subset, a * width * 2))
        for lo in range(0, len(at), CHUNK):
            s = slice(lo, lo + CHUNK)
            base, row, place, count = node[s] * (2 * width) + y[s], at[s], node[s], c[s]
            for j in range(subset):
                hist[j] += np.bincount(base + 2 * flat[row + feats[place, j]].astype(np.int64), count, a * width * 2)
        left = np.cumsum(hist.reshape(subset, a, width, 2), axis=2)
        both = left[:, :, -1:]
        left, right = left[:, :, :-1], both - left[:, :, :-1]
        wl, wr, w = left * weights, right * weights, both * weights
        nl, nr, total = wl.sum(axis=-1), wr.sum(axis=-1), w.sum(axis=-1)
        gain = gini(w) - (nl * gini(wl) + nr * gini(wr)) / total
        allowed = (left.sum(axis=-1) >= max(1, min_leaf)) & (right.sum(axis=-1) >= max(1, min_leaf)) & (np.arange(width - 1) < ncut[feats.T][:, :, None])
        gain = np.moveaxis(np.where(allowed, gain, -np.inf), 0, 1).reshape(a, -1)
        best = gain.argmax(axis=1) if gain.shape[1] else np.zeros(a, int)
        slot, cut = best // max(1, width - 1), best % max(1, width - 1)
        split = gain[np.arange(a), best] > 0 if gain.shape[1] else np.zeros(a, bool)
        to, opened = np.full((a, 2), -1), []
        for i in np.flatnonzero(split).tolist():
            j, x = slot[i], cut[i]
            tree[open_[i]][:4] = int(feats[i, j]), int(x), len(tree), len(tree) + 1
            tree[open_[i]][5] = float(gain[i, best[i]])
            for side, counts in enumerate((left[j, i, x], right[j, i, x])):
                if counts.all() and counts.sum() >= 2 * max(1, min_leaf):  # else it is a leaf whatever is drawn
                    to[i, side] = len(opened)
                    opened.append(len(tree))
                tree.append([-1, 0, -1, -1, counts.copy(), -1.0])
        kept = []
        chosen = feats[np.arange(a), slot]
        for lo in range(0, len(at), CHUNK):
            s = slice(lo, lo + CHUNK)
            place = node[s]
            place = to[place, (flat[at[s] + chosen[place]] > cut[place]).astype(np.int64)]
            stay = place >= 0
            kept.append((at[s][stay], y[s][stay], c[s][stay], place[stay]))
        at, y, c, node = (np.concatenate(x) for x in zip(*kept)) if kept else (at, y, c, node)
        open_ = np.array(opened, int)
    return tree


def merged(tree: list[list], weights: np.ndarray) -> list[list]:
    """The tree with sibling leaves of one prediction merged from below, nodes in preorder."""
    leaf = [t[0] < 0 for t in tree]
    says = [int(w[1] > w[0]) for w in (t[4] * weights for t in tree)]
    for i in range(len(tree) - 1, -1, -1):
        f, _, lo, hi, _, _ = tree[i]
        if f >= 0 and leaf[lo] and leaf[hi] and says[lo] == says[hi]:
            leaf[i], says[i] = True, says[lo]
    out: list[list] = []
    todo = [(0, None, 0)]
    while todo:
        i, parent, side = todo.pop()
        if parent is not None:
            out[parent][side] = len(out)
        f, cut, lo, hi, counts, gain = tree[i]
        here = len(out)
        out.append([-1, 0, -1, -1, counts, -1.0, says[i]] if leaf[i] else [f, cut, -1, -1, counts, gain, says[i]])
        if not leaf[i]:
            todo += [(hi, here, 3), (lo, here, 2)]
    return out


def shaped(tree: list[list], cuts: Sequence[np.ndarray], weights: np.ndarray) -> Tree:
    out = Tree()
    for f, cut, lo, hi, counts, *_ in tree:
        w = counts * weights
        i = out.add(float(w[1] / w.sum()) if w.sum() else 0.0, float(w.sum()))
        if f >= 0:
            out.feature[i], out.cut[i], out.threshold[i], out.left[i], out.right[i] = f, cut, float(cuts[f][cut]), lo, hi
    return out


def _apart(spark, n: int) -> list[int]:
    """``n`` whole numbers that a partitioning by hash into ``n`` parts deals to a part each, in the parts' order."""
    of, some = {}, 16 * n
    while len(of) < n:
        for r in spark.range(some).select(F.col("id").cast("int").alias("i"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).collect():
            of.setdefault(r["p"], r["i"])
        some *= 4
    return [of[p] for p in range(n)]


def fit(df: DataFrame, features: Sequence[str], label: str, trees: int, depth: int, min_leaf: int, weights: tuple[float, float] = (1.0, 1.0),
        seed: int = 42, held: int = HELD) -> Forest | None:
    """A forest of a 0/1 ``label`` on ``df``, whose features are neither null nor NaN, or None if the patterns don't fit
    into ``held`` bytes. ``weights``: of a row of each label. The forest is one job after those for bins and patterns."""
    spark, features = df.sparkSession, list(features)
    k = len(features)
    cuts = _cuts(df.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]), k, BINS + 1)
    table = patterns(df, cuts, label, features)
    if table.count() * (k + 9) > held:
        discard(table)
        return None
    w, subset = np.array(weights, float), math.ceil(math.sqrt(k))
    groups = max(1, min(trees, df.sparkSession.sparkContext.defaultParallelism))
    names = _apart(spark, groups)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                x = b.slice(lo, BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(x.column(0).to_pylist())], pa.binary()),
                                                  pa.array([x.column(1).to_numpy().astype(np.int64).tobytes()], pa.binary())], names=["bins", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, X, n = None, [], []
        for b in batches:
            for i in range(b.num_rows):
                group = b.column(0)[i].as_py()
                X.append(np.frombuffer(b.column(1)[i].as_buffer(), np.uint8).reshape(-1, k + 1).copy())
                n.append(np.frombuffer(b.column(2)[i].as_buffer(), np.int64).copy())
        if group is None:
            return
        X, n = np.concatenate(X), np.concatenate(n)
        # in an order of their own, however they came
        order = _order(X)
        X, n = X[order], n[order]
        y, X = X[:, k].copy(), np.ascontiguousarray(X[:, :k])
        for number in range(names.index(group), trees, groups):
            tree = grow(X, y, n, cuts, w, depth, subset, min_leaf, np.random.default_rng([seed, number]))
            grown = pickle.dumps(shaped(merged(tree, w), cuts, w))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([grown], pa.binary())], names=["tree", "nodes"])

    dealt = table.mapInArrow(pack, "bins binary, n binary").select(F.explode(F.array(*[F.lit(i) for i in names])).alias("group"), "bins", "n")
    got = dealt.repartition(groups, "group").mapInArrow(run, "tree int, nodes binary").collect()  # trees of 2^(depth + 1) nodes at most
    discard(table)
    return Forest(features, cuts, [pickle.loads(r["nodes"]) for r in sorted(got, key=lambda r: r["tree"])])


def _order(X: np.ndarray) -> np.ndarray:
    """Places of the rows of bytes in order."""
    wide = np.zeros((len(X), -(-X.shape[1] // 8) * 8), np.uint8)
    wide[:, :X.shape[1]] = X
    return np.lexsort(wide.view(">u8").T[::-1])
