"""Boosted trees for two classes: second-order histogram boosting on Spark.

Features are cut into bins of near equal counts once, and the binned rows are stored in blocks. For each
tree the blocks' gradients and Hessians of the rows that it draws are cached once; the tree then grows a level at a
time, and a level is one Spark job: each task sums gradients, Hessians and row counts of its rows per (node, feature, bin)
in numpy, and the driver, which gets at most nodes x features x bins sums of a task whatever the number of rows, adds them
and picks each node's best split. Only the smaller child of a node is summed, the other one
is its parent less that. Sums are of whole numbers (gradients in units of a power of two),
so that a model is the same under any partitioning, and after a lost executor too.
Blocks and margins are cached, and margins follow the trees there every few trees and in the files now and then.
"""

from __future__ import annotations

import functools
import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from lodestar.operators.quantiles import ordered_image
from lodestar.session import discard, stored

#: trees between two writings of the rows' margins, and between two sums of them in the cached blocks
KEEP, FRESH = 25, 5
#: rows of a block at most: sums of that many gradients are exact in doubles
BLOCK = 1 << 15
#: up to this many rows one task runs all levels
PARTITION_ROWS = 200_000
#: binned rows a task at least; with more of them, a task for each core
TASK_ROWS = 50_000
#: up to this many tasks' sums go to the driver as they are, more are added by a tree of tasks first; the sums are the same
DIRECT = 32


@dataclass
class Tree:
    """Nodes as arrays. A row goes left where its value is at most the threshold (its bin at most the cut)."""
    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for name, x in (("feature", -1), ("cut", 0), ("threshold", math.nan), ("left", -1), ("right", -1), ("value", value), ("cover", cover)):
            getattr(self, name).append(x)
        return len(self.feature) - 1

    def parts(self, columns: Sequence[np.ndarray], by: str, wanted: set[int] | None = None) -> Iterator[tuple[int, np.ndarray | None]]:
        """(node, places of its rows; None: all) of the leaves that rows reach, or of the ``wanted`` nodes; a column an array.
        ``by``: "cut" for columns of bins, "threshold" for columns of values."""
        bound, todo = getattr(self, by), [(0, None)]
        if wanted is not None:  # nothing below other nodes is looked at
            towards = set(wanted)
            for node in range(len(self.feature) - 1, -1, -1):  # children come after their parent
                if self.feature[node] >= 0 and (self.left[node] in towards or self.right[node] in towards):
                    towards.add(node)
        while todo:
            node, at = todo.pop()
            if wanted is not None and node not in towards or at is not None and not len(at):
                continue
            f = self.feature[node]
            if f < 0 or wanted is not None and node in wanted:
                yield node, at
                continue
            goes = (columns[f] if at is None else columns[f][at]) <= bound[node]
            todo.append((self.left[node], np.flatnonzero(goes) if at is None else at[goes]))
            todo.append((self.right[node], np.flatnonzero(~goes) if at is None else at[~goes]))

    def add_margins(self, out: np.ndarray, columns: Sequence[np.ndarray], by: str) -> None:
        """Add the rows' values to ``out``."""
        for node, at in self.parts(columns, by):
            if at is None:
                out += self.value[node]
            else:
                out[at] += self.value[node]


def drawn(ids: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
    """Mask of the rows that a tree draws: a hash of (row's hash, tree, seed) below ``share``."""
    z = ids.astype(np.int64).view(np.uint64) + np.uint64(((tree + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) / 2.0 ** 64 < share


def drawn_columns(n: int, tree: int, share: float, seed: int) -> np.ndarray:
    """The features that a tree may split on, in order: a share of them, at least one."""
    return np.sort(np.random.default_rng([seed, tree]).permutation(n)[:max(1, int(share * n))])


@dataclass
class BoostedTrees:
    """A fitted model. ``history``: the held-out rows' mean loss before each round and at the end, if rows were held out."""
    features: list[str]
    bias: float
    trees: list[Tree]
    history: list[float]

    def margin(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(values), self.bias)
        columns = list(np.ascontiguousarray(np.asarray(values).T))
        for t in self.trees:
            t.add_margins(out, columns, "threshold")
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the probability of label 1 as column p1 (a column of that name is replaced).
        A null or NaN feature counts as above every threshold."""
        model, names = self, [c for c in df.columns if c != "p1"]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                X = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns[len(names):]])
                p = 1 / (1 + np.exp(-np.clip(model.margin(X), -700, 700)))
                yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], pa.array(p)], names=[*names, "p1"])

        rows = df.select(*names, *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(self.features)])
        schema = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
        return rows.mapInArrow(score, f"{schema}, p1 double")


def _cuts(rows: DataFrame, k: int, bins: int) -> list[np.ndarray]:
    """Per feature the thresholds, rising, in one aggregation: values are counted by their ordered image's upper 22 bits (steps
    of a thousandth of the value), these steps are dealt to ``bins`` - 1 ranges of equal counts, and a range's greatest value is a
    threshold, but for the last. Features of few values have a threshold at each, unless a range holds several."""
    long = rows.select(F.posexplode(F.array(*[F.col(f"x{i}") + F.lit(0.0) for i in range(k)])).alias("f", "x"))
    steps = long.groupBy("f", F.shiftright(ordered_image(F.col("x")), 42).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("x"))
    w = Window.partitionBy("f").orderBy("step")  # of a feature at most 2^22 steps, whatever the number of rows
    before = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(Window.partitionBy("f"))
    ranges = steps.select("f", "x", F.floor(F.coalesce(before, F.lit(0)) * F.lit(bins - 1) / total).alias("r"))
    got = ranges.groupBy("f", "r").agg(F.max("x").alias("x")).collect()  # at most features x bins numbers
    return [np.sort([r["x"] for r in got if r["f"] == i])[:-1] for i in range(k)]


#: a block's arrays, one after the other: row's hash, label, weight, margin; held out, and a row of bins for each feature
BLOCK_SCHEMA = "n int, ids binary, y binary, w binary, margin binary, held binary, bins binary"


def _bin(rows: DataFrame, cuts: list[np.ndarray], bias: float) -> DataFrame:
    """Rows (id, y, w, held, features) as blocks of up to BLOCK rows."""
    def block(parts):
        ids, y, w, held = (np.concatenate(c) for c in list(zip(*parts))[:4])
        bins = np.concatenate([p[4] for p in parts], axis=1)
        data = [ids.astype(np.int64), y, w, np.full(len(y), bias), held.astype(bool), bins]
        return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in data]],
                                          names=["n", "ids", "y", "w", "margin", "held", "bins"])

    def fn(batches):
        parts, n = [], 0
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                b = whole.slice(start, BLOCK)
                if n + b.num_rows > BLOCK:
                    yield block(parts)
                    parts, n = [], 0
                X = [np.searchsorted(c, b.column(4 + i).to_numpy(zero_copy_only=False), side="left").astype(np.uint8) for i, c in enumerate(cuts)]
                parts.append((*[b.column(i).to_numpy(zero_copy_only=False) for i in range(4)], np.array(X).reshape(len(cuts), b.num_rows)))
                n += b.num_rows
        if n:
            yield block(parts)
    return rows.mapInArrow(fn, BLOCK_SCHEMA)


def _unpack(row, k: int, recent: Sequence[Tree]):
    """A block's arrays (ids, y, w, held, margin, bins with a row for each feature), ``recent`` trees' values added to its margins."""
    ids, y, w, margin = (np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("y", np.float64), ("w", np.float64), ("margin", np.float64)))
    bins = np.frombuffer(row["bins"], np.uint8).reshape(k, -1)
    margin = margin.copy()
    for t in recent:
        t.add_margins(margin, bins, "cut")
    return ids, y, w, np.frombuffer(row["held"], np.bool_), margin, bins


def _further(block, trees: Sequence[Tree]):
    """A block's arrays with the trees' values added to its margins."""
    if not trees:
        return block
    ids, y, w, held, margin, bins = block
    margin = margin.copy()
    for t in trees:
        t.add_margins(margin, bins, "cut")
    return ids, y, w, held, margin, bins


def _with_margins(blocks: DataFrame, k: int, recent: Sequence[Tree]) -> DataFrame:
    recent = list(recent)

    def fn(batches):
        for whole in batches:
            for b in (whole.slice(i, 1) for i in range(whole.num_rows)):
                cols = list(b.columns)
                cols[4] = pa.array([_unpack(b.to_pylist()[0], k, recent)[4].tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)
    return blocks.mapInArrow(fn, BLOCK_SCHEMA)


@dataclass
class _Plan:
    """What every level of a fit needs: features, bins a feature, share of rows, seed, unit of the sums, tasks."""
    k: int
    width: int
    share: float
    seed: int
    unit: float


def _drawn_part(block, plan: _Plan, number: int) -> tuple:
    """What a tree needs of a block: (bins, gradients, Hessians) of the rows that it draws, in units, and the held-out
    rows' loss in 2^-20."""
    ids, y, w, held, margin, bins = block
    loss = 0
    if held.any():
        m = margin[held]
        loss = int(np.rint((np.logaddexp(0, m) - y[held] * m) * 2.0 ** 20).astype(np.int64).sum())
    use = np.flatnonzero(~held & drawn(ids, number, plan.share, plan.seed))
    y, w = y[use], w[use]
    p = 1 / (1 + np.exp(-np.clip(margin[use], -700, 700)))
    return bins[:, use], *(np.rint(x / plan.unit).astype(np.int32) for x in (w * (p - y), w * p * (1 - p))), loss


def _add(total: np.ndarray, part: tuple, tree: Tree, nodes: Sequence[int], columns: Sequence[int]) -> None:
    """Add the sums of a tree's part of a block to ``total`` (node, column, bin, 3)."""
    bins, g, h, _ = part
    place, width = {n: i for i, n in enumerate(nodes)}, total.shape[2]
    for node, at in tree.parts(bins, "cut", set(nodes)):
        gs, hs = ((v if at is None else v[at]).astype(np.float64) for v in (g, h))
        for j, c in enumerate(columns):
            x = (bins[c] if at is None else bins[c][at]).astype(np.intp)
            cell = total[place[node], j]
            cell[:, 0] += np.bincount(x, gs, width).astype(np.int64)
            cell[:, 1] += np.bincount(x, hs, width).astype(np.int64)
            cell[:, 2] += np.bincount(x, minlength=width)


def _empty(plan: _Plan, nodes: Sequence[int], columns: Sequence[int]) -> np.ndarray:
    return np.zeros((len(nodes), len(columns), plan.width, 3), np.int64)


class _Rows:
    """Blocks spread over tasks: a level is a job. A tree's rows, cached, come from the stored blocks by one step, so that
    a lost executor's are made again from files."""

    def __init__(self, table: DataFrame, plan: _Plan):
        self.plan, self.part, self.state, self.older = plan, None, None, []
        self._read(table)

    def _read(self, table: DataFrame) -> None:
        """The stored blocks' arrays, cached; ``recent`` trees aren't in the stored margins, ``fresh`` ones not in the cached ones."""
        k = self.plan.k
        self.table, self.recent, self.fresh = table, [], []
        self._state(table.rdd.map(lambda row: _unpack(row, k, [])))

    def _state(self, blocks) -> None:
        if self.state is not None:
            self.older.append(self.state)  # until a job has made the new ones of it
        self.state = blocks.persist(StorageLevel.MEMORY_AND_DISK)

    def _start(self, number: int) -> None:
        plan, fresh = self.plan, list(self.fresh)
        self._drop()
        self.part = self.state.map(lambda block: _drawn_part(_further(block, fresh), plan, number)).persist(StorageLevel.MEMORY_AND_DISK)

    def level(self, tree: Tree, number: int, nodes: Sequence[int], columns: np.ndarray) -> tuple[dict[int, np.ndarray], float]:
        """Per node of ``nodes`` an array (column, bin, 3) of whole numbers: gradients and Hessians in ``unit``s, and rows;
        and the loss of the held-out rows. One job."""
        plan, nodes, columns = self.plan, list(nodes), [int(c) for c in columns]
        if nodes == [0]:
            self._start(number)

        def fn(parts):
            total, loss = _empty(plan, nodes, columns), 0
            for part in parts:
                _add(total, part, tree, nodes, columns)
                loss += part[3]
            yield total, loss

        def plus(a, b):
            return a[0] + b[0], a[1] + b[1]

        sums = self.part.mapPartitions(fn)
        total, loss = sums.treeReduce(plus) if sums.getNumPartitions() > DIRECT else functools.reduce(plus, sums.collect())
        while self.older:
            self.older.pop().unpersist()
        return dict(zip(nodes, total)), loss / 2.0 ** 20

    def grown(self, tree: Tree) -> None:
        self.recent.append(tree)
        self.fresh.append(tree)
        if len(self.recent) == KEEP:
            self.close()
            old = self.table
            self._read(stored(_with_margins(old, self.plan.k, self.recent), "binned-rows"))
            discard(old)
        elif len(self.fresh) == FRESH:
            fresh, self.fresh = self.fresh, []
            self._state(self.state.map(lambda block: _further(block, fresh)))

    def _drop(self) -> None:
        if self.part is not None:
            self.part.unpersist()
            self.part = None

    def close(self) -> None:
        self._drop()
        for blocks in [*self.older, self.state]:
            if blocks is not None:
                blocks.unpersist()
        self.older, self.state = [], None


class _Held:
    """The rows of a table of one partition, in its one task: the same sums without a job for each."""

    def __init__(self, batches, plan: _Plan):
        self.blocks, self.plan, self.drawn = [list(_unpack(row, plan.k, [])) for b in batches for row in b.to_pylist()], plan, []

    def level(self, tree, number, nodes, columns):
        if list(nodes) == [0]:
            self.drawn = [_drawn_part(b, self.plan, number) for b in self.blocks]
        total = _empty(self.plan, nodes, columns)
        for part in self.drawn:
            _add(total, part, tree, nodes, columns)
        return dict(zip(nodes, total)), sum(part[3] for part in self.drawn) / 2.0 ** 20

    def grown(self, tree: Tree) -> None:
        for b in self.blocks:
            tree.add_margins(b[4], b[5], "cut")


def best_split(hist: np.ndarray, counts: Sequence[int], unit: float, reg: float, min_hessian: float, min_leaf: int):
    """(gain, column, cut) of the split that lowers the second-order loss most, ties to the earliest column, then cut; None if none
    gains. ``hist``: (column, bin, 3); ``counts``: cuts of each column."""
    if hist.shape[1] < 2:  # no feature has a threshold
        return None
    left = np.cumsum(hist, axis=1)[:, :-1]
    rest = hist.sum(axis=1)[:, None] - left
    (gl, hl, nl), (gr, hr, nr) = (np.moveaxis(a, -1, 0) * np.array([unit, unit, 1.0])[:, None, None] for a in (left, rest))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl * gl / (hl + reg) + gr * gr / (hr + reg) - (gl + gr) ** 2 / (hl + hr + reg)
    allowed = (nl >= max(1, min_leaf)) & (nr >= max(1, min_leaf)) & (hl >= min_hessian) & (hr >= min_hessian)
    allowed &= np.arange(gain.shape[1])[None, :] < np.asarray(counts)[:, None]
    gain = np.where(allowed & np.isfinite(gain), gain, -np.inf)
    best = int(np.argmax(gain))
    j, cut = divmod(best, gain.shape[1])
    return (float(gain[j, cut]), j, cut) if gain[j, cut] > 1e-12 else None


def fit(df: DataFrame, features: Sequence[str], label: str, rounds: int = 300, depth: int = 4, rate: float = 0.05, rows: float = 1.0,
        columns: float = 1.0, reg: float = 1.0, min_hessian: float = 1.0, min_leaf: int = 1, positive_weight: float | None = None,
        validation: float = 0.0, patience: int = 20, tol: float = 1e-4, bins: int = 256, seed: int = 42) -> BoostedTrees:
    """Boosted trees of a 0/1 ``label``. Runs a job per level of each tree.

    ``rows`` and ``columns``: shares drawn for each tree (rows by a hash of all their columns: equal rows are drawn together).
    ``positive_weight``: weight of label 1 (None: rows of label 0 per row of label 1). ``validation``: share of rows held out;
    boosting stops once their mean loss is by ``tol`` below none of the ``patience`` rounds before, and keeps the trees so far. Rows with a null label or a null or NaN feature take no part. Without rows, or with one label only,
    the model has no trees, and its probability is the share of label 1 (0.5 without rows)."""
    features = list(features)
    k = len(features)
    if not 2 <= bins <= 256:
        raise ValueError("bins must be 2 to 256")
    xs = [F.col(f).cast("double") for f in features]
    ok = F.col(label).isNotNull()
    for x in xs:
        ok = ok & x.isNotNull() & ~F.isnan(x)
    ident = F.xxhash64(*df.columns)
    held = F.pmod(F.xxhash64(ident, F.lit("held")), F.lit(1_000_000)) < int(round(validation * 1_000_000))
    raw = df.where(ok).select(ident.alias("id"), F.col(label).cast("double").alias("y"), held.alias("held"), *[x.alias(f"x{i}") for i, x in enumerate(xs)])
    t = raw.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1"), F.sum(F.col("held").cast("long")).alias("out"),
                F.sum(F.when(~F.col("held"), F.col("y"))).alias("in1")).first()
    n, inside, ones = t["n"], t["n"] - (t["out"] or 0), t["in1"] or 0.0
    if not ones or ones == inside:
        share = t["n1"] / n if n else 0.5
        bias = 0.0 if share == 0.5 else math.log(max(share, 1e-15) / max(1 - share, 1e-15))
        return BoostedTrees(features, bias, [], [])
    weight = (inside - ones) / ones if positive_weight is None else float(positive_weight)
    bias = math.log(weight * ones / (inside - ones))
    unit = 2.0 ** (math.ceil(math.log2(max(1.0, weight))) - min(30, 62 - math.ceil(math.log2(n + 1))))
    cuts = _cuts(raw, k, bins)
    width = max(len(c) for c in cuts) + 1
    w = F.when(F.col("y") == 1, F.lit(weight)).otherwise(F.lit(1.0))
    shaped = raw.select("id", "y", w.alias("w"), "held", *[f"x{i}" for i in range(k)])
    plan = _Plan(k, width, rows, seed, unit)
    grow = (plan, cuts, rounds, depth, rate, columns, reg, min_hessian, min_leaf, t["out"] or 0, patience, tol)
    table = _bin(shaped, cuts, bias)
    if n <= PARTITION_ROWS:  # the one task that a level would have runs all of them
        got = table.repartition(1).mapInArrow(lambda batches: iter([pa.RecordBatch.from_arrays(
            [pa.array([pickle.dumps(_boost(_Held(batches, plan), *grow))], pa.binary())], names=["model"])]), "model binary").first()
        return BoostedTrees(features, bias, *pickle.loads(got["model"]))
    cores = df.sparkSession.sparkContext.defaultParallelism
    spread = _Rows(stored(table.repartition(min(-(-n // min(TASK_ROWS, PARTITION_ROWS)), max(2, cores))), "binned-rows"), plan)
    trees, history = _boost(spread, *grow)
    spread.close()
    discard(spread.table)
    return BoostedTrees(features, bias, trees, history)


def _boost(data, plan: _Plan, cuts, rounds, depth, rate, share, reg, min_hessian, min_leaf, n_held, patience, tol) -> tuple[list[Tree], list[float]]:
    trees: list[Tree] = []
    history: list[float] = []
    for number in range(rounds):
        cols = drawn_columns(plan.k, number, share, plan.seed)
        counts = [len(cuts[c]) for c in cols]
        tree = Tree()
        tree.add(0.0, 0.0)
        hists, loss = data.level(tree, number, [0], cols)
        if n_held:
            history.append(loss / n_held)
            if len(history) > patience and not any(history[-1] + tol < h for h in history[-patience - 1:-1]):
                return trees, history
        tree.value[0], tree.cover[0] = _leaf(hists[0][0].sum(axis=0), plan.unit, reg, rate)
        for level in range(depth):
            parents = {}  # smaller child: its parent's sums, its sibling
            for node, hist in sorted(hists.items()):
                found = best_split(hist, counts, plan.unit, reg, min_hessian, min_leaf)
                if found is None:
                    continue
                _, j, cut = found
                lower, both = hist[j, :cut + 1].sum(axis=0), hist[j].sum(axis=0)
                kids = [tree.add(*_leaf(part, plan.unit, reg, rate)) for part in (lower, both - lower)]
                tree.feature[node], tree.cut[node], tree.threshold[node] = int(cols[j]), int(cut), float(cuts[cols[j]][cut])
                tree.left[node], tree.right[node] = kids
                small = kids[0] if 2 * lower[2] <= both[2] else kids[1]
                parents[small] = hist, kids[0] + kids[1] - small
            if not parents or level == depth - 1:
                break
            hists = {}
            for small, hist in data.level(tree, number, list(parents), cols)[0].items():
                whole, other = parents[small]
                hists[small], hists[other] = hist, whole - hist
        trees.append(tree)
        data.grown(tree)
    if n_held and rounds:  # the last tree's loss
        tree = Tree()
        tree.add(0.0, 0.0)
        history.append(data.level(tree, rounds, [0], drawn_columns(plan.k, rounds, share, plan.seed))[1] / n_held)
    return trees, history


def _leaf(part: np.ndarray, unit: float, reg: float, rate: float) -> tuple[float, float]:
    g, h = part[0] * unit, max(part[1], 1) * unit
    return -rate * g / (h + reg), h
