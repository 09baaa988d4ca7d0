"""Tables of whole-number vectors, and exact searches over them in blocks of falling length.

Candidates are range-partitioned by falling length and packed, a block of rows
to a row. A search takes the blocks in rounds, sixteen times as many each time; a
query goes only to rounds whose longest candidate can still reach its
threshold, which rises from round to round.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from lodestar.llm.common import remove, set_for, written

SCALE = 256
#: rows of a block at most, and its bytes
CANDIDATES, QUERIES, BYTES = 4096, 2048, 1 << 25
#: rows, roughly, by which the driver finds where parts end (Spark takes up to three times as many); bytes of queries dealt to blocks in a round
ENDS, DEALT = 1 << 15, 1 << 32


def integers(emb: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **more: str) -> DataFrame:
    """(id, v array<double> of whole numbers, norm, and the columns ``more``) of the vectors that take
    part: neither they nor their id null, all components finite."""
    v = F.transform(emb[vec_col], lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("double"))
    good = emb[vec_col].isNotNull() & emb[id_col].isNotNull() & F.forall(
        emb[vec_col], lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    out = emb.where(good).select(emb[id_col].cast("long").alias("id"), v.alias("v"), *(emb[c].alias(k) for k, c in more.items()))
    return out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def matrix(col, d: int) -> np.ndarray:
    """A column of vectors (Arrow lists) as rows of ``d`` numbers; shorter vectors end in zeros."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat, size = col.flatten().to_numpy(zero_copy_only=False), col.value_lengths().to_numpy(zero_copy_only=False)
    if len(flat) == d * len(size) and (size == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(size), d), flat.dtype)
    out[np.arange(d) < size[:, None]] = flat
    return out


@dataclass
class Block:
    """Rows packed together: of candidates, or of queries with the scores each of their
    slots takes (``lo`` to ``hi``, inclusive)."""
    ids: np.ndarray
    labels: np.ndarray
    m: np.ndarray
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None


_KINDS = "ids binary, labels binary, m binary"


def _packed(ids, labels, m) -> list[bytes]:
    return [ids.astype(np.int64).tobytes(), labels.astype(np.int64).tobytes(), m.astype(np.float64).tobytes()]


def _unpacked(d: int, ids: bytes, labels: bytes, m: bytes) -> tuple:
    return np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(m).reshape(-1, d)


def by_length(rows: DataFrame, d: int, most: int = CANDIDATES) -> tuple[DataFrame, int]:
    """Blocks (part, top, ids, labels, m) of ``rows`` (id, label, v, norm), parts and the rows in them by
    falling length (ties are spread by id), and the number of parts."""
    most = max(1, min(most, BYTES // (8 * max(d, 1))))
    parts = max(1, -(-rows.count() // most))

    def pack(batches):
        held, n = [], 0

        def out(size: int):
            t = pa.Table.from_batches(held)
            for lo in range(0, t.num_rows - size + 1, size) if size else [0]:
                x = t.slice(lo, size or None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["part"][0].as_py()], pa.int32()), pa.array([x["norm"][0].as_py()], pa.float64()),
                     *(pa.array([y], pa.binary()) for y in _packed(x["id"].to_numpy(), x["label"].to_numpy(), matrix(x["v"], d)))],
                    ["part", "top", "ids", "labels", "m"])
            held[:] = t.slice(t.num_rows // size * size).to_batches() if size else []
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= most:
                yield from out(most)
                n = sum(x.num_rows for x in held)
        if n:
            yield from out(0)

    spread = rows.repartitionByRange(parts, F.desc("norm"), F.col("id")).sortWithinPartitions(F.desc("norm"), "id")
    spread = spread.select(F.spark_partition_id().alias("part"), "id", F.col("label").cast("long").alias("label"), "v", "norm")
    blocks = spread.mapInArrow(pack, f"part int, top double, {_KINDS}")
    # Spark's 100 sampled rows a part are all on the driver at once; with fewer, parts are less even, and blocks no larger
    with set_for(rows.sparkSession, "spark.sql.execution.rangeExchange.sampleSizePerPartition", max(1, min(100, ENDS // parts))):
        blocks = written(blocks, "vector-blocks", clean=True)
    return blocks, (blocks.agg(F.max("part")).first()[0] or 0) + 1


Score = Callable[[Block, Block], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def search(queries: DataFrame, blocks: DataFrame, parts: int, d: int, score: Score, k: int, growth: int = 16, most: int = QUERIES) -> DataFrame:
    """(id, slot, vec_id, score): for each slot of ``queries`` (id, label, v, norm, slots: array of (lo, hi)) its ``k``
    best candidates, ties to smaller ids. ``score`` gives (id, slot, candidate, score) of a pair of blocks: all
    candidates that can be among the k best of a slot, in any order. A round deals DEALT bytes of queries to parts at
    most, or to one part, and its shuffle files are deleted at its end."""
    spark, found, lo, step = queries.sparkSession, None, 0, 1
    queries = written(queries, "vector-queries", clean=True)
    most = max(1, min(most, BYTES // (8 * max(d, 1))))
    first = W.partitionBy("id", "slot").orderBy(F.desc("score"), "vec_id")
    kinds = "id long, slot int, vec_id long, score double"
    while lo < parts:
        top = blocks.where(f"part >= {lo}").agg(F.max("top")).first()[0]
        if found is None:
            state = queries
        else:  # a slot that is full takes scores from its last one up
            full = found.groupBy("id", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
            full = full.groupBy(F.col("id").alias("qid")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("least"))
            raised = F.transform("slots", lambda s, i: F.struct(
                F.greatest(s["lo"], F.coalesce(F.try_element_at("least", i + 1), s["lo"])).alias("lo"), s["hi"].alias("hi")))
            state = queries.join(full, F.col("id") == F.col("qid"), "left").withColumn("slots", raised).select(*queries.columns)
        reach = F.lit((top or 0.0) * (1 + 1e-9)) * F.col("norm") + 1e-6
        state = state.where(F.exists("slots", lambda s: (s["lo"] <= reach) & (s["lo"] <= s["hi"])))
        n = state.count()
        if not n:
            break
        shares = -(-n // most)
        hi = min(parts, lo + max(1, min(step, DEALT // (shares * most * 8 * max(d, 1)))))
        here = blocks.where(f"part >= {lo} AND part < {hi}")

        def pack(rows: pa.Table) -> pa.Table:
            rows = rows.combine_chunks()
            slots = rows["slots"].to_pylist()
            width = max(len(s) for s in slots)
            lo, hi = (np.array([[x[c] for x in s] + [fill] * (width - len(s)) for s in slots], np.float64).reshape(len(slots), -1)
                      for c, fill in (("lo", np.inf), ("hi", -np.inf)))
            cols = [*_packed(rows["id"].to_numpy(), rows["label"].to_numpy(), matrix(rows["v"], d)), lo.tobytes(), hi.tobytes()]
            return pa.table({c: pa.array([x], pa.binary()) for c, x in zip(("qids", "qlabels", "qm", "lo", "hi"), cols)})

        share = F.pmod(F.xxhash64("id"), F.lit(shares)).alias("share")
        asked = state.select("id", F.col("label").cast("long").alias("label"), "v", "slots", share).groupBy("share").applyInArrow(
            pack, "qids binary, qlabels binary, qm binary, lo binary, hi binary")
        pairs = asked.withColumn("part", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1)))).repartition(hi - lo, "part").join(here, "part")

        def run(batches):
            for b in batches:
                for row in b.to_pylist():
                    q = Block(*_unpacked(d, row["qids"], row["qlabels"], row["qm"]))
                    q.lo, q.hi = (np.frombuffer(row[c]).reshape(len(q.ids), -1) for c in ("lo", "hi"))
                    cols = score(q, Block(*_unpacked(d, row["ids"], row["labels"], row["m"])))
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c), t) for c, t in zip(
                        cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], ["id", "slot", "vec_id", "score"])
        new = pairs.select("qids", "qlabels", "qm", "lo", "hi", "ids", "labels", "m").mapInArrow(run, kinds)
        new = new if found is None else found.unionByName(new)
        old, found = found, written(new.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).drop("r"), "vector-best", clean=True)
        if old is not None:
            remove(spark, old)
        lo, step = hi, step * growth
    remove(spark, queries)
    return found if found is not None else spark.createDataFrame([], kinds)


class Best:
    """The best candidates of one query's slots so far."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, k: int):
        self.lo, self.hi, self.k = lo.copy(), hi, k
        self.who = [np.zeros(0, np.int64)] * len(lo)
        self.score = [np.zeros(0)] * len(lo)

    def least(self) -> float:
        """The lowest score that any slot still takes."""
        return float(np.where(self.lo <= self.hi, self.lo, np.inf).min(initial=np.inf))

    def add(self, who: np.ndarray, score: np.ndarray) -> None:
        for j in range(len(self.lo)):
            ok = (score >= self.lo[j]) & (score <= self.hi[j])
            if ok.any():
                w, s = np.concatenate([self.who[j], who[ok]]), np.concatenate([self.score[j], score[ok]])
                by = np.lexsort((w, -s))[:self.k]
                self.who[j], self.score[j] = w[by], s[by]
                if len(by) == self.k:
                    self.lo[j] = max(self.lo[j], s[by[-1]])
