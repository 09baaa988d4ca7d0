"""Connected components of a large edge list by min-hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestar.llm.common import remove, written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links between longs to (node, root), one row for each linked node.

    A round hooks every node to its smallest neighbour, jumps pointers until
    they reach the roots of these trees, and contracts the edges to the roots.
    Each round's tables are written to the shared folder, so that lineage stays
    short and every join reads plain exchanges (which adaptive execution can
    split at a hot root). Nothing but emptiness tests reaches the driver.
    """
    spark = edges.sparkSession
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                "cc-edges")
    out = None
    while not e.isEmpty():
        ends = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")),
                     "cc-hook")
        while True:
            parent = up.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
            jumped = written(up.join(parent, F.col("root") == F.col("n2")).select(
                "node", F.col("r2").alias("root"), (F.col("root") != F.col("r2")).alias("moved")), "cc-jump")
            moved = not jumped.where("moved").isEmpty()
            remove(spark, up)
            up = jumped.drop("moved")
            if not moved:
                break
        left = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        nxt = written(e.join(left, "a").join(right, "b").where("ra <> rb").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
        if out is None:
            new = up
        else:
            step = up.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
            new = written(out.join(step, F.col("root") == F.col("n2"), "left").select(
                "node", F.coalesce("r2", "root").alias("root")), "cc-roots")
            remove(spark, out, up)
        remove(spark, e)
        out, e = new, nxt
    return out if out is not None else e.select(F.col("a").alias("node"), F.col("b").alias("root"))
