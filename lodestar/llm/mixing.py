"""Mixing sources to target weights with hash-threshold histograms.

Sizes are summed by (source, hash bucket); the bucket in which a source's
budget ends is found from those sums, and only the rows of that boundary bucket
are histogrammed again on the next hash digits, until the boundary is a single
hash value. Documents are then taken by comparing their hash with the source's
threshold: nothing is sorted, and a larger budget takes a superset of what a
smaller one takes (nested thresholds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from lodestar.llm.common import WORD, remove, written

#: a hash has LEVELS groups of DIGITS bits (60 in all): one pass over the boundary rows for each group
DIGITS, LEVELS = 12, 5
#: a source's share stops at so many times its own size
MOST = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id as text (a null id: as an empty string)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to (source, source_size, target), by water filling.

    Sources in code-point order (null last) weigh 1, 2, 3, repeating. Their
    targets share the total; a target stops at MOST times its source's size and
    the excess goes to the others by weight until none is above. The order
    comes from a range-partitioned sort with per-partition counts, so that
    many sources do not meet in one task.
    """
    spark = sizes.sparkSession
    order = sizes.select(F.struct(F.col("source").isNull().alias("last"), "source").alias("k"), "source_size").orderBy("k")
    ranked = order.rdd.zipWithIndex().map(lambda x: (x[0]["k"]["source"], int(x[0]["source_size"]), int(x[1] % 3 + 1)))
    s = written(spark.createDataFrame(ranked, "source string, source_size long, weight long"), "mix-sources")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level = None  # capped: MOST * size * sum of open weights < open total * weight
    while True:
        capped = F.lit(False) if level is None else F.col("source_size") * MOST * level[1] < F.col("weight") * level[0]
        row = s.agg(F.sum(F.when(capped, F.col("source_size") * MOST)).alias("used"),
                    F.sum(F.when(~capped, F.col("weight"))).alias("open")).first()
        now = (total - (row["used"] or 0), row["open"] or 0)
        if now == level or not now[1]:
            break
        level = now
    if level is None:
        return s.select("source", "source_size", F.lit(0.0).alias("target"))
    capped = F.col("source_size") * MOST * level[1] < F.col("weight") * level[0]
    share = F.lit(float(level[0])) * F.col("weight").cast("double") / F.lit(float(level[1]))
    return s.select("source", "source_size",
                    F.when(capped, (F.col("source_size") * MOST).cast("double")).otherwise(share).alias("target"))


def thresholds(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, copies, cut): every document of a source is taken ``copies``
    times, and once more if its hash is below ``cut``.

    ``docs``: source, size, h. ``goals``: source, source_size, target. The
    budget beyond whole copies ends inside one hash value; that value's
    documents are taken when this comes nearer to the budget.
    """
    g = goals.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    state = written(g.select("source", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"),
                             F.lit(0).cast("long").alias("prefix")), "mix-budget")
    rows = docs
    for k in range(LEVELS):
        shift = DIGITS * (LEVELS - 1 - k)
        s = state.select(F.col("source").alias("s"), "prefix", "budget")
        inside = F.col("source").eqNullSafe(F.col("s"))
        if k:
            inside = inside & (F.shiftright("h", shift + DIGITS) == F.col("prefix"))
        near = rows.join(s, inside) if k else rows
        bucket = near.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        run = W.partitionBy("source").orderBy("bucket")
        below = bucket.withColumn("upto", F.sum("size").over(run)).join(s, F.col("source").eqNullSafe(F.col("s")))
        # the boundary: the first bucket whose running sum exceeds the budget
        edge = (below.where(F.col("upto") > F.col("budget")).groupBy("source")
                .agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("size")).alias("before"), "size"), "bucket").alias("e")))
        state2 = written(state.join(edge.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "copies",
            F.when(F.col("e").isNull(), F.col("budget")).otherwise(F.col("budget") - F.col("e")["before"]).alias("budget"),
            # no bucket exceeds the budget: all hash values below this prefix's end are taken
            F.when(F.col("e").isNull(), F.lit(-1).cast("long")).otherwise(F.col("e")["bucket"]).alias("prefix"),
            F.col("e")["size"].alias("last")), "mix-edge")
        remove(docs.sparkSession, state)
        state = state2
    whole = 1 << (DIGITS * LEVELS)
    # within one hash value: before = budget left, last = the size of that value's documents
    nearer = F.col("budget") > F.col("last") - F.col("budget")
    return state.select("source", "copies", F.when(F.col("prefix") < 0, F.lit(whole))
                        .when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("cut"))


def mix(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` as struct ``doc`` with size, source_size, target, copies, taken.

    Size: number of words in the text (null: 0). ``taken`` = size times copies,
    and copies is at most MOST. Rows that repeat an id share its decision. An
    empty table gives an empty result; sources of size zero take nothing.
    """
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
    narrow = written(rows.select(F.col("doc")["source"].alias("source"), words(F.col("doc")["text"]).alias("size"),
                                 hashed(F.col("doc")["doc_id"]).alias("h")), "mix-sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = written(targets(sizes), "mix-goals")
    cuts = thresholds(narrow, goals)
    plan = written(goals.join(cuts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), "source_size", "target", F.col("copies").alias("base"), "cut"), "mix-plan")
    remove(docs.sparkSession, narrow, goals)
    full = rows.select("doc", words(F.col("doc")["text"]).alias("size"), hashed(F.col("doc")["doc_id"]).alias("h"))
    out = full.join(plan, F.col("doc")["source"].eqNullSafe(F.col("s")))
    copies = (F.col("base") + F.when(F.col("h") < F.col("cut"), 1).otherwise(0)).cast("long")
    return out.select("doc", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its copies say."""
    taken = mix(docs).where("copies > 0")
    return taken.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
