"""Value-based quantile buckets (pandas ``qcut`` semantics) and quantile flags.

Edges are exact linear-interpolated quantiles (``exact_quantiles``), computed once
per group with partial aggregation and joined back (one small row per group),
so a hot group never lands in a single window task. Buckets are right-closed
with the minimum in bucket 0; with ``duplicates='drop'`` repeated edges merge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.session import stored


def qcut_edges(df: DataFrame, c: str, q: int, by: Sequence[str] = ()) -> DataFrame:
    """Per group: min, max and the q - 1 inner exact quantiles as an array."""
    by = list(by)
    qs = exact_quantiles(df, c, [i / q for i in range(q + 1)], by)
    arr = F.transform(F.sort_array(F.collect_list(F.struct("q_index", "value"))), lambda s: s["value"])  # q + 1 numbers
    return qs.groupBy(*by).agg(arr.alias("_e")).where(F.size("_e") > 0).select(
        *by, F.col("_e")[0].alias("_lo"), F.col("_e")[q].alias("_hi"), F.slice("_e", 2, q - 1).alias("_qs"))


def qcut(df: DataFrame, c: str, q: int, by: Sequence[str] = (), duplicates: str = "raise",
         name: str = "bucket") -> DataFrame:
    edges = qcut_edges(df, c, q, by)
    if duplicates == "raise":
        all_edges = F.concat(F.array("_lo"), F.col("_qs"), F.array("_hi"))
        edges = edges.select("*", F.when(F.size(F.array_distinct(all_edges)) < q + 1,
                                         F.raise_error(F.lit(f"qcut: duplicate bin edges in {c}; "
                                                             "pass duplicates='drop'"))).alias("_chk"))
        edges = edges.where(F.col("_chk").isNull()).drop("_chk")
    if by:
        j = df.join(edges, list(by), "left")
    else:
        # one row of q + 1 edge values: a bounded literal, safe to bring to the driver
        e = edges.first() or {"_lo": None, "_hi": None, "_qs": []}
        j = df.select("*", F.lit(e["_lo"]).cast("double").alias("_lo"), F.lit(e["_hi"]).cast("double").alias("_hi"),
                      F.array(*[F.lit(float(v)) for v in (e["_qs"] or [])]).cast("array<double>").alias("_qs"))
    x = F.col(c)
    inner = F.filter(F.array_distinct("_qs"), lambda e: (e > F.col("_lo")) & (e < F.col("_hi")))
    bucket = F.when(x.isNull(), F.lit(None).cast("int")).otherwise(F.size(F.filter(inner, lambda e: e < x)))
    return j.select(*df.columns, bucket.alias(name))


def quantile_flags(df: DataFrame, c: str, lo_p: float = 0.25, hi_p: float = 0.75) -> DataFrame:
    """is_small = x <= p_lo, is_large = x >= p_hi (global exact quantiles, scalar subqueries)."""
    qs = {r["q_index"]: r["value"] for r in exact_quantiles(df, c, [lo_p, hi_p]).collect()}  # two numbers
    return df.select("*", F.coalesce((F.col(c) <= F.lit(qs[0])).cast("int"), F.lit(0)).alias("is_small"),
                     F.coalesce((F.col(c) >= F.lit(qs[1])).cast("int"), F.lit(0)).alias("is_large"))


# ---------------------------------------------------------------- exact quantiles at scale

#: bits of a histogram digit; values of an open bin that the last digit takes in one go; open ranks that a plan holds as literals
DIGIT, FEW, INLINE = 20, 1 << 16, 1000


def ordered_image(x) -> F.Column:
    """A long that orders like the double: its bits, with those below the sign flipped for negative numbers."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x + F.lit(0.0)).cast("long")  # -0 as 0
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def _coarse(x) -> F.Column:
    """A whole number that never falls as the double rises: a few thousand steps over the numbers of common size."""
    return F.floor(F.signum(x) * F.log1p(F.abs(x)) * F.lit(1024.0)).cast("long")


def radix_select(rows: DataFrame, by: Sequence[str], targets, coarse, image) -> DataFrame:
    """(by..., target, value): per group the values ``_x`` at given ranks. Runs jobs when called.

    ``targets``: from a group's number of rows (a column) an array of structs with a long ``rank``. ``coarse`` and ``image``: of a
    value, a rough and an exact whole number that order like it. The first pass counts each group's values by the rough number, the
    later ones by digits of the exact one, with the least and greatest value of each bin: one partial aggregation, whose rows are
    bounded by groups x bins. A rank at either end of its bin, or in a bin of one value, is found; for the others the next pass
    reads the rows of their bins only. No values are stored, and no group meets in one task."""
    by, spark = list(by), rows.sparkSession
    x, keys, shift = F.col("_x"), [*by, "_q", "_p"], 64
    first = rows.select(*by, F.lit(0).cast("long").alias("_q"), F.lit(0).cast("long").alias("_p"), "_x", coarse(x).alias("_b"))
    part, open_, out = first, None, None
    while True:
        hist = part.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        w = Window.partitionBy(*keys)  # bins of one prefix
        hist = hist.withColumn("_end", F.sum("_c").over(w.orderBy("_b")))
        hist = hist.withColumn("_t", targets(F.sum("_c").over(w))) if open_ is None else hist.join(open_, keys)
        begin = F.col("_end") - F.col("_c")
        hit = hist.select(*by, "_q", "_b", "_c", "_lo", "_hi", begin.alias("_begin"),
                          F.explode(F.filter("_t", lambda t: (t["rank"] >= begin) & (t["rank"] < F.col("_end")))).alias("target"))
        rank = F.col("target")["rank"] - F.col("_begin")
        value = F.when((rank == 0) | (F.col("_lo") == F.col("_hi")), F.col("_lo")).when(rank == F.col("_c") - 1, F.col("_hi"))
        # a row for each target; after the first pass its bin is the rough number
        bin_ = ("_b", F.lit(0).cast("long")) if open_ is None else ("_q", F.col("_b"))
        step = stored(hit.select(*by, "target", F.col(bin_[0]).alias("_q"), bin_[1].alias("_p"), rank.alias("_rank"), "_c", value.alias("value")), "radix")
        found = step.where(F.col("value").isNotNull()).select(*by, "target", "value")
        out = found if out is None else out.unionByName(found)
        left = step.where(F.col("value").isNull())
        fields = step.schema["target"].dataType.names
        some = left.limit(INLINE + 1).collect()
        if not some:
            return out
        if len(some) <= INLINE:  # few ranks: they travel with the plan
            most, marks = max(r["_c"] for r in some), {}
            for r in some:
                marks.setdefault(tuple(r[k] for k in keys), []).append((r["_rank"], *(r["target"][f] for f in fields if f != "rank")))
            schema = T.StructType([step.schema[k] for k in keys] + [T.StructField("_t", T.ArrayType(T.StructType(
                [T.StructField("rank", T.LongType())] + [f for f in step.schema["target"].dataType if f.name != "rank"])))])
            open_ = F.broadcast(spark.createDataFrame([(*k, t) for k, t in marks.items()], schema))
        else:
            most = left.agg(F.max("_c")).first()[0]
            target = F.struct(F.col("_rank").alias("rank"), *[F.col("target")[f].alias(f) for f in fields if f != "rank"])
            open_ = stored(left.groupBy(*keys).agg(F.collect_list(target).alias("_t")), "radix-open")  # its targets
        last, shift = shift, 0 if most <= FEW else max(0, shift - DIGIT)
        # prefix so far: the bits of the image above ``last``
        prefix = F.lit(0).cast("long") if last == 64 else F.shiftright("_i", last)
        marks = open_.select(*keys)
        part = rows.select(*by, "_x", coarse(x).alias("_q"))
        if last == 64:
            part = part.withColumn("_p", prefix).join(marks, keys).withColumn("_i", image(x))
        else:
            part = part.join(marks.select(*by, "_q").distinct(), [*by, "_q"]).withColumn("_i", image(x)).withColumn("_p", prefix).join(marks, keys)
        part = part.select(*keys, "_x", F.shiftright("_i", shift).alias("_b"))


def exact_quantiles(df: DataFrame, c: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles (pandas ``quantile`` / SQL ``quantile_cont``) by radix selection of the ranks
    around p (n - 1); groups with a null key and null or NaN values are left out. Runs jobs when called.
    Returns long rows: (by..., q_index int, prob double, value double)."""
    by, probs = list(by), [float(p) for p in probs]
    x = F.col(c).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x))
    for g in by:
        rows = rows.where(F.col(g).isNotNull())

    def targets(n):
        out = []
        for i, p in enumerate(probs):
            k = F.floor(F.lit(p) * (n - 1)).cast("long")
            for up in (0, 1):
                out.append(F.struct(F.least(k + up, n - 1).alias("rank"), F.lit(i).alias("q"), F.lit(up).alias("up"),
                                    (F.lit(p) * (n - 1) - k).alias("frac")))
        return F.array(*out)

    found = radix_select(rows.select(*by, x.alias("_x")), by, targets, _coarse, ordered_image)
    of = lambda up: F.max(F.when(F.col("target")["up"] == up, F.col("value")))
    both = found.groupBy(*by, F.col("target")["q"].alias("q_index")).agg(of(0).alias("_v0"), of(1).alias("_v1"), F.max(F.col("target")["frac"]).alias("_f"))
    value = F.when(F.col("_f") == 0, F.col("_v0")).otherwise((F.lit(1.0) - F.col("_f")) * F.col("_v0") + F.col("_f") * F.col("_v1"))
    prob = F.array(*[F.lit(p) for p in probs])[F.col("q_index")]
    return both.select(*by, F.col("q_index").cast("int").alias("q_index"), prob.alias("prob"), value.alias("value"))


def quantiles_wide(df: DataFrame, c: str, probs: Sequence[float], names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per group with one column per requested quantile."""
    long = exact_quantiles(df, c, probs, by)
    aggs = [F.max(F.when(F.col("q_index") == i, F.col("value"))).alias(n) for i, n in enumerate(names)]
    return long.groupBy(*by).agg(*aggs)


def with_quantiles(agg: DataFrame, df: DataFrame, by: Sequence[str], specs: Sequence[tuple[str, float, str]]) -> DataFrame:
    """Join exact quantile columns ``(column, prob, name)`` onto a grouped aggregate."""
    out = agg
    cols: dict[str, list[tuple[float, str]]] = {}
    for c, p, n in specs:
        cols.setdefault(c, []).append((p, n))
    for c, ps in cols.items():
        q = quantiles_wide(df, c, [p for p, _ in ps], [n for _, n in ps], by)
        if by:
            out = out.join(q, list(by), "left")
        else:
            row = q.first()  # one row of len(specs) numbers
            out = out.select("*", *[F.lit(row[n]).alias(n) for _, n in ps])
    return out


def kth_smallest(df: DataFrame, c: str, by: Sequence[str], ranks: DataFrame) -> DataFrame:
    """Exact k-th smallest value of a whole-number column (0-based ``k`` per group, from ``ranks(by..., k)``; ranks
    beyond a group give no row)."""
    by = list(by)
    rows = df.where(F.col(c).isNotNull()).join(ranks.select(*by, F.col("k").cast("long").alias("_k")), by)
    # the rank rides in front of the value's group
    found = radix_select(rows.select(*by, "_k", F.col(c).cast("long").alias("_x")), [*by, "_k"],
                         lambda n: F.array(F.struct(F.col("_k").alias("rank"))), lambda x: F.shiftright(x, 48), lambda x: x)
    return found.select(*by, F.col("_k").alias("k"), "value")
