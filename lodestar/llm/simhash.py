"""SimHash near-duplicates found through Golay-code keys.

A 64-bit fingerprint is cut into three segments (22, 21 and 21 bits). If two
fingerprints differ in at most two bits, then for one of the three cyclic pairs
(segment i, segment i+1) the first segment is equal and the second differs in
at most one bit: of the cases (2,0,0), (1,1,0), (0,1,1) ... each has such a pair.
The exact segment is used as it is; the other is decoded with the perfect
(23,12,7) Golay code to the indices of nearby codewords. A word at distance
below 3 from its codeword gets that one index; a word at distance 3 also gets
the five codewords at distance 4. Two words that differ in one bit then always
share an index: if their codewords differ, one of them lies at distance 3 from
its own and at most 4 from the other's. So the key search misses no link.
Distinct fingerprints that share a key are joined and verified by bit count.

Keys shared by more than BUCKET distinct fingerprints are not joined in pairs:
their fingerprints go through an exact linear route, in which each is listed
under itself and its 64 one-bit neighbours. Two of them share such a midpoint
if and only if they differ in at most two bits, and a midpoint has 65 members
at most, each linked to the smallest.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from lodestar.llm.common import remove, written
from lodestar.llm.components import components

SHINGLE, MAX_BITS, SEED = 3, 2, 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
#: key groups up to this many distinct fingerprints are compared in pairs
BUCKET = 24
#: fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the code
GENERATOR = 0b110001110101
#: shingles hashed at once (bounds the memory that one long text takes)
SLICE = 1 << 18


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text (no words: 0), as an unsigned int."""
    import xxhash
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    joined = b" ".join(words)
    width = min(shingle, len(words))
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, SLICE):
        hi = min(n, lo + SLICE)
        start = [0 if i == 0 else int(ends[i - 1]) + 1 for i in (lo,)] + (ends[lo:hi - 1] + 1).tolist()
        stop = ends[lo + width - 1:hi + width - 1].tolist()
        h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(start, stop)), np.uint64, hi - lo)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    @pandas_udf("long")
    def f(t: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(x, shingle) for x in t], np.uint64).view(np.int64))
    return f(text)


def syndrome(word: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words divided by the generator polynomial."""
    r = word.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        r ^= np.where(r >> bit & 1, GENERATOR << (bit - 11), 0)
    return r


@lru_cache(1)
def decoder() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome: the error pattern (weight 3 at most), and the indices
    to add for the five codewords at distance 4 (-1: none)."""
    words = np.arange(1 << 12, dtype=np.int64) << 11
    codewords = words ^ syndrome(words)  # systematic: the upper 12 bits are the index
    sevens = [int(c) for c in codewords if bin(c).count("1") == 7]
    error = np.zeros(1 << 11, np.int64)
    more = np.full((1 << 11, 5), -1, np.int64)
    for weight in range(4):
        for at in combinations(range(23), weight):
            e = sum(1 << b for b in at)
            s = int(syndrome(np.array([e]))[0])
            error[s] = e
            if weight == 3:
                more[s] = [c >> 11 for c in sevens if c & e == e]
    return error, more


def golay_indices(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (position in ``segment``) and codeword indices, 1 or 6 for each word."""
    error, more = decoder()
    s = syndrome(segment)
    first = (segment ^ error[s]) >> 11
    extra = more[s]
    at, col = np.nonzero(extra >= 0)
    return np.concatenate([np.arange(len(segment)), at]), np.concatenate([first, first[at] ^ extra[at, col]])


def golay_keys(fingerprints: np.ndarray) -> list[np.ndarray]:
    """For each fingerprint the keys (pair, exact segment, codeword index), packed into a long."""
    fp = fingerprints.astype(np.int64).view(np.uint64)
    cut = [((fp >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        at, index = golay_indices(cut[(i + 1) % 3])
        rows.append(at)
        keys.append(i << 40 | cut[i][at] << 12 | index)
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(rows, kind="stable")
    return np.split(keys[order], np.cumsum(np.bincount(rows, minlength=len(fp)))[:-1])


def _links(distinct: DataFrame, bucket: int) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect whatever links at MAX_BITS connect."""
    spark = distinct.sparkSession

    @pandas_udf("array<long>")
    def keys_of(fp: pd.Series) -> pd.Series:
        return pd.Series(golay_keys(fp.to_numpy()) if len(fp) else [])

    keyed = written(distinct.select("fp", F.explode(keys_of("fp")).alias("key")), "simhash-keys")
    sizes = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-buckets")
    shared = written(keyed.join(sizes, "key"), "simhash-shared")
    few = shared.where(F.col("n") <= bucket).select("key", F.col("fp").alias("a"))
    pairs = few.join(few.withColumnRenamed("a", "b"), "key").where(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b")
    many = shared.where(F.col("n") > bucket).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    near = written(many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid")),
                   "simhash-mid")
    centre = written(near.groupBy("mid").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("mid", "b"),
                     "simhash-centre")
    stars = near.join(centre, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b")
    out = written(pairs.unionByName(stars).distinct(), "simhash-links")
    remove(spark, keyed, sizes, shared, near, centre)
    return out


def near_duplicates(docs: DataFrame, columns: list[str] | None = None, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """Rows of ``docs`` as struct ``doc`` (``columns``, or all) with fp (signed long),
    component_id and kept (one row for each component).

    component_id is the smallest doc_id reachable over links of MAX_BITS bits.
    Texts that are null or have no words have fingerprint 0 and link like any
    other. Kept is the row with the smallest doc_id, the first by position
    among rows that repeat it. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    columns = columns or docs.columns
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("doc"), fingerprint(docs["text"], shingle).alias("fp"))
    staged = written(rows, "simhash-rows")
    if staged.isEmpty():
        return staged.select("doc", "fp", F.col("doc")["doc_id"].alias("component_id"), F.lit(True).alias("kept"))
    at = staged.select("doc", "fp", F.struct(
        F.col("doc")["doc_id"].isNull().alias("none"), F.col("doc")["doc_id"].alias("id"),
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"))
    distinct = written(at.groupBy("fp").agg(F.min("at").alias("first")), "simhash-distinct")
    roots = components(_links(distinct.select("fp"), bucket))
    rooted = written(distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first"), "simhash-rooted")
    best = written(rooted.groupBy("root").agg(F.min("first").alias("best")), "simhash-best")
    of = written(rooted.join(best, "root").select(F.col("fp").alias("f"), "best"), "simhash-of")
    remove(spark, distinct, rooted, best)
    return at.join(of, F.col("fp") == F.col("f")).select(
        "doc", "fp", F.col("best")["id"].alias("component_id"), (F.col("at") == F.col("best")).alias("kept"))


def kept_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each component."""
    return near_duplicates(docs).where("kept").select("doc.*")
