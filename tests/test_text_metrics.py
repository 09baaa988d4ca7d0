import itertools

import numpy as np
from pyspark.sql import functions as F

from lodestar.operators import metrics as M
from lodestar.operators import text as T


def test_fuzzy_matches_brute_force(spark):
    cands = ["red widget", "blue bolt", "hot gear", "small gizmo", "small ring"]
    queries = ["widget red", "blue blt", "hot gear national", "smal ring", "zzz"]
    c = spark.createDataFrame([(n, i) for i, n in enumerate(cands)], "name string, cert int")
    q = spark.createDataFrame([(n,) for n in queries], "company string")
    got = {r.company: (r.cert, r.match_score) for r in T.fuzzy_best_match(q, "company", c, "name", "cert", "cert").collect()}

    def key(s):
        return " ".join(sorted(s.split()))
    want = {}
    for qs in queries:
        best = None
        for i, cs in enumerate(cands):
            sc = T.indel_ratio(key(qs), key(cs))
            if sc >= 88 and (best is None or sc > best[1]):
                best = (i, sc)
        if best:
            want[qs] = best
    assert got == want


def test_keyword_whole_text(spark):
    docs = spark.createDataFrame([("a", "Fees fees FEES and the bank êtrement word1 " + "late " * 3)], "g string, t string")
    out = {r.word: r["count"] for r in T.keyword_counts(docs, "t", ["g"]).collect()}
    assert out == {"fees": 3, "late": 3}


def test_auc_and_ap_against_brute_force(spark):
    rng = np.random.default_rng(3)
    s = np.round(rng.random(300), 2)
    y = (rng.random(300) < s).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    auc = M.roc_auc(df, "s", "y").first().auc
    pos, neg = s[y == 1], s[y == 0]
    brute = np.mean([(p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)])
    assert abs(auc - brute) < 1e-12
    ap = M.average_precision(df, "s", "y").first().average_precision
    order = sorted(set(s), reverse=True)
    want, prev_r = 0.0, 0.0
    for t in order:
        tp = ((s >= t) & (y == 1)).sum()
        fp = ((s >= t) & (y == 0)).sum()
        r = tp / y.sum()
        want += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    assert abs(ap - want) < 1e-12


import pytest


@pytest.mark.parametrize("cutoff", [30.0, 60.0, 75.0, 80.0, 88.0, 95.0])
def test_fuzzy_exact_on_random_typos(spark, cutoff):
    """The prefix-filtered join finds exactly the brute-force best matches."""
    rng = np.random.default_rng(7)
    alphabet = list("abcdefghij ")
    cands = sorted({"".join(rng.choice(alphabet, size=rng.integers(4, 16))).strip() or "x" for _ in range(60)})
    queries = []
    for s in cands[:40]:
        s2 = list(s)
        for _ in range(rng.integers(0, 3)):
            op = rng.integers(0, 3)
            pos = int(rng.integers(0, len(s2) + 1))
            if op == 0 and s2:
                del s2[min(pos, len(s2) - 1)]
            elif op == 1:
                s2.insert(pos, str(rng.choice(alphabet[:-1])))
            elif s2:
                s2[min(pos, len(s2) - 1)] = str(rng.choice(alphabet[:-1]))
        queries.append("".join(s2).strip() or "y")
    c = spark.createDataFrame([(n, i) for i, n in enumerate(cands)], "name string, cert int")
    q = spark.createDataFrame([(n,) for n in set(queries)], "company string")
    got = {r.company: (r.cert, round(r.match_score, 9))
           for r in T.fuzzy_best_match(q, "company", c, "name", "cert", "cert", cutoff).collect()}

    def key(s):
        return " ".join(sorted(s.split()))
    want = {}
    for qs in set(queries):
        best = None
        for i, cs in enumerate(cands):
            sc = T.indel_ratio(key(qs), key(cs))
            if sc >= cutoff and (best is None or sc > best[1]):
                best = (i, round(sc, 9))
        if best:
            want[qs] = best
    assert got == want and len(want) > 5
