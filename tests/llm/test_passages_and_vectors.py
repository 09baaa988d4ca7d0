"""Suffix-array dedup, hard negatives and whitening."""
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import hard_negatives as H, queries, suffix_dedup as S, vectors, whitening as Z


# ---- suffix-array dedup

def brute_passages(texts, length):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if n[b[i:i + length]] > 1:
                gone[i:i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        out.append((len(b), int(gone.sum()), [(int(x), int(y)) for x, y in edge.reshape(-1, 2)],
                    bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])))
    return out


def stripped(df, **how):
    return {r["doc"]["doc_id"]: (r["n_bytes"], r["n_removed"], [tuple(x) for x in r["spans"]], bytes(r["kept"]))
            for r in S.deduplicate(df, **how).collect()}


def passages(seed, letters, n=60):
    r = random.Random(seed)
    parts = ["".join(r.choices(letters, k=r.randint(5, 150))) for _ in range(8)]
    texts = [None, "", "aaaa" * 50, "ab" * 120]
    texts += ["".join(r.choice(parts) if r.random() < .6 else "".join(r.choices(letters, k=r.randint(1, 60)))
                      for _ in range(r.randint(1, 5))) for _ in range(n)]
    return texts + texts[5:15]


@pytest.mark.parametrize("seed,length,gram,bucket,chunk,letters", [
    (1, 24, 6, S.BUCKET, S.CHUNK, "abcdefgh "), (2, 40, 8, 300, 500, "ab"), (3, 9, 3, 200, 300, "abc é"), (5, 40, 40, 400, 1000, "abcd")])
def test_passages_equal_brute_force(spark, seed, length, gram, bucket, chunk, letters):
    """Also with buckets so small that they are dealt out again down to single strings."""
    texts = passages(seed, letters)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for c in ("doc", "chunk", "key", "digest", "rows", "many", "kept"):
        df = df.withColumn(c, F.lit("clash"))
    want = brute_passages(texts, length)
    assert sum(x[1] for x in want)
    assert stripped(df, length=length, gram=gram, bucket=bucket, chunk=chunk) == dict(enumerate(want))
    if seed == 3:
        assert stripped(df.repartition(7), length=length, gram=gram) == dict(enumerate(want))


def test_a_passage_that_every_text_shares(spark):
    """One bucket's windows differ in all texts; a long text repeats itself."""
    r = random.Random(9)
    shared = "".join(r.choices("abcdefghij ", k=700))
    texts = ["".join(r.choices("klmnopqrst ", k=r.randint(0, 300))) + shared + "".join(r.choices("klmnopqrst ", k=r.randint(0, 300)))
             for _ in range(40)]
    long = "".join(r.choices("uvwxyz ", k=30_000))
    texts += [long + "".join(r.choices("uvwxyz ", k=900)) + long[5000:6000], "x" * 399, "y" * 400, "y" * 401]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert stripped(df, bucket=4000) == stripped(df) == dict(enumerate(brute_passages(texts, S.LENGTH)))


def test_a_frequent_key_is_dealt_out_where_it_lies(spark, monkeypatch):
    """Windows of a bucket too large are cut without an exchange by key, which would bring them all into one task."""
    r = random.Random(12)
    shared = "".join(r.choices("abcdefghij ", k=700))
    texts = ["".join(r.choices("klmnopqrst ", k=300)) + shared + "".join(r.choices("klmnopqrst ", k=300)) for _ in range(30)]
    plans, stored = {}, S.written
    def written(df, name, *how):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name, *how)
    monkeypatch.setattr(S, "written", written)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert stripped(df, bucket=4000) == dict(enumerate(brute_passages(texts, S.LENGTH)))
    assert plans["suffix-pieces"] and not any("hashpartitioning(key" in p for p in plans["suffix-pieces"])
    assert len(plans["suffix-inner"]) == len(plans["suffix-pieces"])


def test_slices_and_empty_tables(spark, docs, no_docs, monkeypatch):
    b = np.frombuffer("".join(random.Random(4).choices("abc", k=5000)).encode(), np.uint8)
    ends = np.array([0, 700, 700, 720, 5000])
    def starts(find):
        return sorted((a, s, h) for a, lo, hi, h in zip(*(x.tolist() for x in find.windows(b, ends))) for s in range(lo, hi + 1))
    assert starts(S.Finder(50, 8, 97)) == starts(S.Finder(50, 8))
    assert S.deduplicate(no_docs).count() == 0
    assert S.deduplicate(docs).count() == docs.count()


def test_windows_of_a_chunk_take_little_memory():
    """A chunk of 4 MB is hashed in slices that take less than ten times its bytes, the result included."""
    import tracemalloc
    b = np.random.default_rng(1).integers(97, 123, S.CHUNK).astype(np.uint8)
    ends = np.arange(2000, len(b) + 1, 2000)
    tracemalloc.start()
    try:
        S.Finder().windows(b, ends)
        assert tracemalloc.get_traced_memory()[1] < 10 * len(b)
    finally:
        tracemalloc.stop()


def test_blind_tries_order_and_compare():
    r = random.Random(3)
    for _ in range(200):
        strings = [b"12345678" + bytes(r.choices(b"ab", k=r.randint(0, 12))) for _ in range(r.randint(2, 30))]
        order, shared = S.blind_trie(strings, 8)
        assert [strings[i] for i in order] == sorted(strings)
        for k in range(1, len(order)):
            x, y = strings[order[k - 1]], strings[order[k]]
            assert shared[k] == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_longest_matches_equal_brute_force():
    r = random.Random(8)
    b = np.frombuffer(bytes(r.choices(b"ab", k=400)) + bytes(r.choices(b"abcdefgh", k=200)) * 2, np.uint8)
    pos = np.array(r.sample(range(len(b) - 60), 200))
    bucket, end = np.array(r.choices(range(5), k=200)), pos + 60
    got = S.longest_matches(b, pos, end, bucket, 16)
    def shared(x, y):
        return next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    for i in range(200):
        best = max((shared(b[pos[i]:end[i]], b[pos[j]:end[j]]) for j in range(200) if j != i and bucket[j] == bucket[i]), default=0)
        assert got[i] == max(best, 15)


# ---- hard negatives

def whole(rows):
    rows = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], *z) for i, v, *z in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = max((len(v) for _, v, *_ in rows), default=0)
    return [(i, v + [0] * (d - len(v)), *z) for i, v, *z in rows]


def brute_negatives(rows, k=5):
    rows, out = [r for r in whole(rows) if r[0] is not None and r[2] is not None], set()
    for a in {i for i, *_ in rows if i % 100 == 0}:
        label, v = min((z, v) for i, v, z in rows if i == a)
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, z) for i, w, z in rows if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            fit = [(t, i) for t, i, z in scored if z != label and 80 * -s <= 100 * -t <= 100 * -s]
            out |= {(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(fit[:k])}
    return out


@pytest.mark.parametrize("d,n,labels", [(1, 150, 2), (7, 700, 3), (32, 1500, 4)])
def test_negatives_equal_brute_force(spark, d, n, labels, monkeypatch):
    r = np.random.default_rng(d)
    centre = r.normal(size=(5, d))
    rows = [(i, [float(x) for x in (centre[i % 5] + r.normal(size=d) * .4) * r.choice([0.2, 1, 3])], int(r.integers(labels))) for i in range(n)]
    common = rows[3][1]
    rows += [(n + i, common, i % labels) for i in range(40)] + [
        (n + 100, None, 0), (n + 101, [float("nan")] * d, 0), (n + 102, [None] * d, 1), (None, common, 0), (n + 104, common, None),
        (n + 105, common[:d // 2], 1), (n + 106, [0.0] * d, 0), (1000, [0.0] * d, 1), (1100, [-x for x in common], 0)]
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], "vec_id long, embedding array<float>, label int, id string, norm int")
    monkeypatch.setattr(vectors.by_length, "__defaults__", (150,))
    monkeypatch.setattr(vectors.search, "__defaults__", (2, 5))
    got = H.mine(df, F.col("id") % 100 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert {tuple(x) for x in got.collect()} == brute_negatives(rows)


def test_coordinates_prune_and_lose_none():
    r = np.random.default_rng(2)
    m = np.floor(256 * r.normal(size=(3000, 16)) * np.geomspace(1, .02, 16))
    b = H.buckets(vectors.Block(np.arange(3000), np.zeros(3000, np.int64), m))
    assert sum(len(x.ids) for x in b) == 3000 and all(x.top >= y.top for x, y in zip(b, b[1:]))
    kept = 0
    for q in m[:20]:
        unit = q / np.linalg.norm(q)
        for x in b:
            got = x.candidates(unit, np.argsort(-np.abs(unit))[:H.FOCUS], .9)
            assert set(np.flatnonzero(x.unit @ unit >= .9)) <= set(got)
            kept += len(got)
    assert kept < 20 * 3000 / 2


@pytest.mark.parametrize("same", [True, False])
def test_buckets_scored_whole_give_what_lists_give(same, monkeypatch):
    r = np.random.default_rng(6)
    m = np.floor(256 * (x := r.normal(size=(1200, 12))) / np.linalg.norm(x, axis=1)[:, None])
    m[40:60] = m[0]
    c = vectors.Block(np.arange(1200) % 1190, np.arange(1200) % 4, m)
    q = vectors.Block(c.ids[::40], c.labels[::40], m[::40], np.full((30, 2), -np.inf), np.full((30, 2), np.inf))
    q.lo[:, 1], q.hi[:, 1] = 20000, 50000
    found = []
    for dense in (0, np.inf):  # always, never
        monkeypatch.setattr(H, "DENSE", dense)
        found.append({*zip(*(x.tolist() for x in H.pruned(5, same)(q, c)))})
    assert found[0] == found[1] and len(found[0]) > 30 * 5
    want = sorted((-float(m[j] @ q.m[3]), int(c.ids[j])) for j in range(1200) if (c.labels[j] == q.labels[3]) == same and c.ids[j] != q.ids[3])[:5]
    assert sorted((-s, w) for i, slot, w, s in found[0] if i == q.ids[3] and slot == 1) == want


def test_negatives_of_nothing(spark):
    assert H.mine(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), F.col("id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(100, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert H.mine(one, F.col("id") % 100 == 0).count() == 0


def test_rounds_send_queries_to_blocks_they_can_reach_only(spark):
    """Thresholds of the longest block end the search of all later ones."""
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=8) * (100 if i < 50 else .01)], 0) for i in range(2000)]
    v = vectors.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), label="label")
    blocks, parts = vectors.by_length(v, 8, 100)
    everything = F.array(F.struct(F.lit(0.0).alias("lo"), F.lit(float("inf")).alias("hi")))
    seen = spark.sparkContext.accumulator(0)

    def score(q, c):
        seen.add(len(q.ids))
        return H.pruned(5, True)(q, c)
    found = vectors.search(v.where("id < 20").withColumn("slots", everything), blocks, parts, 8, score, 5)
    assert parts == 20 and found.count() == 100 and seen.value < 20 * 6


# ---- whitening

@pytest.mark.parametrize("d", [1, 2, 3, 40])
def test_eigenvectors_of_clusters_and_ranks(d):
    r = np.random.default_rng(d)
    q = np.linalg.qr(r.normal(size=(d, d)))[0]
    for values in (np.geomspace(9, .1, d), np.where(np.arange(d) < 3, 5.0, 1.0), np.full(d, 7.0), np.arange(d) == 0.0):
        c = (q * values) @ q.T
        c = (c + c.T) / 2
        k = min(4, d)
        e, x = Z.principal(c, k)
        assert np.allclose(e, np.sort(values)[::-1][:k], atol=1e-13) and np.allclose(x @ x.T, np.eye(k), atol=1e-13)
        assert np.allclose(c @ x.T, x.T * e, atol=1e-12)


def brute_whitening(rows, k=4):
    rows = whole(rows)
    fit = np.array(sorted({tuple(v) for _, v, *_ in rows}), np.int64)
    n, total = len(fit), fit.sum(axis=0)
    x = fit - total / n
    e, u = np.linalg.eigh(x.T @ x / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [(i, n, sum((n * a - int(s)) ** 2 for a, s in zip(v, total)), (np.array(v) - total / n) @ u / np.sqrt(e), e / np.trace(x.T @ x / n))
            for i, v, *_ in rows]


@pytest.mark.parametrize("d,n", [(5, 80), (40, 900)])
def test_whitening_equals_numpy(spark, d, n):
    r = np.random.default_rng(d)
    rows = [(i, [float(x) for x in r.normal(size=d) * np.geomspace(1, .2, d) + 3]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(200)] + [(n + 900, None), (n + 901, [None] * d), (n + 902, [float("inf")] * d),
                                                       (None, rows[4][1]), (n + 903, rows[5][1][:2]), (1, rows[1][1])]
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], "vec_id long, embedding array<float>, id string, v int").repartition(5)
    got: dict = {}
    for x in Z.whiten(df).collect():
        got.setdefault((x["id"], x["component"]), []).append(x)
    want = brute_whitening(rows)
    assert sum(map(len, got.values())) == 4 * len(want)
    sign = [np.sign(got[7, c + 1][0]["whitened"] * want[7][3][c]) for c in range(4)]
    for i, m, dev, w, share in want:
        for c in range(4):
            x = got[i, c + 1][0]
            assert (x["n"], x["deviation"]) == (m, dev) and x["identity_error"] < 1e-9
            assert abs(x["whitened"] - sign[c] * w[c]) < 1e-9 and abs(x["explained"] - share[c]) < 1e-12


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert Z.whiten(spark.createDataFrame([], schema)).count() == 0
    got = Z.whiten(spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0]), (3, [2.0, 3.0])], schema)).collect()
    assert len(got) == 6 and all((r["n"], r["deviation"], r["whitened"], r["explained"]) == (1, 0, None, None) for r in got)
    got = Z.whiten(spark.createDataFrame([(1, [2.0, 3.0]), (2, [4.0, 3.0]), (3, [1e14, 5.0])], schema)).collect()
    assert len(got) == 6 and all(r["deviation"] is None for r in got)
    got = Z.whiten(spark.createDataFrame([(1, [2.0, 3.0]), (2, [4.0, 3.0])], schema)).collect()
    assert {(r["id"], r["component"], r["whitened"] is None) for r in got} == {(1, 1, False), (1, 2, True), (2, 1, False), (2, 2, True)}


def test_queries_keep_the_contract_columns(spark, tmp_path):
    emb = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0], i % 3) for i in range(300)], "vec_id long, embedding array<float>, label int")
    emb.write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, "a" * 500), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op11(spark, str(tmp_path)).dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    assert [r["n_removed"] for r in queries.op11(spark, str(tmp_path)).orderBy("doc_id").collect()] == [500, 0]
    assert dict(queries.op12(spark, str(tmp_path)).dtypes) == dict.fromkeys(("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"), "bigint") | {"rank": "int"}
    assert dict(queries.op13(spark, str(tmp_path)).dtypes) == dict.fromkeys(("vec_id", "n", "deviation"), "bigint") | {"component": "int"} | dict.fromkeys(("whitened", "explained", "identity_error"), "double")
