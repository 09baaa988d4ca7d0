"""Operators that bring rows together: dedup, SimHash, mixing, top-k."""
import hashlib
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import dedup, mixing, queries, simhash, topk, vectors
from lodestar.llm.common import UPPER

LOWER = str.maketrans(UPPER, UPPER.lower())


def saved(spark, df, folder, name="documents"):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


# ---- exact dedup

@pytest.mark.parametrize("digest", [None, lambda t: F.length(t).cast("string")])
def test_dedup_equals_brute_force(docs, digest):
    rows = docs.select("doc_id", "text").collect()
    norm = lambda t: (t or "").translate(LOWER)
    n, best = Counter(norm(r["text"]) for r in rows), {}
    for r in rows:
        if r["doc_id"] is not None:
            best[norm(r["text"])] = max(best.get(norm(r["text"]), -1), r["doc_id"])
    got = dedup.deduplicate(docs, digest=digest).collect()
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        t = norm(r["doc"]["text"])
        assert (r["keep_id"], r["group_size"]) == (best.get(t), n[t])
        if r["kept"]:
            kept[t] += 1
            assert r["doc"]["doc_id"] == best.get(t)
        if digest is None:
            assert r["digest"] == hashlib.sha256(t.encode()).hexdigest()
    assert kept == Counter(n.keys())


def test_dedup_of_files_in_several_batches(spark, docs, tmp_path):
    plain = docs.select("doc_id", "text")
    files = spark.read.parquet(saved(spark, plain.repartition(5), tmp_path) + "/documents.parquet")
    one = dedup.deduplicate(files).select("doc.doc_id", "keep_id", "group_size").collect()
    many = dedup.deduplicate(files, files_per_batch=1).select("doc.doc_id", "keep_id", "group_size").collect()
    assert Counter(one) == Counter(many)


def test_dedup_keeps_columns_and_empty_tables(docs, no_docs):
    assert dedup.kept_rows(docs).columns == docs.columns
    assert dedup.kept_rows(no_docs).count() == 0
    assert dedup.kept_rows(docs.where("doc_id is null")).count() == 1


# ---- SimHash

def test_golay_neighbours_share_an_index():
    r = np.random.default_rng(1)
    words = r.integers(0, 1 << 23, 3000)
    at, index = simhash.golay_indices(words)
    sets = [set() for _ in words]
    for i, x in zip(at, index):
        sets[i].add(int(x))
    assert {len(s) for s in sets} <= {1, 6}
    for bit in range(23):
        near_at, near = simhash.golay_indices(words ^ (1 << bit))
        met = np.zeros(len(words), bool)
        for i, x in zip(near_at, near):
            met[i] |= int(x) in sets[i]
        assert met.all()


def test_keys_miss_no_link():
    r = random.Random(2)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, 2)):
            b ^= 1 << bit
        ka, kb = simhash.golay_keys(np.array([a, b], np.uint64).view(np.int64))
        assert set(ka.tolist()) & set(kb.tolist())


def brute_fingerprint(t):
    import xxhash
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    best = {}
    for i, x in enumerate(ids):
        if x is not None:
            best[find(i)] = min(best.get(find(i), x), x)
    return [best.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("bucket", [1, simhash.BUCKET])
def test_simhash_equals_brute_force(docs, bucket):
    got = simhash.near_duplicates(docs, bucket=bucket).collect()
    fps = [brute_fingerprint(r["doc"]["text"]) for r in got]
    assert [r["fp"] % (1 << 64) for r in got] == fps
    assert [r["component_id"] for r in got] == brute_components([r["doc"]["doc_id"] for r in got], fps)
    kept = Counter(r["component_id"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and set(kept) == {r["component_id"] for r in got}


@pytest.mark.parametrize("bucket", [2, simhash.BUCKET])
def test_links_connect_dense_groups(spark, bucket):
    """Chains and clouds of fingerprints around shared centres, through pairs and through midpoints."""
    r = random.Random(7)
    fps = set()
    for _ in range(4):
        x = r.getrandbits(64)
        for _ in range(60):
            fps.add(x)
            x ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))
        fps |= {x ^ (1 << b) for b in range(64)}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    from lodestar.llm.components import components
    roots = {r["node"]: r["root"] for r in components(simhash._links(df, bucket)).collect()}
    mine = Counter(roots.get(int(np.uint64(f).view(np.int64)), int(np.uint64(f).view(np.int64))) for f in fps)
    want = Counter(brute_components(list(range(len(fps))), fps))
    assert sorted(mine.values()) == sorted(want.values())


def test_simhash_keeps_columns_and_empty_tables(docs, no_docs):
    assert simhash.kept_rows(docs).columns == docs.columns
    assert simhash.near_duplicates(no_docs).count() == 0


def test_long_text_is_hashed_in_slices(monkeypatch):
    t = " ".join(str(i % 977) for i in range(5000))
    whole = simhash.fingerprint_of(t)
    monkeypatch.setattr(simhash, "SLICE", 100)
    assert simhash.fingerprint_of(t) == whole == brute_fingerprint(t)


# ---- mixing

def test_mixing_equals_sql(spark, docs, tmp_path):
    folder = saved(spark, docs.select("doc_id", "text", "lang", "source"), tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    cols = "doc_id, size, source_size, target, taken"
    # the SQL joins a null id's hash by value as well
    want = con.execute(f"SELECT {cols} FROM ({queries.ORACLE['op9_mix_hash_threshold']})").fetchall()
    got = [tuple(r) for r in queries.op9(spark, folder).select(*cols.split(", ")).collect()]
    assert Counter(got) == Counter(want)


def test_mix_nears_targets_and_repeats_at_most_thrice(spark):
    rows = [(i, "w " * (1 + i % 17), s) for s, n in (("a", 1200), ("b", 60), ("c", 300), (None, 40)) for i in range(n)]
    d = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    by = {}
    for r in got:
        assert r["taken"] <= mixing.MOST * r["size"]
        by.setdefault(r["doc"]["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t - n) <= 17 for t, n in by.values())
    assert sum(t for t, _ in by.values()) == pytest.approx(sum(r["size"] for r in got))
    again = mixing.mix(d.repartition(7)).collect()
    assert {r["doc"]["doc_id"]: r["taken"] for r in got} == {r["doc"]["doc_id"]: r["taken"] for r in again}


def test_mixed_rows_and_empty_tables(docs, no_docs):
    m = {(r["doc"]["doc_id"]): r["copies"] for r in mixing.mix(docs).collect()}
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    n = Counter(r["doc_id"] for r in rows.collect())
    assert all(n[i] == m[i] * (2 if i == 12 else 1) for i in m)
    assert mixing.mix(no_docs).count() == 0


# ---- top-k

def brute_top(vectors, k=5):
    rows = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in vectors
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = max((len(v) for _, v in rows), default=0)
    rows = [(i, v + [0] * (d - len(v))) for i, v in rows]
    out = set()
    for q in {i for i, _ in rows if i % 50 == 0}:
        qv = min(v for i, v in rows if i == q)
        best = sorted(((-sum(a * b for a, b in zip(qv, v)), i) for i, v in rows if i != q))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("d,n", [(1, 80), (9, 400), (32, 1500)])
def test_top_k_equals_brute_force(spark, d, n, monkeypatch):
    r = np.random.default_rng(d)
    rows = [(i, [float(x) for x in r.normal(size=d) * r.choice([0.2, 1, 3])]) for i in range(n)]
    common = rows[3][1]
    rows += [(n + i, common) for i in range(60)] + [(n + 100, None), (n + 101, [float("nan")] * d), (n + 102, [None] * d),
                                                     (n + 103, [float("inf")] * d), (None, common), (150, common), (n + 104, []), (n + 105, common[:d // 2])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, norm int")
    monkeypatch.setattr(vectors.by_length, "__defaults__", (100,))
    monkeypatch.setattr(vectors.search, "__defaults__", (2, 7))
    got = topk.top_k(df, F.col("id") % 50 == 0)
    assert {tuple(x) for x in got.select("query_id", "rank", "vec_id", "score").collect()} == brute_top(rows)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one, F.col("id") % 50 == 0).count() == 0


def test_pruning_drops_pairs(monkeypatch):
    monkeypatch.setattr(topk, "STRIP", 64)
    r = np.random.default_rng(0)
    c = r.normal(size=(4000, 32)) * np.geomspace(10, 0.1, 4000)[:, None]
    c[:, :4] *= 5
    c = np.floor(256 * c)
    basis = np.linalg.eigh(c.T @ c)[1][:, ::-1].copy()
    s = topk.Scorer(np.arange(10), c[2000:2010], np.full(10, -np.inf), basis, 5)
    topk._feed(s, np.arange(100, 4100), c)
    assert s.pairs < 10 * 2000 and s.exact < s.pairs


def test_vector_search_bounds_what_the_driver_and_a_round_hold(spark, monkeypatch):
    """Parts end by a bounded sample however many there are, a round deals a bounded number of bytes, settings come back, and
    nothing but the result is left on disk."""
    setting, seen, dealt = "spark.sql.execution.rangeExchange.sampleSizePerPartition", {}, []
    written, before = vectors.written, spark.conf.get(setting)

    def spy(df, name, *args, **kw):
        seen.setdefault(name, spark.conf.get(setting))
        out = written(df, name, *args, **kw)
        dealt.append((name, out.inputFiles()[0].rsplit("/", 1)[0]))
        return out
    r = np.random.default_rng(3)
    rows = [(i, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(r.normal(size=(700, 8)))]
    monkeypatch.setattr(vectors, "written", spy)
    monkeypatch.setattr(vectors, "ENDS", 28)
    monkeypatch.setattr(vectors, "DEALT", 3 * 14 * 64)
    monkeypatch.setattr(vectors.by_length, "__defaults__", (50,))
    monkeypatch.setattr(vectors.search, "__defaults__", (16, 14))
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 50 == 0)
    assert {tuple(x) for x in got.select("query_id", "rank", "vec_id", "score").collect()} == brute_top(rows)
    assert seen["vector-blocks"] == "2" and spark.conf.get(setting) == before
    best = [path for name, path in dealt if name == "vector-best"]
    assert len(best) >= 6  # 14 parts, three at once
    assert [os.path.exists(path.removeprefix("file:")) for _, path in dealt] == [path == best[-1] for _, path in dealt]


def test_strips_that_bounds_drop_little_of_are_scored_whole(monkeypatch):
    """Unit vectors without leading directions: one product for a strip gives the same ranks, ties to smaller ids."""
    r = np.random.default_rng(1)
    c = np.floor(256 * (x := r.normal(size=(600, 16))) / np.linalg.norm(x, axis=1)[:, None])
    c[300:340] = c[7]
    ids = r.permutation(np.r_[np.arange(590), 3, 3, 40, 40, 500, 501, 502, 503, 504, 505])
    q = c[np.arange(0, 600, 12)]
    own = ids[np.arange(0, 600, 12)]
    monkeypatch.setattr(topk, "STRIP", 64)
    s, taken = topk.Scorer(own, q, np.full(len(q), -np.inf), np.linalg.eigh(c.T @ c)[1][:, ::-1].copy(), 5), []
    whole = s._whole
    monkeypatch.setattr(s, "_whole", lambda *a: (taken.append(1), whole(*a)))
    topk._feed(s, ids, c)
    assert taken
    for i, o in enumerate(own):
        want = sorted((-float(c[j] @ q[i]), int(ids[j])) for j in range(600) if ids[j] != o)[:5]
        assert sorted(zip((-s.best[i]).tolist(), s.who[i].tolist())) == want
