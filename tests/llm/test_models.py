"""Learned operators: quality, toxicity, language model; and the pipeline."""
import functools
import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import context_tree as C, subword, toxicity as X
from lodestar.llm.common import fold, most_frequent, sampled

from .test_groups import LOWER, brute_components, brute_fingerprint


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(1)
    words = "the of and to in is it that for on with as this by from".split()
    rows = []
    for i in range(400):
        w = r.choices(words, k=r.randint(8, 40))
        bad, toxic = i % 7 == 0, i % 9 == 0
        if toxic:
            w[2:2] = ["you", r.choice(["grumbo", "grumbish", "grumber"])] * 2
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w), int(not bad), int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int").cache()
    return d.select("doc_id", "text"), d.select("doc_id", "quality", "toxic"), {i: (q, t) for i, _, q, t in rows}


# ---- quality

def test_slices_give_the_features_of_the_whole(monkeypatch):
    t = " ".join(random.Random(2).choices(["alpha", "été", "b", "b"], k=400))
    ids, share = subword.counted(t)
    monkeypatch.setattr(subword, "SLICE", 97)
    ids2, share2 = subword.counted(t)
    # only the pairs of words that a cut separates are missing
    assert abs(len(ids) - len(ids2)) < 10 and len(set(ids) & set(ids2)) > 0.9 * len(ids)


def test_equal_words_have_equal_buckets_wherever_they_stand():
    a = set(subword.counted("straße")[0].tolist())
    b = set(subword.counted("x y straße zz")[0].tolist())
    assert len(a - b) == 0


def brute_features(text):
    """Buckets of a text's features, one by one: byte n-grams, words, pairs of words, marks of repeats."""
    raw, wrap, odd = (text or "").encode(), (1 << 64) - 1, 0x9E3779B97F4A7C15

    def bucket(h, salt):
        h = (h + salt) * odd & wrap
        h ^= h >> 29
        return ((h * 0xBF58476D1CE4E5B9 & wrap) >> 47) % subword.BUCKETS
    out = [bucket(int.from_bytes(raw[i:i + g], "big"), g) for g in subword.GRAMS for i in range(len(raw) - g + 1)]
    words = [sum((c + 1) * pow(odd, k, 1 << 64) for k, c in enumerate(w)) & wrap for w in re.findall(rb"[^\x20\x09-\x0D]+", raw)]
    out += [bucket(w, 100) for w in words]
    return out + [subword.BUCKETS if a == b else bucket((a * 31 + b) & wrap, 101) for a, b in zip(words, words[1:])]


def test_quality_scores_equal_brute_force(texts):
    """Shares and probabilities of whole texts, and learned vectors, feature by feature."""
    r = np.random.default_rng(1)
    m = subword.Model(r.integers(-subword.FIXED, subword.FIXED, subword.BUCKETS + 1), 0.25)
    for t in texts:
        f = brute_features(t)
        n = Counter(f)
        ids, share = subword.counted(t)
        assert dict(zip(ids.tolist(), share.tolist())) == pytest.approx({k: c / len(f) for k, c in n.items()}, rel=1e-6)
        z = 0.25 + (sum(int(m.score[k]) for k in f) / len(f) / subword.FIXED if f else 0)
        assert m.probability(t) == pytest.approx(1 / (1 + math.exp(-z)))
    few = [t for t in texts if t and len(t) < 120][:8]
    y = [i % 2 for i in range(len(few))]
    got = subword.train(subword.Counted(pa.chunked_array([pa.array(few)])), np.array(y))
    rng = np.random.default_rng(subword.SEED)
    vec = rng.uniform(-1 / subword.DIM, 1 / subword.DIM, (subword.BUCKETS + 1, subword.DIM))
    out, bias = np.zeros((2, subword.DIM)), np.log([(y.count(0) + .5) / (len(y) + 1), (y.count(1) + .5) / (len(y) + 1)])
    done = 0
    for _ in range(subword.EPOCHS):
        for k in rng.permutation(len(y)):
            rate = subword.RATE * (1 - done / (subword.EPOCHS * len(y)))
            done += 1
            f = Counter(brute_features(few[k]))
            total = sum(f.values())
            doc = sum(c / total * vec[i] for i, c in f.items())
            p = np.exp(out @ doc + bias)
            p /= p.sum()
            p[y[k]] -= 1
            back = p @ out
            out, bias = out - rate * np.outer(p, doc), bias - rate * .1 * p
            for i, c in f.items():
                vec[i] = vec[i] - rate * len(f) ** .5 * c / total * back
    assert got.bias == pytest.approx(bias[1] - bias[0], abs=1e-5)
    seen = sorted({i for t in few for i in brute_features(t)})
    assert got.score[seen] / subword.FIXED == pytest.approx(vec[seen] @ (out[1] - out[0]), abs=1e-4)


def test_quality_learns(labelled):
    docs, labels, truth = labelled
    model = subword.fit(docs, labels, "quality", ~fold(F.col("doc_id"), 5, 0))
    got = subword.score(docs, model).select("doc.doc_id", "score", fold(F.col("doc.doc_id"), 5, 0).alias("out")).collect()
    held = [r for r in got if r["out"]]
    assert held and all((r["score"] >= 0.3) == bool(truth[r["doc_id"]][0]) for r in held)
    kept = subword.kept_rows(docs, labels, ~fold(F.col("doc_id"), 5, 0))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["score"] >= 0.3}


def test_quality_of_odd_rows(docs, no_docs, labelled):
    labels = labelled[1]
    nothing = subword.fit(docs, labels.where("false"), "quality", F.lit(True))
    assert nothing.probability(None) == pytest.approx(0.5)
    got = subword.score(docs, nothing)
    assert got.count() == docs.count() and got.select("doc.*").columns == docs.columns
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert subword.score(no_docs, nothing).count() == 0
    odd = labels.unionByName(labels.selectExpr("null doc_id", "quality", "toxic").limit(3)).unionByName(labels.limit(5))
    subword.fit(docs, odd, "quality", F.lit(True))


def test_five_grams_count_and_features_need_not_be_held(monkeypatch):
    assert subword.SAMPLE >= 4000
    assert sum(len(x) for x in subword.features(np.frombuffer(b"abcdefgh", np.uint8), 8)) == 6 + 5 + 4 + 1
    texts = pa.chunked_array([pa.array(["good text here", None, "bad words there", ""] * 5)])
    labels = np.array([1, 0, 0, 1] * 5)
    a = subword.train(subword.Counted(texts), labels)
    monkeypatch.setattr(subword, "HELD", 100)
    b = subword.train(subword.Counted(texts), labels)
    assert a.bias == b.bias and (a.score == b.score).all() and a.score.any()


# ---- toxicity

def classes(g, text):
    return g.classified(X.LETTERS.findall(text.lower()))[2]


@pytest.mark.parametrize("text,pattern", [
    ("a moron walks", (X.INSULT, 0, 0, 0)), ("you are a moron", (X.INSULT, 1, 0, 0)), ("moron that you are", (X.INSULT, 1, 0, 0)),
    ("he is not stupid", (X.INSULT, 1, 1, 0)), ("the paper said the loser left", (X.INSULT, 0, 0, 1)), ("we will kill it", (X.THREAT, 0, 0, 0)),
    ("i will kill you", (X.THREAT, 1, 0, 0)), ("never hurt them", (X.THREAT, 1, 1, 0)), ("we are going to make you pay", (X.THREAT, 1, 0, 0)),
    ("i wish they were dead", (X.THREAT, 1, 0, 0)), ("a waste of space", (X.INSULT, 0, 0, 0)), ("nobody likes you", (X.INSULT, 0, 1, 0)),
    ("he said you will regret it", (X.THREAT, 1, 0, 1))])
def test_clauses(text, pattern):
    assert [p for _, p in X.matches(classes(X.Grammar(), text))] == [pattern]


def test_patterns_reads_whole_texts_clause_by_clause():
    g = X.Grammar()
    long = "filler words here. " * 5000
    out = g.patterns(long + "You idiot! It was said: not a fool. " + long + "moron")
    n = {p: v for p, v in zip(X.PATTERNS, out) if v}
    assert n == {(X.INSULT, 1, 0, 0): 1.0, (X.INSULT, 0, 1, 0): 1.0, (X.INSULT, 0, 0, 0): 1.0}
    assert not g.patterns("classical skilled pigeons, a. unmoron").any() and not g.patterns(None).any()


def brute_patterns(g, text):
    """Clauses cut one by one; phrases found by trying each at each place; scopes by looking back and ahead."""
    out = Counter()
    for clause in re.split(r"[.!?;:\n]+(?:\s|$)", (text or "").lower()):
        # inside a clause the machine starts anew after a sign that no space follows, at an event's clause only
        words = X.LETTERS.findall(clause)
        kind = [X.INSULT if g.strength(w) else g.classes.get(w, X.OTHER) for w in words]
        target = [k == X.TARGET for k in kind]
        full = list(kind)
        for k, phrases in X.PHRASES.items():
            for phrase in phrases:
                ws = phrase.split()
                for i in range(len(words) - len(ws) + 1):
                    if all(w == words[i + j] or w == "*" and target[i + j] for j, w in enumerate(ws)):
                        end = i + len(ws) - 1
                        if kind[end] not in (X.INSULT, X.THREAT):
                            full[end] = max(full[end], k) if full[end] in (X.INSULT, X.THREAT) else k
        for i, k in enumerate(full):
            if k in (X.INSULT, X.THREAT):
                near = lambda c, lo, hi: any(full[j] == c for j in range(max(0, lo), min(len(full), hi)))
                t = near(X.TARGET, i - X.SCOPE, i) or near(X.TARGET, i + 1, i + 1 + X.SCOPE)
                out[k, int(t), int(near(X.NEGATION, i - X.SCOPE, i)), int(near(X.REPORT, 0, i))] += g.strength(words[i]) or 1.0
    return [out[p] for p in X.PATTERNS]


def test_patterns_equal_a_search_of_each_clause():
    r = random.Random(6)
    g = X.Grammar({"grumb": 0.9}, {"zzq": 0.8})
    words = [*(w for ws in X.WORDS.values() for w in ws.split()), *(w.replace("*", "you") for ps in X.PHRASES.values() for p in ps for w in p.split()),
             "grumble", "zzq", "table", "walks", "house"] * 2 + [p.replace("*", "them") for ps in X.PHRASES.values() for p in ps] * 4
    for _ in range(400):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", " ", ". ", "! ", ", ", "; "]) for _ in range(r.randint(1, 40)))
        assert g.patterns(text) == pytest.approx(brute_patterns(g, text)), text


def test_long_texts_of_triggers_take_a_time_in_proportion():
    g = X.Grammar()
    def took(n):
        began = time.process_time()
        g.patterns("you idiot walks, " * n)
        g.patterns("you idiot. " * n)
        return time.process_time() - began
    assert took(160_000) < 8 * max(took(40_000), 0.2)


def test_toxicity_learns_stems_and_spares_clean_texts(labelled):
    docs, labels, truth = labelled
    g = X.fit(docs, labels, ~fold(F.col("doc_id"), 4, 2))
    assert any("grumb".startswith(s) or s.startswith("grumb") for s in [*g.stems, *g.words])
    got = X.score(docs, g).select("doc.doc_id", "score", fold(F.col("doc.doc_id"), 4, 2).alias("out")).collect()
    held = [r for r in got if r["out"]]
    assert held and all((r["score"] >= 0.3) == bool(truth[r["doc_id"]][1]) for r in held)


def test_toxicity_of_odd_rows(docs, no_docs, labelled):
    g = X.fit(docs, labelled[1].where("false"), F.lit(True))
    assert g.probability("you pathetic moron") > 0.3 > g.probability(None)
    assert X.score(docs, g).count() == docs.count()
    assert X.score(no_docs, g).count() == 0


# ---- language model

def naive(contexts, train, depth):
    """Probability of the next byte by the definition: the ratio of the weighted
    probabilities of the counts with and without it."""
    kept = {b""} | contexts
    counts = {}
    for raw in train:
        data = C.END * depth + raw
        for i in range(depth, len(data)):
            path = [b""]
            while len(path) <= depth and data[i - len(path):i] in kept:
                path.append(data[i - len(path):i])
            leaf = path[-1]
            inner = any(len(k) == len(leaf) + 1 and k.endswith(leaf) for k in kept)
            for c in path + ([leaf + b"*rest"] if inner else []):
                counts.setdefault(c, Counter())[data[i]] += 1

    def kt(c):
        a, b = c
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def node(ctx, prefix, k, extra):
        c = [0, 0]
        for byte, n in counts.get(ctx, {}).items():
            if byte >> (8 - k) == prefix:
                c[byte >> (7 - k) & 1] += n
        if ctx in extra:
            c[extra[ctx]] += 1
        own = kt(c)
        if ctx.endswith(b"*rest"):
            return own
        children = [x for x in kept if len(x) == len(ctx) + 1 and x.endswith(ctx)]
        if not children:
            return own
        below = sum(node(x, prefix, k, extra) for x in children) + node(ctx + b"*rest", prefix, k, extra)
        return math.log(.5) + np.logaddexp(own, below)

    def log10(raw):
        data, total = C.END * depth + raw, 0.0
        for i in range(depth, len(data)):
            path = [b""]
            while len(path) <= depth and data[i - len(path):i] in kept:
                path.append(data[i - len(path):i])
            if any(len(k) == len(path[-1]) + 1 and k.endswith(path[-1]) for k in kept):
                path.append(path[-1] + b"*rest")
            for k in range(8):
                prefix, bit = data[i] >> (8 - k), data[i] >> (7 - k) & 1
                total += (node(b"", prefix, k, dict.fromkeys(path, bit)) - node(b"", prefix, k, {})) / math.log(10)
        return total
    return log10


def weighted(raws, depth):
    """log10 probability of a text's bytes by mixing down the tree of all contexts: counts in dictionaries, one bit node at a time."""
    counts, children = Counter(), {}
    for raw in raws:
        data = C.END * depth + raw
        for i in range(depth, len(data)):
            for k in range(depth + 1):
                ctx = data[i - k:i]
                if k:
                    children.setdefault(ctx[1:], set()).add(ctx)
                for j in range(8):
                    counts[ctx, j, data[i] >> (8 - j), data[i] >> (7 - j) & 1] += 1

    def own(ctx, j, prefix):
        a, b = counts[ctx, j, prefix, 0], counts[ctx, j, prefix, 1]
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @functools.cache
    def whole(ctx, j, prefix):
        if len(ctx) == depth:
            return own(ctx, j, prefix)
        below = sum(whole(c, j, prefix) for c in children.get(ctx, ()))
        return math.log(.5) + np.logaddexp(own(ctx, j, prefix), below)

    def log10(raw):
        data, total = C.END * depth + raw, 0.0
        for i in range(depth, len(data)):
            for j in range(8):
                prefix, bit = data[i] >> (8 - j), data[i] >> (7 - j) & 1
                p, left = 0.0, 1.0
                for k in range(depth + 1):
                    ctx = data[i - k:i]
                    n = [counts[ctx, j, prefix, x] for x in (0, 1)]
                    if not sum(n):
                        p, left = p + left / 2, 0.0
                        break
                    stop = 1.0 if k == depth else math.exp(math.log(.5) + own(ctx, j, prefix) - whole(ctx, j, prefix))
                    p += left * stop * (n[bit] + .5) / (sum(n) + 1)
                    left *= 1 - stop
                total += math.log10(p + left / 2)
        return total
    return log10


def test_scores_mix_over_all_counted_contexts(spark, monkeypatch):
    r = random.Random(8)
    texts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=400)) for _ in range(10)] + ["", None, "zzz Ünseen 123"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ref = weighted([C.stream(t)[1] for t in texts[:12]], C.DEPTH)
    for chunk, part, held, batch in [(C.CHUNK, C.PART, C.HELD, C.BATCH), (500, 300, 1000, 7)]:
        for name, x in (("CHUNK", chunk), ("PART", part), ("HELD", held), ("BATCH", batch), ("SLICE", held)):
            monkeypatch.setattr(C, name, x)
        for x in C.score(d, F.col("doc_id") != 12).collect():
            assert x["score"] == pytest.approx(ref(C.stream(x["doc"]["text"])[1]), rel=1e-5)


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_table_of_the_tree_equals_the_definition(spark, depth):
    texts = ["abra cad", "abba", "", None, "cab a"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "zzz", "cad abba"])], "doc_id long, text string")
    raws = [C.stream(t)[1] for t in texts]
    kept = {(C.END * depth + raw)[i - k:i] for raw in raws for i in range(depth, depth + len(raw)) for k in range(1, depth + 1)}
    ref = naive(kept, raws, depth)
    for x in C.score(d, F.col("doc_id") < 5, depth=depth).collect():
        assert x["score"] == pytest.approx(ref(C.stream(x["doc"]["text"])[1]), rel=1e-5)


def test_bytes_probabilities_add_up(spark):
    """After contexts seen in part, in whole or not at all."""
    seen = C.codes(C.stream("alpha beta gamma " * 50 + "delta")[1])
    keys, n = np.unique(seen, return_counts=True)
    contexts = [*(int(k) >> 8 for k in keys[:5]), int.from_bytes(b"ahpzz", "big"), 0]
    rows = [(int(k), int(c)) for k, c in zip(keys, n)] + [(c << 8 | b, 0) for c in contexts for b in range(256)]
    logs = C.gram_logs(spark.createDataFrame(rows, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    total = Counter()
    for r in logs.collect():
        if r["gram"] >> 8 in contexts:
            total[r["gram"] >> 8] += 10 ** r["log"]
    assert set(total) == set(contexts) and all(abs(x - 1) < 1e-4 for x in total.values())


@pytest.mark.parametrize("frequent", [0, 3, 10_000])
def test_base_scores(docs, frequent):
    train = ~fold(F.col("doc_id"), 7, 2)
    rows = docs.select("text", F.coalesce(train, F.lit(True)).alias("t")).collect()
    c = Counter(w for r in rows if r["t"] for w in [*C.stream(r["text"])[0], C.END])
    n, v = sum(c.values()), len(c)
    got = C.score(docs, train, frequent=frequent).collect()
    assert len(got) == len(rows)
    for r in got:
        w = [*C.stream(r["doc"]["text"])[0], C.END]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))


def test_model_beats_uniform_and_takes_empty_tables(docs, no_docs):
    got = C.score(docs, F.lit(True)).collect()
    assert sum(r["score"] for r in got) > sum(-math.log10(256) * r["n_bytes"] for r in got) / 2
    assert C.score(no_docs, F.lit(True)).count() == 0
    untrained = C.score(docs, F.lit(False)).collect()
    assert all(r["score"] == pytest.approx(-math.log10(256) * r["n_bytes"], rel=1e-5) for r in untrained)


@pytest.mark.parametrize("size", [0, 1, 5, 40, 10_000])
def test_most_frequent_and_samples(spark, size):
    r = random.Random(3)
    n = [r.choice([1, 1, 1, 2, 3, 5, 900, 70_000]) * r.randint(1, 3) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(n)), "w long, n long")
    got = [x["n"] for x in most_frequent(rows, "n", size).collect()]
    assert len(got) <= size and sorted(got) == sorted(x for x in n if got and x >= min(got))
    cut = next(c for c in [0, *sorted(set(n))] if sum(x > c for x in n) <= size)
    assert len(got) == sum(x > cut for x in n)
    assert most_frequent(rows.where("false"), "n", size).count() == 0
    if size:
        a, b = ({x["w"] for x in sampled(d, "w", size).collect()} for d in (rows, rows.repartition(5)))
        assert a == b and len(a) == min(size, 500)


# ---- pipeline

def test_pipeline_equals_brute_force(spark, tmp_path):
    r = random.Random(9)
    words = "the of and to in is it that for on with as this by from straße".split()
    texts = [" ".join(r.choices(words, k=r.randint(5, 60))) for _ in range(150)]
    texts += [t.upper() for t in texts[:10]] + texts[10:15] + [t + " end" for t in texts[20:30]] + ["", None]
    texts += [" ".join(x.upper() + "!!" for x in r.choices(words, k=20)) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 5}" if i % 6 else None, i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int("!!" not in (t or "")), 0) for i, t, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    got = Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))

    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    model = subword.fit(docs, labels, "quality", ~fold(F.col("doc_id"), 5, 0))
    keep = [x for x in rows if model.probability(x[1]) >= 0.3]
    assert len(keep) < len(rows) - 30
    best = {}
    for x in keep:
        best[(x[1] or "").translate(LOWER)] = x
    keep = list(best.values())
    fps = [brute_fingerprint(x[1]) for x in keep]
    first = set(brute_components([x[0] for x in keep], fps))
    keep = [x for x in keep if x[0] in first]
    size = lambda x: len((x[1] or "").encode().split())
    total, sizes = sum(map(size, keep)), Counter()
    for x in keep:
        sizes[x[3]] += size(x)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, capped = {s: k % 3 + 1 for k, s in enumerate(order)}, set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and level * weight[s] > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    from tokenizers import Tokenizer
    from lodestar.llm import bpe
    t = Tokenizer.from_file(bpe.tokenizer_path(None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for s in order:
        target = 3 * sizes[s] if s in capped else level * weight[s]
        copies = int(target // sizes[s]) if sizes[s] else 0
        budget, upto = target - copies * sizes[s], 0
        h = lambda x: int(hashlib.md5(str(x[0]).encode()).hexdigest()[:15], 16)
        for x in sorted((x for x in keep if x[3] == s), key=h):
            over = upto + size(x) - budget
            extra = upto <= budget and (over <= 0 or budget - upto > over)
            upto += size(x)
            ids = t.encode(x[1] or "", add_special_tokens=False).ids
            row = (x[0], len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
            want[row] += copies + extra
    assert got == +want
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    empty = docs.where("false")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0
        if k < 4:
            assert out.columns == columns
