"""Language-model scores by context-tree weighting over bytes.

A text is its words (A-Z lower-cased) joined by single spaces, then one end
byte. Each byte is eight binary decisions; a decision's node is a context (the
0 to DEPTH bytes before it) and the bits of the byte so far. A node holds the
Krichevsky-Trofimov estimate of its counts, and a context's weighted
probability mixes its own estimate with the product of its children's, half
and half, over all depths.

The counts are those of all (DEPTH + 1)-byte sequences of all training texts,
added up in Spark, and every counted context is a node: ``score`` keeps the tree
as a table of sequences, dealt out by the latest SPLIT bytes of context. Each
part weighs the subtrees it holds and sends the weights of their roots up; the
levels above (contexts of fewer than SPLIT bytes, so bounded by the alphabet) are
weighed once and handed back to the parts, which work out the log probability
of each sequence that occurs in any text. Texts meet these by chunk: a chunk
asks for its distinct sequences once.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestar.llm.common import chunk_rows, chunks, most_frequent, nullable, remove, written

#: bytes of context
DEPTH = 5
#: bytes of context by which the tree is dealt out; distinct sequences in a part, roughly
SPLIT, PART = 3, 1 << 16
#: bytes of text in a chunk
CHUNK = 1 << 24
#: scale of the whole numbers in which weights are added up over parts (in any order alike)
FIXED = 1 << 20
#: words whose counts every task holds; rarer ones are looked up by a join
FREQUENT = 50_000
END, END_WORD = b"\n", "\n"
#: sequences sorted in memory at once, and handed on in a batch; distinct words counted in memory
HELD, BATCH, WORDS = 1 << 24, 1 << 16, 1 << 19
#: bytes scored at once
SLICE = 1 << 20


def stream(text: str | None) -> tuple[list[bytes], bytes]:
    """Words of a text, and its bytes as the model reads them."""
    words = (text or "").encode().lower().split()
    return words, b" ".join(words) + END


def codes(raw: bytes, depth: int = DEPTH) -> np.ndarray:
    """One number for each byte: itself in the low bits, above it the bytes before, latest first.
    A text is preceded by end bytes."""
    b = np.frombuffer(END * depth + raw, np.uint8).astype(np.int64)
    out = b[depth:].copy()
    for k in range(1, depth + 1):
        out |= b[depth - k:len(b) - k] << (8 * k)
    return out


def sliced(raw: bytes, depth: int = DEPTH):
    """``codes`` of a text, SLICE bytes at a time."""
    for lo in range(0, len(raw), SLICE):
        # a slice of a long text brings its context along
        yield codes(raw[max(0, lo - depth):lo + SLICE], depth)[min(lo, depth):]


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5 (Stirling's series after a shift by 6)."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(6):
        shift += np.log(y)
        y += 1
    i = 1 / y
    i2 = i * i
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + i * (1 / 12 - i2 * (1 / 360 - i2 / 1260)) - shift


def _asked(depth: int):
    """Distinct sequences of each chunk, with their counts in its training texts. The sequences are sorted in place (the
    lowest bit: from a training text) and handed on in small batches; a chunk longer than HELD gives several such lists."""
    def ask(batches):
        for rows in batches:
            for chunk, blob in zip(rows.column("chunk").to_pylist(), rows.column("rows")):
                held, n = np.empty(HELD, np.int64), 0  # memory is taken as it fills

                def counted():
                    held[:n].sort()
                    first = [np.zeros(1, np.int64)]
                    for lo in range(1, n, SLICE):
                        hi = min(n, lo + SLICE)
                        first.append(np.flatnonzero((held[lo:hi] ^ held[lo - 1:hi - 1]) >> 1) + lo)
                    first = np.concatenate(first)
                    for lo in range(0, len(first), BATCH):
                        at = first[lo:lo + BATCH]
                        end = first[lo + BATCH] if lo + BATCH < len(first) else n
                        c = np.add.reduceat(held[at[0]:end] & 1, at - at[0])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), chunk, np.int64)), pa.array(held[at] >> 1), pa.array(c)],
                                                         ["chunk", "gram", "n"])
                for b in chunk_rows(blob):
                    for t, train in zip(b.column("text").to_pylist(), b.column("train").to_pylist()):
                        for part in sliced(stream(t)[1], depth):
                            if n + len(part) > len(held):
                                yield from counted()
                                n = 0
                            held[n:n + len(part)] = part << 1 | bool(train)
                            n += len(part)
                if n:
                    yield from counted()
    return ask


def _at(gram: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of the eight bit nodes on the way to each sequence's byte: the last ``depth``
    bytes of context, and in the low byte a one before the bits so far."""
    k = np.arange(8)
    bits = 1 << k | (gram & 255)[:, None] >> 8 - k
    return ((gram >> 8 & (1 << 8 * depth) - 1) << 8)[:, None] | bits


def _ones(gram: np.ndarray) -> np.ndarray:
    """The eight bits of each sequence's byte."""
    return (gram & 255)[:, None] >> 7 - np.arange(8) & 1


def _climb(d: int, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None, low: int):
    """Levels ``low`` to ``d``, each as (bit nodes, probability of a one, share of the own estimate), and what
    the level above them starts with. ``below``: the children's log weights, None at the deepest level."""
    levels = []
    while True:
        zeros, ones = zeros.astype(np.float64), ones.astype(np.float64)
        own = _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1) - math.log(math.pi)
        weight = own if below is None else math.log(0.5) + np.logaddexp(own, below)
        stop = np.ones(len(key)) if below is None else np.exp(math.log(0.5) + own - weight)
        levels.insert(0, (key, (ones + 0.5) / (zeros + ones + 1), stop))
        if not d:
            return levels, None
        key, up = np.unique(key & (1 << 8 * d) - 1, return_inverse=True)
        zeros, ones, below = (np.bincount(up, x, len(key)) for x in (zeros, ones, weight))
        d -= 1
        if d < low:
            return levels, (key, zeros, ones, below)


def _subtrees(gram: np.ndarray, n: np.ndarray, depth: int, low: int):
    """``_climb`` from the sequences counted."""
    seen = n > 0
    gram, n = gram[seen], n[seen].astype(np.float64)
    key, at = np.unique(_at(gram, depth).ravel(), return_inverse=True)
    bits, n = _ones(gram).ravel(), np.repeat(n, 8)
    return _climb(depth, key, np.bincount(at, n * (1 - bits), len(key)), np.bincount(at, n * bits, len(key)), None, low)


def _log10(gram: np.ndarray, levels: list) -> np.ndarray:
    """log10 probability of each sequence's byte after its context. Below the deepest
    counted node nothing is counted, and a bit has probability one half."""
    mix, left = np.zeros(8 * len(gram)), np.ones(8 * len(gram))
    for d, (key, p, stop) in enumerate(levels):
        if not len(key):
            break
        want = _at(gram, d).ravel()
        i = np.minimum(np.searchsorted(key, want), len(key) - 1)
        found = key[i] == want
        mix += np.where(found, left * stop[i] * p[i], 0)
        left *= np.where(found, 1 - stop[i], 1)
    one = np.clip(mix + left / 2, 1e-9, 1 - 1e-9).reshape(-1, 8)
    return np.log10(np.where(_ones(gram) == 1, one, 1 - one)).sum(axis=1)


def gram_logs(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, log): log10 probability of the last byte of each sequence of ``grams`` (gram, n)
    under the tree of all contexts counted there (n of 0: only asked for)."""
    spark, low = grams.sparkSession, min(SPLIT, depth)
    parts = grams.count() // PART + 1
    root = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * low) - 1).cast("long"))
    dealt = grams.select("gram", "n", F.pmod(F.xxhash64(root), F.lit(parts)).alias("part"))

    def up(rows: pa.Table) -> pa.Table:
        _, (key, zeros, ones, below) = _subtrees(rows["gram"].to_numpy(), rows["n"].to_numpy(), depth, low)
        return pa.table({"key": key, "zeros": zeros.astype(np.int64), "ones": ones.astype(np.int64),
                         "below": np.rint(below * FIXED).astype(np.int64)})

    # contexts of fewer than SPLIT bytes
    top = dealt.where("n > 0").groupBy("part").applyInArrow(up, "key long, zeros long, ones long, below long")
    top = top.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toArrow().sort_by("key")
    key, zeros, ones, below = (top.column(c).to_numpy() for c in ("key", "zeros", "ones", "below"))
    upper, _ = _climb(low - 1, key, zeros, ones, below / FIXED, 0)
    shared = spark.sparkContext.broadcast(upper)

    def down(rows: pa.Table) -> pa.Table:
        gram = rows["gram"].to_numpy()
        levels, _ = _subtrees(gram, rows["n"].to_numpy(), depth, low)
        return pa.table({"gram": gram, "log": _log10(gram, shared.value + levels).astype(np.float32)})

    return dealt.groupBy("part").applyInArrow(down, "gram long, log float")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts, each with one end token."""
    def count(batches):
        c: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                c.update(stream(t)[0])
                c[END] += 1
            if len(c) >= WORDS:
                yield _word_rows(c)
                c = Counter()
        if c:
            yield _word_rows(c)

    return docs.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _word_rows(c: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in c], pa.string()), pa.array(list(c.values()), pa.int64())],
                                      ["word", "c"])


def score(docs: DataFrame, train_on: Column, columns: list[str] | None = None, depth: int = DEPTH,
          frequent: int = FREQUENT) -> DataFrame:
    """Rows of ``docs`` as struct ``doc`` (``columns``, or all) with n_tokens, n_known,
    train_tokens, base_score, score, n_bytes and bits_per_byte.

    Learned from the rows that fulfil ``train_on`` (a null condition counts as
    yes). A null or empty text has one token, its end. Rows that repeat are
    scored each; an empty table gives an empty result, and without training
    rows every byte has probability 1/256.
    """
    spark = docs.sparkSession
    train = docs.where(F.coalesce(train_on, F.lit(True)))
    vocabulary = written(word_counts(train), "lm-words")
    size = vocabulary.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, distinct = size["n"] or 0, size["v"]
    top = most_frequent(vocabulary, "c", frequent).select("word", "c").toArrow()
    common = {w.encode(): math.log10(c + 1) for w, c in zip(top["word"].to_pylist(), top["c"].to_pylist())}
    shared = spark.sparkContext.broadcast(common)  # bounded by ``frequent``
    columns = columns or docs.columns
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("doc"), docs["text"].alias("text"),
                       F.coalesce(train_on, F.lit(True)).alias("train"))
    packed = written(rows.mapInArrow(chunks(CHUNK), "chunk long, rows binary"), "lm-chunks")
    asked = written(packed.mapInArrow(_asked(depth), "chunk long, gram long, n long"), "lm-asked", "zstd")
    grams = written(asked.groupBy("gram").agg(F.sum("n").alias("n")), "lm-grams", "zstd")
    logs = written(gram_logs(grams, depth), "lm-logs", "zstd")
    remove(spark, grams)  # before the next exchange needs room
    told = asked.select("chunk", "gram").join(logs, "gram")
    schema = (f"doc {rows.schema['doc'].dataType.simpleString()}, n_tokens long, known long, part double, score double, "
              "n_bytes long, rare array<struct<word:string,times:long>>")

    def measure(chunk: pa.Table, told: pa.Table) -> pa.Table:
        get, out = shared.value.get, []
        place, logs = pd.Index(told["gram"].to_numpy()), told["log"].to_numpy()
        if not place.is_unique:  # a chunk that was counted in several lists
            first = ~place.duplicated()
            place, logs = place[first], logs[first]
        for b in chunk_rows(chunk["rows"][0]):
            rows = []
            for t in b.column("text").to_pylist():
                words, raw = stream(t)
                words.append(END)
                known = [get(w, 0.0) for w in words]
                rare = Counter(w for w, x in zip(words, known) if not x)
                total = math.fsum(float(logs[place.get_indexer(c)].sum(dtype=np.float64)) for c in sliced(raw, depth))
                rows.append((len(words), len(words) - sum(rare.values()), math.fsum(known), total, len(raw),
                             [{"word": w.decode(), "times": k} for w, k in rare.items()]))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(),
                     pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())]))]
            doc = b.column("doc")
            out.append(pa.RecordBatch.from_arrays([doc.cast(nullable(doc.type)), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))],
                                                  ["doc", "n_tokens", "known", "part", "score", "n_bytes", "rare"]))
        return pa.Table.from_batches(out)

    measured = written(packed.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(measure, schema), "lm-measured")
    remove(spark, packed, asked, logs)
    at = measured.select("*", F.xxhash64("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    # words beyond the frequent ones: a join on words that are rare in training
    wanted = at.select("file", "row", F.explode("rare").alias("r")).select("file", "row", "r.word", "r.times")
    found = wanted.join(vocabulary, "word").groupBy("file", "row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("extra"))
    found = written(found.withColumnsRenamed({"file": "f", "row": "r"}), "lm-rare")
    all_ = at.join(found, (F.col("file") == F.col("f")) & (F.col("row") == F.col("r")), "left")
    base = F.col("part") + F.coalesce("extra", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(tokens + distinct + 1))
    return all_.select("doc", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
                       F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes",
                       (-F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"))
