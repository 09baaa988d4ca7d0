"""Byte-pair encoding of whole texts, with tree concatenation for long unsplit pieces.

A piece (the unit inside which merges happen) is encoded by applying the
lowest-ranked merge again and again. Long pieces are cut into halves down to
leaves; two encoded halves are joined by encoding a window of tokens around the
seam anew and growing it until its first and last token equal the old ones.
Every pair of adjacent tokens in the result then is one that the merges leave
alone, which makes the joined sequence the encoding of the whole.

Texts with very long unsplit runs are spread over tasks: their leaves are rows,
encoded in parallel, and only the seams are worked on when they meet again.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestar.llm.common import remove, written

TOKENIZER = "word_bpe_49k.json"
#: pieces up to this many symbols are merged directly
LEAF = 48
#: texts with an unsplit run of this many characters have it encoded by several tasks, in parts of PART
LONG, PART = 1 << 16, 1 << 14
#: entries of the caches for recurring runs and pieces (memory bound only: a full cache starts anew)
RUNS, PIECES = 1 << 18, 1 << 16
NONE = 1 << 62  # above any rank
#: fixed values: Unicode white space, and the tokenizer's piece pattern
WHITE = "\t-\r \x85\xa0  -     　"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + WHITE + r"\p{L}\p{N}]+"


def tokenizer_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


class Encoder:
    """Vocabulary and merges of a word-end BPE file, with its encoding of texts."""

    def __init__(self, path: str):
        import regex
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.end = spec["model"]["end_of_word_suffix"] or ""
        names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pairs = {}  # two neighbours, packed into a number, to rank and merged token, packed likewise
        self.parts = {}  # token -> base symbols
        for rank, (a, b) in enumerate(merges):
            self.pairs[vocab[a] << 32 | vocab[b]] = rank << 32 | vocab[a + b]
            self.parts.setdefault(vocab[a + b], (vocab[a], vocab[b]))
        # the byte alphabet: printable Latin-1 characters stand for themselves, the rest for 256, 257, ...
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        char = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}
        self.symbol = [vocab[char[b]] for b in range(256)]
        self.last = [vocab[char[b] + self.end] for b in range(256)]
        self.piece = regex.compile(PIECE)
        self.separator = re.compile(f"[{WHITE}]+")
        self.odd = re.compile("[\x1c-\x1f]")  # str.split() would split at these too
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, list] = {}

    def base(self, token: int) -> list[int]:
        """The base symbols of a token."""
        out, todo = [], [token]
        while todo:
            t = todo.pop()
            if t in self.parts:
                a, b = self.parts[t]
                todo += (b, a)
            else:
                out.append(t)
        return out

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply merges, lowest rank first and leftmost among equals."""
        s = list(symbols)
        if len(s) > LEAF:
            return self._merge_many(s)
        get, none = self.pairs.get, NONE
        ranks = [get(a << 32 | b, none) for a, b in zip(s, s[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            s[i] = best & 0xFFFFFFFF
            del s[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(s[i - 1] << 32 | s[i], none)
            if i < len(ranks):
                ranks[i] = get(s[i] << 32 | s[i + 1], none)
        return s

    def _merge_many(self, s: list[int]) -> list[int]:
        """``merge`` with a heap of candidate pairs over a linked list."""
        pairs, n = self.pairs, len(s)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(p, i, s[i], s[i + 1]) for i in range(n - 1) if (p := pairs.get(s[i] << 32 | s[i + 1])) is not None]
        heapify(heap)
        while heap:
            p, i, x, y = heappop(heap)
            j = after[i]
            if s[i] != x or j < 0 or s[j] != y:
                continue  # one of the two has been merged meanwhile
            s[i], s[j] = p & 0xFFFFFFFF, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := pairs.get(s[a] << 32 | s[b])) is not None:
                    heappush(heap, (p, a, s[a], s[b]))
        return [x for x in s if x >= 0]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of two encoded neighbours' concatenation."""
        if not a or not b:
            return a + b
        i = j = 1
        while True:
            window = [x for t in a[len(a) - i:] for x in self.base(t)] + [x for t in b[:j] for x in self.base(t)]
            w = self.merge(window)
            left = i == len(a) or w[0] == a[-i]
            right = j == len(b) or w[-1] == b[j - 1]
            # one token that spans the window can't stand for both sides
            if left and right and (len(w) > 1 or (i == len(a) and j == len(b))):
                return a[:len(a) - i] + w + b[j:]
            if not left or (len(w) == 1 and i < len(a)):
                i = min(len(a), 2 * i)
            if not right or (len(w) == 1 and j < len(b)):
                j = min(len(b), 2 * j)

    def tree(self, symbols: list[int]) -> list[int]:
        if len(symbols) <= LEAF:
            return self.merge(symbols)
        mid = len(symbols) // 2
        return self.join(self.tree(symbols[:mid]), self.tree(symbols[mid:]))

    def symbols(self, text: str, final: bool = True) -> list[int]:
        raw = text.encode()
        out = list(map(self.symbol.__getitem__, raw))
        if final and raw:
            out[-1] = self.last[raw[-1]]
        return out

    def word(self, piece: str) -> list[int]:
        got = self.pieces.get(piece)
        if got is None:
            got = self.tree(self.symbols(piece))
            if len(piece) <= LEAF:
                if len(self.pieces) >= PIECES:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got

    def chunk(self, chunk: str) -> bytes:
        """Ids (32-bit, as bytes) of a run without white space."""
        got = array("i", [i for p in self.piece.findall(chunk) for i in self.word(p)]).tobytes()
        if len(chunk) <= LEAF:
            if len(self.chunks) >= RUNS:
                self.chunks.clear()
            self.chunks[chunk] = got
        return got

    def _normal(self, t: str) -> list[str]:
        """Runs of a text without special tokens, normalised."""
        if not t.isascii():
            t = unicodedata.normalize("NFC", t).replace("Σ", "σ")  # no final sigma
        t = t.lower()
        return [x for x in self.separator.split(t) if x] if self.odd.search(t) else t.split()

    def runs(self, text: str | None) -> Iterator[list[str] | int]:
        """Lists of runs of the normalised text, and between them the ids of special tokens."""
        text, at = text or "", 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield self._normal(text[at:m.start()])
            yield self.special[m.group()]
            at = m.end()
        yield self._normal(text[at:])

    def encode(self, text: str | None) -> tuple[np.ndarray, str]:
        known, got = self.chunks.get, []
        for part in self.runs(text):
            if isinstance(part, int):
                got.append(np.int32(part).tobytes())
            else:
                got += [known(x) or self.chunk(x) for x in part]
        ids = np.frombuffer(b"".join(got), np.int32)
        return ids, self.decode(ids.tolist())

    def decode(self, ids: list[int]) -> str:
        """Tokens' names joined by spaces (the vocabulary file has no decoder of its own)."""
        return " ".join(map(self.names.__getitem__, ids))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """One encoder per Python worker."""
    path = tokenizer_path(path)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _unsplit(text: Column) -> Column:
    return F.coalesce((F.char_length(text) >= LONG) & text.rlike(rf"\S{{{LONG},}}"), F.lit(False))


def encode(docs: DataFrame, columns: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Rows of ``docs`` as struct ``doc`` (``columns``, or all) with ids (array<int>) and decoded (string).

    Null and empty texts have no ids and decode to an empty text; special
    tokens' strings in a text are special tokens. Repeated rows are encoded
    each; an empty table gives an empty result.
    """
    columns = columns or docs.columns
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("doc"), docs["text"].alias("text"))
    doc_type = rows.schema["doc"].dataType.simpleString()

    def short(batches):
        e = encoder(path)
        for b in batches:
            ids, names, ends = [], [], [0]
            for t in b.column("text").to_pylist():
                i, n = e.encode(t)
                ids.append(i)
                names.append(n)
                ends.append(ends[-1] + len(i))
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                 pa.array(names, pa.string())], ["doc", "ids", "decoded"])

    out = rows.where(~_unsplit(F.col("text"))).mapInArrow(short, f"doc {doc_type}, ids array<int>, decoded string")
    return out.unionByName(_encode_long(rows.where(_unsplit(F.col("text"))), doc_type, path))


def _encode_long(rows: DataFrame, doc_type: str, path: str | None) -> DataFrame:
    """Texts with long unsplit runs: parts are encoded as rows of their own, then joined."""
    spark = rows.sparkSession
    staged = written(rows, "bpe-long")
    if staged.isEmpty():
        remove(spark, staged)
        return spark.createDataFrame([], f"doc {doc_type}, ids array<int>, decoded string")
    keyed = staged.select("doc", "text", F.concat_ws(":", "_metadata.file_name", "_metadata.row_index").alias("key"))

    def cut(batches):
        e = encoder(path)
        for b in batches:
            for key, text in zip(b["key"], b["text"]):
                out, plain = [], []  # (unit, part, whole, final, text): a unit is some plain runs or one long piece
                def flush():
                    if plain:
                        out.append((len(units), 0, True, True, " ".join(plain)))
                        units.append(0)
                        plain.clear()
                units: list[int] = []
                size = 0
                for runs in e.runs(text):
                    if isinstance(runs, int):
                        flush()
                        out.append((len(units), 0, True, False, e.names[runs]))
                        units.append(0)
                        continue
                    for p in (p for run in runs for p in ([run] if len(run) < PART else e.piece.findall(run))):
                        if len(p) < PART:
                            plain.append(p)
                            size += len(p)
                            if size >= PART:
                                flush()
                                size = 0
                        else:
                            flush()
                            out += [(len(units), k, False, at + PART >= len(p), p[at:at + PART])
                                    for k, at in enumerate(range(0, len(p), PART))]
                            units.append(0)
                flush()
                out = out or [(0, 0, True, True, "")]
                yield pd.DataFrame([(key, *x) for x in out], columns=["key", "unit", "part", "whole", "final", "text"])

    def parts(batches):
        e = encoder(path)
        for b in batches:
            ids = []
            for whole, final, t in zip(b["whole"], b["final"], b["text"]):
                if whole:
                    # plain runs are normalised already, and free of special tokens
                    ids.append([e.special[t]] if not final else np.frombuffer(
                        b"".join(e.chunks.get(x) or e.chunk(x) for x in t.split(" ") if x), np.int32).tolist())
                else:
                    ids.append(e.tree(e.symbols(t, final)))
            yield b.assign(ids=ids)[["key", "unit", "part", "ids"]]

    def meet(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        e, ids = encoder(path), []
        for _, u in b.sort_values(["unit", "part"]).groupby("unit", sort=True):
            level = [[int(i) for i in x] for x in u["ids"]]
            while len(level) > 1:
                level = [e.join(*level[k:k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
            ids += level[0]
        return pd.DataFrame({"k": [key[0]], "ids": [ids], "decoded": [e.decode(ids)]})

    pieces = keyed.select("key", "text").mapInPandas(cut, "key string, unit int, part int, whole boolean, final boolean, text string")
    encoded = pieces.repartition(F.xxhash64("key", "unit", "part") % F.lit(4096)).mapInPandas(
        parts, "key string, unit int, part int, ids array<int>")
    joined = encoded.groupBy("key").applyInPandas(meet, "k string, ids array<int>, decoded string")
    return keyed.join(joined, F.col("key") == F.col("k")).select("doc", "ids", "decoded")
