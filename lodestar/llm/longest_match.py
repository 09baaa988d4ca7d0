"""Token counts by greedy longest match, in one pass over each word's bytes.

The vocabulary is a trie. Each node knows how many tokens are popped when the
text leaves it (``pops``) and where matching goes on (``fail``): the node that
spells what is left of its string after those tokens. Counting therefore never
backs up and never builds the pieces.

A word is matched as one space followed by its bytes, so that tokens with a
leading space serve word starts and the others continue words.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

VOCABULARY = "byte_bpe_50k.tiktoken"
#: entries of the cache for recurring words (memory bound only)
CACHE = 1 << 18


def read_vocabulary(path: str | None) -> list[bytes]:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    def __init__(self, vocabulary: list[bytes]):
        self.next: dict[int, int] = {}  # node << 8 | byte -> node; node 0 is the root
        parent, ends = [(0, 0)], [False]
        for token in vocabulary:
            node = 0
            for c in token:
                to = self.next.get(node << 8 | c)
                if to is None:
                    to = len(parent)
                    self.next[node << 8 | c] = to
                    parent.append((node, c))
                    ends.append(False)
                node = to
            if token:
                ends[node] = True
        depth = np.zeros(len(parent), np.int64)
        for v in range(1, len(parent)):  # a parent comes before its children
            depth[v] = depth[parent[v][0]] + 1
        # fail: None where no token sequence can cover what was read
        self.pops, self.fail = [0] * len(parent), [None] * len(parent)
        for v in np.argsort(depth, kind="stable")[1:].tolist():
            if ends[v]:
                self.pops[v], self.fail[v] = 1, 0
                continue
            u, c = parent[v]
            pops, z = self.pops[u], self.fail[u]
            while z is not None and (z << 8 | c) not in self.next:
                pops += self.pops[z]
                z = self.fail[z]
            if z is not None:
                self.pops[v], self.fail[v] = pops, self.next[z << 8 | c]
        self.seen: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Tokens of a space followed by ``word`` (1, for an unknown one, if no tokens cover it)."""
        step, pops, fail, node, n = self.next, self.pops, self.fail, 0, 0
        for c in b" " + word:
            to = step.get(node << 8 | c)
            while to is None:
                n += pops[node]
                node = fail[node]
                if node is None:
                    return 1
                to = step.get(node << 8 | c)
            node = to
        while node:
            n += pops[node]
            node = fail[node]
            if node is None:
                return 1
        return n

    def text(self, text: str | None) -> tuple[int, int]:
        """Words and tokens of a whole text."""
        words, seen, n = (text or "").encode().split(), self.seen, 0
        for w in words:
            k = seen.get(w)
            if k is None:
                k = self.count(w)
                if len(w) <= 64:
                    if len(seen) >= CACHE:
                        seen.clear()
                    seen[w] = k
            n += k
        return len(words), n


_AUTOMATA: dict = {}


def automaton(path: str | None) -> Automaton:
    if path not in _AUTOMATA:
        _AUTOMATA[path] = Automaton(read_vocabulary(path))
    return _AUTOMATA[path]


def token_counts(text: Column, path: str | None = None) -> Column:
    """struct<n_words, n_tokens> of a text column; null and empty texts have none of either."""
    @pandas_udf("n_words long, n_tokens long")
    def f(t: pd.Series) -> pd.DataFrame:
        a = automaton(path)
        return pd.DataFrame([a.text(x) for x in t], columns=["n_words", "n_tokens"], dtype="int64")
    return f(text)


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Every row of ``docs`` as struct ``doc`` with n_words and n_tokens."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("doc"),
                       token_counts(docs["text"], path).alias("t"))
    return rows.select("doc", "t.n_words", "t.n_tokens")
