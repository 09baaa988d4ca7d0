"""Toxicity by a weighted finite-state grammar over clauses.

Tokens are mapped to classes: insult terms (a seed list, and words and word
stems learned from labels), threat verbs, targets, negation, reported speech. A
transducer over words turns the last word of an insult or threat of several words
into one. Four small transducers read the class sequence of a clause: negation and target
open a scope of a few tokens, reported speech one up to the clause's end, and
the event transducer emits insults and threats. Their composition is one
machine (its transitions are filled in as they are needed) that emits, for each
event, the pattern it stands in: kind, targeted, negated, reported. A document
is scored by its matched patterns, weighted by its terms' strength, not by
isolated words; the patterns' weights are learned from labels, drawn to prior
weights where labels say little.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from lodestar.llm.subword import labelled

#: labelled rows that lexicon and weights are learned from at most
SAMPLE = 8000
#: evidence (log likelihood ratio against the base rate) and share of label 1 that a learned term needs; lengths of stems
EVIDENCE, PURITY, STEM = 8.0, 0.85, (3, 9)
#: tokens that a negation or a target reaches over
SCOPE = 4
THRESHOLD = 0.3
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
#: fixed values: class words of the grammar in English, German, French and Spanish
WORDS = {
    INSULT: "idiot idiots moron morons loser losers stupid pathetic worthless disgusting scum trash clown dumb fool jerk "
            "imbecile bastard pig freak idiota imbécil estúpido basura idiote imbécile stupide ordure blöd dumm abschaum trottel",
    THREAT: "kill hurt destroy beat murder shoot stab crush punish attack matar destruir golpear tuer frapper détruire "
            "töten schlagen vernichten umbringen",
    TARGET: "you your yours yourself u he him she her they them their du dich dir ihr euch sie tu te toi vous ils elles "
            "tú ti usted ustedes vosotros ellos ellas",
    NEGATION: "not no never none nobody neither nor isn aren wasn don doesn didn won can't cannot nicht kein keine nie niemals "
              "ne pas jamais aucun ni nunca jamás tampoco",
    REPORT: "said says say called calls wrote writes claimed claims reported quoted quote according sagte sagt schrieb "
            "laut dit disait écrit selon dijo dice escribió según",
}
#: fixed values: insults and threats of several words; * stands for a target word
PHRASES = {
    INSULT: ["piece of garbage", "waste of space", "waste of air", "good for nothing", "nobody likes *", "nobody wants *", "* make me sick", "shut up"],
    THREAT: ["make * pay", "make * suffer", "wish * were dead", "hope * die", "hope * dies", "going to get *", "going to find *", "coming for *",
             "* will regret", "* will be sorry", "* are dead", "* deserve to die", "watch * back", "end * life"],
}
LETTERS = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+(?:\s|$)")
#: prior weights of a pattern: kind, then what targeted, negated and reported add
PRIOR = {"bias": -3.0, "density": 0.5, INSULT: 2.0, THREAT: 0.3, "targeted": 0.3, "negated": -0.7, "reported": -0.5}
PATTERNS = [(k, t, n, r) for k in (INSULT, THREAT) for t in (0, 1) for n in (0, 1) for r in (0, 1)]


def _scope(opener: int):
    """Transducer whose output is 1 for SCOPE tokens after an opener."""
    return lambda state, c: SCOPE if c == opener else max(0, state - 1)


def _from_then_on(opener: int):
    """Transducer whose output is 1 from an opener to the clause's end."""
    return lambda state, c: 1 if c == opener else state


MACHINES = (_scope(TARGET), _scope(NEGATION), _from_then_on(REPORT))


def _phrases() -> dict:
    """The phrases' transducer: from a state (the words of a phrase so far) and a word to the next state, and what
    a state that ends a phrase emits."""
    moves: dict = {"": {}}
    for kind, phrases in PHRASES.items():
        for phrase in phrases:
            words = phrase.split()
            for i, w in enumerate(words):
                moves.setdefault(" ".join(words[:i]), {})[w] = " ".join(words[:i + 1])
            moves.setdefault(phrase, {})[None] = kind
    return moves


MOVES = _phrases()
#: words that end a phrase, but for targets: where they stand a clause is read
ENDINGS = {next(w for w in reversed(p.split()) if w != "*") for ps in PHRASES.values() for p in ps}


def phrase_events(words: list[str], targets: list[bool]) -> dict[int, int]:
    """Place of the last word and kind of each phrase in a clause: all states that the transducer can be in are kept."""
    out, states = {}, set()
    for i, (w, target) in enumerate(zip(words, targets)):
        now = set()
        for state in (*states, ""):
            moves = MOVES[state]
            now |= {moves[x] for x in (w, "*" if target else w) if x in moves}
        states = now
        for state in states:
            if None in MOVES[state]:
                out[i] = max(out.get(i, -1), MOVES[state][None])
    return out


@lru_cache(None)
def step(state: tuple, c: int) -> tuple[tuple, tuple | None]:
    """The composed machine: next state, and the pattern emitted at an event."""
    emitted = (c, *(int(s > 0) for s in state)) if c in (INSULT, THREAT) else None
    return tuple(m(s, c) for m, s in zip(MACHINES, state)), emitted


def matches(classes: list[int]) -> list[tuple[int, tuple]]:
    """(position, pattern) of a clause's events. A target may also follow: the
    target scope is read from both ends."""
    behind, state = set(), 0
    target = MACHINES[0]
    for i in range(len(classes) - 1, -1, -1):
        if state and classes[i] in (INSULT, THREAT):
            behind.add(i)
        state = target(state, classes[i])
    out, state = [], (0, 0, 0)
    for i, c in enumerate(classes):
        state, p = step(state, c)
        if p:
            out.append((i, (p[0], int(p[1] or i in behind), p[2], p[3])))
    return out


@dataclass
class Grammar:
    """Lexicon (whole words and stems with strengths) and pattern weights."""
    stems: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray | None = None

    def __post_init__(self):
        self.classes = {w: c for c, ws in WORDS.items() for w in ws.split()}
        for w in WORDS[INSULT].split():
            self.words.setdefault(w, 1.0)
        if self.weights is None:
            self.weights = prior()

    def __getstate__(self):
        return {"stems": self.stems, "words": self.words, "weights": self.weights}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    @property
    def triggers(self):
        """Automaton of all terms that can make an event."""
        if not hasattr(self, "_triggers"):
            import ahocorasick
            a = ahocorasick.Automaton()
            for w in {*self.stems, *self.words, *WORDS[THREAT].split(), *ENDINGS}:
                a.add_word(w, len(w))
            a.make_automaton()
            self._triggers = a
        return self._triggers

    def strength(self, word: str) -> float:
        """Strength of an insult term (0: none); stems count for the words that begin with them."""
        s = self.words.get(word, 0.0)
        for n in range(STEM[0], min(STEM[1], len(word)) + 1):
            s = max(s, self.stems.get(word[:n], 0.0))
        return s

    def classified(self, words: list[str]) -> tuple[list[str], list[float], list[int]]:
        """A clause's words, their strengths and classes; the last word of a phrase has the phrase's."""
        strengths = [self.strength(w) for w in words]
        classes = [INSULT if s else self.classes.get(w, OTHER) for w, s in zip(words, strengths)]
        for i, kind in phrase_events(words, [c == TARGET for c in classes]).items():
            if classes[i] not in (INSULT, THREAT):
                classes[i] = kind
        return words, strengths, classes

    def patterns(self, text: str | None) -> np.ndarray:
        """Strengths summed by pattern over a whole text; only clauses with a trigger are read."""
        out = np.zeros(len(PATTERNS))
        low = (text or "").lower()
        done = -1
        for end, n in self.triggers.iter(low):
            start = end - n + 1
            if start <= done or (start and low[start - 1].isalpha()):
                continue
            a = max(low.rfind(x, done + 1, start) for x in ".!?;:\n") + 1  # what lies before was read
            m = CLAUSE.search(low, end)
            b = m.start() if m else len(low)
            a = max(a, done + 1)
            words, strengths, classes = self.classified(LETTERS.findall(low, a, b))
            for i, p in matches(classes):
                out[PATTERNS.index(p)] += strengths[i] or 1.0
            done = b
        return out

    def probability(self, text: str | None) -> float:
        z = design(self.patterns(text), len(text or "")) @ self.weights
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def design(patterns: np.ndarray, length: int) -> np.ndarray:
    """Regression inputs: a constant, the density of events, and the log of one plus each pattern's sum."""
    dense = np.log1p(1000 * patterns.sum() / (length + 200))
    return np.concatenate([[1.0, dense], np.log1p(patterns) / math.log(2)])


def prior() -> np.ndarray:
    return np.array([PRIOR["bias"], PRIOR["density"], *(PRIOR[k] + t * PRIOR["targeted"] + n * PRIOR["negated"] + r * PRIOR["reported"]
                                      for k, t, n, r in PATTERNS)])


def learn_weights(x: np.ndarray, y: np.ndarray, strength: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic weights by Newton steps, with a Gaussian prior around ``prior()``."""
    w0 = prior()
    w = w0.copy()
    hold = np.full(len(w), strength)
    hold[0] = 0.01
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + hold * (w - w0)
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(hold)
        move = np.linalg.solve(hess, grad)
        w -= np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-8:
            break
    return w


def terms_of(text: str | None) -> set[str]:
    """Words of a text, and their proper stems marked by a star."""
    out: set[str] = set()
    for w in set(LETTERS.findall((text or "").lower())):
        out.add(w)
        out.update(w[:n] + "*" for n in range(STEM[0], min(STEM[1], len(w) - 1) + 1))
    return out


def learn_terms(rows: DataFrame) -> tuple[dict, dict]:
    """(stems, words) with strengths: terms that documents of label 1 hold far more
    often than the base rate says. Documents are counted per term in Spark; all terms with enough evidence
    (of at most SAMPLE documents) come to the driver, where ``choose`` thins them out."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    n, p = total["n"] or 0, total["p"] or 0
    if not p or p == n:
        return {}, {}
    base = p / n

    def count(batches):
        for b in batches:
            yes, no = Counter(), Counter()
            for text, label in zip(b["text"], b["label"]):
                (yes if label else no).update(terms_of(text))
            keys = list(yes.keys() | no.keys())
            yield pd.DataFrame({"term": keys, "yes": [yes[k] for k in keys], "no": [no[k] for k in keys]})

    c = rows.select("text", "label").mapInPandas(count, "term string, yes long, no long").groupBy("term").agg(
        F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    share = F.col("yes") / (F.col("yes") + F.col("no"))
    ratio = (F.col("yes") * F.log(share / base)
             + F.when(F.col("no") > 0, F.col("no") * F.log((1 - share) / (1 - base))).otherwise(0.0))
    best = (c.where((F.col("yes") >= 3) & (share >= PURITY)).withColumn("evidence", ratio).where(F.col("evidence") >= EVIDENCE)
            .collect())
    return choose([(r["term"], r["yes"], r["no"]) for r in best])


def choose(best: list[tuple[str, int, int]]) -> tuple[dict, dict]:
    """(stems, words) from candidate (term, documents of label 1, of label 0). A
    stem stands back for a longer term that is nearly as frequent, and a term for
    a shorter chosen stem that is as good."""
    stems, words = {}, {}
    longer: dict[str, int] = {}  # most documents of a term that is longer than this beginning of it
    for t, y, _ in best:
        bare = t.rstrip("*")
        for k in range(STEM[0], min(STEM[1], len(bare) - 1) + 1):
            longer[bare[:k]] = max(longer.get(bare[:k], 0), y)
    for r in sorted(best, key=lambda r: (len(r[0].rstrip("*")), r[0])):
        term, stem = r[0].rstrip("*"), r[0].endswith("*")
        strength = (r[1] + 0.5) / (r[1] + r[2] + 1)
        if stem and longer.get(term, -1) >= 0.95 * r[1]:
            continue
        if any(stems.get(term[:k], 0) >= strength - 0.05 for k in range(STEM[0], len(term) + (not stem))):
            continue
        (stems if stem else words)[term] = strength
    return stems, words


def fit(docs: DataFrame, labels: DataFrame, train_on: Column, size: int = SAMPLE) -> Grammar:
    """Lexicon and weights from at most ``size`` labelled rows that fulfil ``train_on``.
    Without both labels among them, the seed lexicon and the prior weights hold."""
    rows = labelled(docs, labels, "toxic", train_on, size)
    stems, words = learn_terms(rows)
    g = Grammar(stems, words)

    @pandas_udf("array<double>")
    def f(t: pd.Series) -> pd.Series:
        return pd.Series([design(g.patterns(x), len(x or "")).tolist() for x in t])

    seen = rows.select("doc_id", f("text").alias("x"), "label").toArrow().sort_by("doc_id")
    y = seen.column("label").to_numpy()
    if len(np.unique(y)) == 2:
        x = np.array([v.as_py() for v in seen.column("x")])
        g.weights = learn_weights(x, y)
    return g


def score(docs: DataFrame, grammar: Grammar, columns: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` as struct ``doc`` (``columns``, or all) with ``score``, the
    probability that the text is toxic. Null and empty texts match no pattern.
    The score depends on the text alone, so repeated rows have equal scores; whole texts are read, in a time that grows with
    their length. Columns of any name ride along in ``doc``. An empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # terms of at most SAMPLE documents

    @pandas_udf("double")
    def f(t: pd.Series) -> pd.Series:
        return pd.Series([shared.value.probability(x) for x in t], dtype="float64")

    columns = columns or docs.columns
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("doc"), f(docs["text"]).alias("score"))
