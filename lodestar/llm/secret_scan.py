"""Secret scan: fixed patterns, and values in credential contexts judged by guess cost.

A value that stands behind a credential word is cut into segments by dynamic
programming so that the product of the segments' guesses is least (logs are
summed). A segment is a dictionary word (log of its rank, plus variations), a
date, a repeat, a keyboard walk or alphabet run, or a brute-force span. Values
that are cheap to guess (placeholders, words, dates, walks) are no finding;
those at or above a threshold are reported as kind ``guess``.
"""

from __future__ import annotations

import math
import re
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from lodestar.llm.common import most_frequent, remove, written

#: findings' kinds, in the order in which equal starts are listed
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a shorter run is none, and has no longer one inside
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(r"""(?<![a-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|"""
                     r"""client[_-]?secret|auth(?:orization)?|credentials?|bearer)["']?\x20*(?:[:=]|\x20is\x20|\x20(?=[^\s]*[0-9]))"""
                     r"""\x20*(?:bearer\x20+|basic\x20+)?["']?([!-&(-~]{6,})""", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer")
#: a value's characters behind a credential word, and those that close a phrase
VALUE, CLOSING = re.compile(r"[!-&(-~]+"), "\"'.,;:)]}>"
#: a value that takes 10 ** THRESHOLD guesses or more is a finding
THRESHOLD = 10.0
#: corpus words in the guesser's dictionary: bounds what is broadcast
DICTIONARY = 20_000
LONGEST_WORD = 20
#: walks up to this long may also end before their last character
SHORT_WALK = 32
#: periods tried at every place; longer ones where so many characters recur. Stretches up to SHORT_RUN may also be taken from within
PERIODS, SHORT_RUN = 8, 64
#: fixed values: passwords that guessers try first
COMMON = ("password 123456 12345678 qwerty abc123 letmein monkey dragon iloveyou trustno1 sunshine master welcome shadow "
          "ashley football jesus michael ninja mustang password1 admin login passw0rd starwars hello freedom whatever "
          "secret token changeme change example test demo default guest root user pass key none null true false your "
          "here insert xxxx todo placeholder redacted hidden sample dummy temp lorem ipsum dolor").split()
#: fixed values: rows of a keyboard, and the alphabet
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("@4031!$57", "aaoeiisst")
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|"
                  r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)", re.A)
YEARS, DAYS = math.log10(150), math.log10(150 * 365)
#: starting a segment that is not brute force costs a choice among its kinds
SEGMENT = math.log10(5)


def _neighbours() -> set[str]:
    out = set()
    for row in ROWS:
        out |= {a + b for a, b in zip(row, row[1:])} | {b + a for a, b in zip(row, row[1:])}
    for upper, lower in zip(ROWS[:4], ROWS[1:4]):  # a key and those below it
        for i, a in enumerate(upper[1:] if upper[0] == "`" else upper):
            for b in lower[max(0, i - 1):i + 1]:
                out |= {a + b, b + a}
    return out


NEAR = _neighbours()


def brute(c: str) -> float:
    """log10 guesses of one character on its own."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isascii() and c.isalpha() else math.log10(33)


def ranks(words: list[str]) -> dict[str, float]:
    """log10 rank of the dictionary: common passwords, then ``words`` in their order."""
    out: dict[str, float] = {}
    for w in [*COMMON, *words]:
        if w not in out:
            out[w] = math.log10(len(out) + 1)
    return out


def _common(value: str, i: int, j: int) -> int:
    """How far the value's characters from ``i`` and from ``j`` > i agree."""
    n, size = 0, 16
    while j + n < len(value) and value[i + n:i + n + size] == value[j + n:j + n + size] and j + n + size <= len(value):
        n, size = n + size, size * 2
    while j + n < len(value):
        size = max(1, size // 2)
        if j + n + size <= len(value) and value[i + n:i + n + size] == value[j + n:j + n + size]:
            n += size
        elif size == 1:
            break
    return n


class Segments:
    """The segments of a value that are not brute force, worked out from each place when asked for."""

    def __init__(self, value: str, dictionary: dict[str, float]):
        self.value, self.low, self.dictionary = value, value.lower(), dictionary
        if len(self.low) != len(value):  # a letter whose lower case is longer
            self.low = "".join(c if len(c.lower()) > 1 else c.lower() for c in value)
        self.plain = self.low.translate(LEET)
        self.walk = (0, 0, [])  # the last walk met: its ends, and its turns up to each place

    def _walk(self, i: int) -> tuple[int, int, list[int]]:
        """The stretch of keys next to each other that holds place ``i``, read from there on."""
        first, last, turns = self.walk
        if not first <= i < last:
            low, j = self.low, i
            turns = [0, 0]
            while j + 1 < len(low) and low[j:j + 2] in NEAR:
                j += 1
                if j - i > 1:
                    turns.append(turns[-1] + ((low[j] > low[j - 1]) != (low[j - 1] > low[j - 2])))
            self.walk = first, last, turns = i, j, turns
        return first, last, turns

    def at(self, i: int):
        """(end, log10 guesses, kind) of the segments that start at ``i``."""
        value, low, dictionary, n = self.value, self.low, self.dictionary, len(self.value)
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            w = low[i:j]
            cost = dictionary.get(w)
            if cost is None and self.plain[i:j] != w and (cost := dictionary.get(self.plain[i:j])) is not None:
                cost += math.log10(2)
            if cost is not None:
                yield j, cost + (0 if value[i:j] == w else math.log10(2)), "word"
        m = DATE.match(value, i)
        if m:
            yield m.end(), YEARS if m.end() - i == 4 else DAYS + math.log10(4) * bool(m.group(1) or m.group(2)), "date"
        if low[i:i + 2] in NEAR:
            first, end, turns = self._walk(i)
            # all short walks, and the whole of a long one
            for j in [*range(i + 2, min(end, i + SHORT_WALK - 1) + 1), *([end] if end > i + SHORT_WALK - 1 else [])]:
                yield j + 1, math.log10(47) + (turns[j - first] - turns[i + 1 - first]) * math.log10(4) + math.log10(j - i + 1), "walk"
        periods = [p for p in range(1, PERIODS + 1) if value[i:i + p] == value[i + p:i + 2 * p]]
        far = value.find(value[i:i + PERIODS], i + PERIODS + 1) - i if i + 2 * PERIODS < n else 0
        if far > PERIODS:
            periods.append(far)
        for period in periods:
            length = _common(value, i, i + period) + period
            times = length // period
            begins = not i or value[i - 1] != value[i + period - 1]
            if times > 1 and times * period >= 3 and (begins or length <= SHORT_RUN):
                # what is repeated: as cheap as its own segments where the stretch begins
                base = value[i:i + period]
                once = guess_cost(base, dictionary) if begins and period > 1 else sum(map(brute, base))
                yield i + times * period, once + math.log10(times), "repeat"


def spans(value: str, dictionary: dict[str, float]):
    """(start, end, log10 guesses, kind) of every segment that is not brute force."""
    segments = Segments(value, dictionary)
    for i in range(len(value)):
        yield from ((i, *x) for x in segments.at(i))


def guess_cost(value: str, dictionary: dict[str, float], enough: float = math.inf) -> float:
    """log10 of the least guesses over all segmentations of a value, or ``enough`` if they are as many: no way
    on from a place that costs so much can be less, so only the places that cost less are read."""
    n, segments = len(value), Segments(value, dictionary)
    best, heap = {0: 0.0}, [0]
    while heap:  # places in rising order, each reached from the left
        i = heappop(heap)
        cost = best[i]
        if i == n:
            return cost
        ways = [(i + 1, brute(value[i])), *((j, SEGMENT + c) for j, c, _ in segments.at(i))]
        for j, c in ways:
            if cost + c < enough:
                if j not in best:
                    heappush(heap, j)
                if cost + c < best.get(j, math.inf):
                    best[j] = cost + c
    return 0.0 if not n else enough


def _value_end(text: str, start: int, end: int, most: int) -> int:
    """End of the whole value whose part up to ``end`` the base pattern takes; a quoted one ends at its quote, and none
    reaches beyond ``most``, where the next credential word begins."""
    whole = VALUE.match(text, start, most).end()
    if start and text[start - 1] == '"' and (quote := text.find('"', start, whole)) >= 0:
        whole = quote
    while whole > end and text[whole - 1] in CLOSING:
        whole -= 1
    return whole


def scan(text: str | None, dictionary: dict[str, float], threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all findings in a whole text, in their order."""
    text = text or ""
    low = text.lower()
    out = set()
    values: list[tuple[int, int]] = []  # in order, apart from each other
    if any(h in low for h in ASSIGN_HINTS):
        found = [m for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
        out |= {(m.start(), 0, m.end()) for m in found}
        starts = [*(m.start() for m in found[1:]), len(text)]
        values = [(m.start(2), _value_end(text, *m.span(2), most)) for m, most in zip(found, starts)]
    if "AKIA" in text:
        out |= {(m.start(), 1, m.end()) for m in ACCESS.finditer(text)}
    out |= {(m.start(), 2, m.end()) for m in HEX.finditer(text)}
    if any(h in low for h in CONTEXT_HINTS):
        kept, i = [], 0
        for m in CONTEXT.finditer(text):
            s, e = m.span(1)
            while e > s and text[e - 1] in CLOSING:
                e -= 1
            if e - s < 6:
                continue
            while i < len(values) and values[i][1] <= s:
                kept.append(values[i])
                i += 1
            j = i
            while j < len(values) and values[j][0] < e:
                j += 1
            if all(s < a and b <= e for a, b in values[i:j]):  # the longest value is judged
                kept.append((s, e))
            else:
                kept += values[i:j]
            i = j
        values = kept + values[i:]
    judged: dict[str, bool] = {}  # values that recur are judged once
    for s, e in values:
        v = text[s:e]
        if v not in judged:
            judged[v] = guess_cost(v, dictionary, threshold) >= threshold
        if judged[v]:
            out.add((s, 3, e))
    return sorted(out)


def corpus_words(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The most frequent (``size`` at most) lower-case words of 3 to LONGEST_WORD letters of any script, counted
    over all texts, in falling order."""
    w = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w"))
    w = written(w.where(F.length("w").between(3, LONGEST_WORD)).groupBy("w").agg(F.count(F.lit(1)).alias("n")), "secrets-words")
    found = most_frequent(w, "n", size).collect()  # at most ``size`` words
    remove(docs.sparkSession, w)
    return [r["w"] for r in sorted(found, key=lambda r: (-r["n"], r["w"]))]


def find_secrets(docs: DataFrame, columns: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` as struct ``doc`` (``columns``, or all) with ``found``:
    array of struct<kind, start, end> (code points, end exclusive) by start and kind.

    Null and empty texts have no findings; every row is scanned on its own, in a time that grows with its length, so
    repeated rows repeat their findings. Columns of any name ride along in ``doc``. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    words = spark.sparkContext.broadcast(corpus_words(docs))  # at most DICTIONARY words

    @pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def f(t: pd.Series) -> pd.Series:
        dictionary = _dictionary(words)
        return pd.Series([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(x, dictionary, threshold)] for x in t])

    columns = columns or docs.columns
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("doc"), f(docs["text"]).alias("found"))


_DICTIONARIES: dict = {}


def _dictionary(words) -> dict[str, float]:
    """One dictionary per Python worker and broadcast."""
    key = getattr(words, "_jid", None) or id(words)
    if key not in _DICTIONARIES:
        _DICTIONARIES.clear()
        _DICTIONARIES[key] = ranks(words.value)
    return _DICTIONARIES[key]


def listed(found: Column) -> Column:
    """kind:start:end of findings, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
