"""Removal of repeated passages by sorted suffixes.

A byte goes when a string of LENGTH bytes that covers it also starts anywhere
else. Sorting every suffix of the corpus would need many times its size, so
candidates are found first: of each such string, the least hashed GRAM-byte
substring is its anchor (the leftmost of equals). Equal strings have equal
anchors at equal distances, so only strings whose anchor's hash occurs more than
once can repeat. Successive starts with one anchor form a window; windows of
equal anchors meet in a bucket.

A bucket's suffixes are put in order by deep-shallow sorting: a multikey
quicksort, eight bytes a step, to SHALLOW bytes, and a blind trie for each group
that agrees so far. A neighbour in that order shares a suffix's longest match, and
the match of one start bounds those of the starts around it, so a bucket begins
with every 32nd start and halves the distance where the bounds leave it open.

Equal windows are one row before they are shuffled. A bucket over BUCKET bytes is
dealt out again: by narrower ranges of starts, and in each by the bytes that all
its strings share, down to single strings, whose buckets hold one distinct row.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lodestar.llm.common import chunk_rows, chunks, nullable, written

#: bytes of a repeated string, and of the substrings that may be its anchor
LENGTH, GRAM = 400, 64
#: bytes ordered by the quicksort; distance of the starts that are sorted first (at most LENGTH - SHALLOW)
SHALLOW, STEP = 64, 32
#: bytes of text in a chunk, starts hashed at once
CHUNK, SLICE = 1 << 22, 1 << 18
#: window bytes sorted together at most, and in a task, roughly
BUCKET, PART = 1 << 20, 1 << 21
#: ranges of starts into which a bucket too large is dealt, each time
RANGES = 8

_ODD = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    inverse = pow(_ODD, -1, 1 << 64)
    one = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate([one, np.full(n, x, np.uint64)])) for x in (_ODD, inverse))


def gram_hashes(b: np.ndarray, gram: int, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each substring of ``gram`` bytes."""
    n = len(b) - gram + 1
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(b * powers[0][:len(b)], out=total[1:])
    h = (total[gram:] - total[:n]) * powers[1][:n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each run of ``w``."""
    n = len(x) - w + 1
    rows = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    rows[:len(x)] = x
    rows = rows.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1:w - 1 + n])


class Finder:
    """Windows of a chunk's texts, laid end to end."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM, slice_: int = SLICE):
        self.length, self.gram, self.slice = length, min(gram, length), slice_
        self.powers = _powers(0)

    def windows(self, b: np.ndarray, ends: np.ndarray):
        """(anchor, first start, last start, hash of the anchor) of each window."""
        out, n = [], len(b) - self.length + 1
        size = min(self.slice, max(n, 0)) + self.length
        if len(self.powers[0]) < size:
            self.powers = _powers(size)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        low = np.maximum(begins, ends - self.length + 1)  # starts whose string would leave the text
        low, ends = low[ends > begins], ends[ends > begins].astype(np.int64)
        for s in range(0, max(n, 0), self.slice):
            m = min(self.slice, n - s)
            h = gram_hashes(b[s:s + m + self.length - 1], self.gram, self.powers)
            room = np.uint64((self.slice + self.length).bit_length())
            first = _sliding_min(h >> room << room | np.arange(len(h), dtype=np.uint64), self.length - self.gram + 1)
            at = (first & np.uint64((1 << int(room)) - 1)).astype(np.int64)
            cut = np.zeros(m + 1, np.int32)
            i, j = np.searchsorted(ends, s, "right"), np.searchsorted(low, s + m)
            np.add.at(cut, np.clip(low[i:j] - s, 0, m), 1)
            np.add.at(cut, np.clip(ends[i:j] - s, 0, m), -1)
            at[np.cumsum(cut[:m]) > 0] = -1
            lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            hi = np.concatenate([lo[1:], [m]]) - 1
            ok = at[lo] >= 0
            lo, hi = lo[ok], hi[ok]
            out.append((at[lo] + s, lo + s, hi + s, h[at[lo]].view(np.int64)))
        return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4


def _texts(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, laid end to end, and where each ends."""
    text = pc.fill_null(pa.concat_arrays([b.column("text") for b in rows]).cast(pa.large_binary()), b"")
    end = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = text.buffers()[2]
    b = np.frombuffer(data, np.uint8)[end[0]:end[-1]] if data and end[-1] > end[0] else np.zeros(0, np.uint8)
    return b, end[1:] - end[0]


def _digest(left: int, content) -> bytes:
    return blake2b(content, digest_size=16, salt=left.to_bytes(4, "little")).digest()


# ---- deep-shallow sorting

def _words(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as one number that orders like them."""
    return b[at[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64)


def multikey(b: np.ndarray, pos: np.ndarray, bucket: np.ndarray, shallow: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Suffixes ordered by bucket and their first ``shallow`` bytes, and the ranges of that
    order that agree in these. Three-way partition about a pivot, eight bytes at a time, of all open ranges at once."""
    order = np.argsort(bucket, kind="stable")
    deep: list[tuple[int, int]] = []
    at = np.arange(len(order))
    group = np.unique(bucket[order], return_inverse=True)[1] if len(order) else at
    depth = np.zeros(len(order), np.int64)
    while len(at):
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.concatenate([first, [len(at)]]))
        which = np.repeat(np.arange(len(first)), size)
        # ranges of one need no more, nor do those at the depth
        over = (size == 1) | (depth[first] >= shallow)
        deep += [(int(a), int(a + n)) for a, n in zip(at[first[over]], size[over]) if n > 1]
        live = ~over[which]
        at, which, depth = at[live], which[live], depth[live]
        if not len(at):
            break
        w = _words(b, pos[order[at]] + depth)
        first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        size = np.diff(np.concatenate([first, [len(at)]]))
        pivot = np.repeat(w[first + size // 2], size)
        side = np.repeat(np.arange(len(first)), size) * 3 + 1 + (w > pivot) - (w < pivot)
        by = np.argsort(side, kind="stable")
        order[at] = order[at][by]
        group = side[by]
        depth = depth[by] + 8 * (group % 3 == 1)
    return order, deep


def _common(x: bytes, y: bytes, skip: int) -> int:
    """Bytes that both begin with; the first ``skip`` are known to agree."""
    n = min(len(x), len(y))
    if x[skip:n] == y[skip:n]:
        return n
    step = 64
    while x[skip:skip + step] == y[skip:skip + step]:
        skip += step
        step *= 2
    n = min(n, skip + step)
    d = int.from_bytes(x[skip:n]) ^ int.from_bytes(y[skip:n])
    return n - (d.bit_length() + 7) // 8


def blind_trie(strings: list[bytes], known: int) -> tuple[list[int], list[int]]:
    """The order of strings whose first ``known`` bytes agree, and the length each shares with the one before.

    A node is a depth and its children by the byte there (-1: the string's end); what lies between is not
    kept, so a search goes down blindly, compares with one leaf, and inserts at the depth of the difference."""
    if len(strings) == 2:
        n = _common(strings[0], strings[1], known)
        return ([0, 1] if strings[0] <= strings[1] else [1, 0]), [0, n]
    root = None  # a leaf is a list of equal strings, a node a tuple (depth, children)
    for i, s in enumerate(strings):
        if root is None:
            root = [i]
            continue
        node = root
        while type(node) is tuple:
            d, children = node
            node = children.get(s[d] if d < len(s) else -1) or next(iter(children.values()))
        other = strings[node[0]]
        n = _common(s, other, known)
        if n == len(s) == len(other):
            node.append(i)
            continue
        above, way, node = None, None, root
        while type(node) is tuple and node[0] < n:
            above, way = node, s[node[0]]
            node = node[1][way]
        mine = s[n] if n < len(s) else -1
        if type(node) is tuple and node[0] == n:
            node[1][mine] = [i]
            continue
        new = (n, {mine: [i], other[n] if n < len(other) else -1: node})
        if above is None:
            root = new
        else:
            above[1][way] = new
    order, shared, todo, split = [], [], [(root, 0)], 0
    while todo:
        node, split = todo.pop()
        if type(node) is list:
            order += node
            shared += [split] + [len(strings[node[0]])] * (len(node) - 1)
        else:
            keys = sorted(node[1], reverse=True)
            todo += [(node[1][k], node[0]) for k in keys[:-1]] + [(node[1][keys[-1]], split)]
    return order, shared


def longest_matches(b: np.ndarray, pos: np.ndarray, end: np.ndarray, bucket: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """For each suffix (bytes ``pos`` to ``end``) the length it shares with another of its bucket;
    below ``shallow``: shallow - 1 (or 0), whatever it is."""
    order, deep = multikey(b, pos, bucket, shallow)
    shared = np.full(len(order) + 1, max(shallow - 1, 0), np.int64)  # with the one before in the order
    raw = b.tobytes()
    for lo, hi in deep:
        i = order[lo:hi]
        by, n = blind_trie([raw[p:e] for p, e in zip(pos[i].tolist(), end[i].tolist())], shallow)
        order[lo:hi] = i[by]
        shared[lo + 1:hi] = n[1:]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(shared[:-1], shared[1:])
    return out


def repeated(b: np.ndarray, end: np.ndarray, left: np.ndarray, starts: np.ndarray, bucket: np.ndarray, many: np.ndarray,
             length: int = LENGTH, step: int = STEP, shallow: int = SHALLOW) -> np.ndarray:
    """Which starts of the windows laid end to end in ``b`` (up to ``end``, the first start ``left`` bytes before
    the anchor) begin a string of ``length`` bytes that another window of the bucket has too; ``many``: windows known to be repeated."""
    begin = end - starts - length + 1
    base = np.concatenate([[0], np.cumsum(starts)])
    window = np.repeat(np.arange(len(starts)), starts)
    offset = left[window] - (np.arange(base[-1]) - base[:-1][window])
    yes, no = many[window].copy(), np.zeros(base[-1], bool)
    last = left - starts + 1
    top = int(left.max()) + step + 1
    tried = np.zeros((int(bucket.max()) + 1, top), bool)
    want = np.zeros_like(tried)
    want[:, ::step] = True
    while True:
        want &= ~tried
        tried |= want
        # every window of a bucket brings the starts wanted there, and one beyond its last
        live = np.flatnonzero(want.any(axis=1)[bucket])
        w, o = [], []
        for lo in range(0, len(live), 4096):
            i = live[lo:lo + 4096]
            col = np.arange(top)
            ok = want[bucket[i]] & (col <= left[i, None]) & (col >= (last[i] // step * step)[:, None])
            x, y = np.nonzero(ok)
            w.append(i[x])
            o.append(y)
        if w:
            w, o = np.concatenate(w), np.concatenate(o)
            at = left[w] - o
            match = longest_matches(b, begin[w] + at, end[w], bucket[w], shallow)
            up, down = np.zeros(base[-1] + 1, np.int32), np.zeros(base[-1] + 1, np.int32)
            hit = match >= length
            i = w[hit]
            np.add.at(up, base[i] + at[hit], 1)
            np.add.at(up, base[i] + np.minimum(at[hit] + match[hit] - length + 1, starts[i]), -1)
            i, a, m = w[~hit], at[~hit], match[~hit]
            # a start further back has its partner's suffix here only if that window reaches here
            lo = np.maximum(0, a - np.minimum(length - m, step) + 1)
            hi = np.minimum(a + 1, starts[i])
            ok = lo < hi
            np.add.at(down, base[i[ok]] + lo[ok], 1)
            np.add.at(down, base[i[ok]] + hi[ok], -1)
            yes |= np.cumsum(up[:-1]) > 0
            no |= np.cumsum(down[:-1]) > 0
        open_ = np.flatnonzero(~(yes | no))
        if step == 1 or not len(open_):
            return yes
        step //= 2
        o, k = offset[open_] // step * step, bucket[window[open_]]
        want[:] = False
        want[k, o] = True
        want[k, np.where(o < offset[open_], o + step, o)] = True


def _runs(flags: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of set flags within a window."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    gap = (np.diff(at) > 1) | (np.diff(window[at]) != 0)
    return at[np.concatenate([[True], gap])], at[np.concatenate([gap, [True]])]


FOUND = "key long, digest binary, a int, b int"


def _sort_part(length: int):
    def sort(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        left, starts, key = (rows[c].to_numpy().astype(np.int64) for c in ("left", "starts", "key"))
        content = rows["content"].to_pylist()
        end = np.cumsum([len(x) for x in content])
        bucket = np.unique(key, return_inverse=True)[1]
        yes = repeated(np.frombuffer(b"".join(content), np.uint8), end, left, starts, bucket,
                       rows["many"].to_numpy(zero_copy_only=False).astype(bool), length, min(STEP, max(1, length // 2)), min(SHALLOW, length // 2 // 8 * 8))
        window = np.repeat(np.arange(len(left)), starts)
        base = np.cumsum(starts) - starts
        lo, hi = _runs(yes, window)
        w = window[lo]
        return pa.table({"key": rows["key"].take(pa.array(w)), "digest": rows["digest"].take(pa.array(w)),
                         "a": (left[w] - (lo - base[w])).astype(np.int32), "b": (left[w] - (hi - base[w])).astype(np.int32)})
    return sort


def _narrower(width: int, length: int):
    """Windows cut at multiples of ``width`` of the distance to the anchor, keyed by what all strings of such a range share."""
    def cut(batches):
        for rows in batches:
            out = {c: [] for c in ("key", "digest", "key2", "digest2", "left", "starts", "content", "many")}
            for key, digest, left, starts, content, many in zip(*(rows.column(c).to_pylist() for c in (
                    "key", "digest", "left", "starts", "content", "many"))):
                last = left - starts + 1
                for block in range(last // width, left // width + 1):
                    a, z = min(left, block * width + width - 1), max(last, block * width)
                    piece = content[left - a:left - z + length]
                    # of the whole range: from its latest start to the end of its earliest string
                    core = content[left - block * width:left - (block * width + width - 1) + length]
                    mark = blake2b(core, digest_size=8, salt=block.to_bytes(4, "little") + width.to_bytes(4, "little"),
                                   key=(key & (1 << 64) - 1).to_bytes(8, "little"))
                    for c, x in zip(out, (key, digest, int.from_bytes(mark.digest(), signed=True), _digest(a, piece), a, a - z + 1, piece, many)):
                        out[c].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in zip(out, (
                pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()))], list(out))
    return cut


def settle(windows: DataFrame, length: int = LENGTH, width: int = 512, bucket: int = BUCKET) -> DataFrame:
    """(key, digest, a, b): of each window (key, digest, left, starts, content, many) that has any, the runs of starts
    (by distance to the anchor, ``a`` down to ``b``) whose string another window of the key has too."""
    hull = ["key", "digest", "left", "starts", "content"]
    hulls = written(windows.groupBy(*hull).agg((F.max("many") | (F.count(F.lit(1)) > 1)).alias("many")), "suffix-hulls")
    sizes = written(hulls.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content").cast("long")).alias("size")), "suffix-sizes")
    small = (F.col("n") > 1) & (F.col("size") <= bucket)
    work = sizes.agg(F.sum(F.when(small, F.col("size"))).alias("s"), F.max(F.when(F.col("n") > 1, F.col("size"))).alias("m")).first()
    deeper = (work["m"] or 0) > bucket
    # the rows of a key whose bucket is too large (at most one key per ``bucket`` bytes) are never brought together
    large = F.broadcast(sizes.where((F.col("n") > 1) & (F.col("size") > bucket)).select("key"))
    judged = (hulls.join(large, "key", "left_anti") if deeper else hulls).join(sizes, "key")
    # a window alone in its bucket repeats if it was met more than once, or not at all
    whole = judged.where("n = 1 AND many").select("key", "digest", F.col("left").alias("a"), (F.col("left") - F.col("starts") + 1).alias("b"))
    parts = (work["s"] or 0) // PART + 1
    sorted_ = judged.where(small).select(*hull, "many", F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"))
    out = whole.unionByName(sorted_.groupBy("part").applyInArrow(_sort_part(length), FOUND))
    if deeper:
        width = max(1, width // RANGES)
        kinds = "key long, digest binary, key2 long, digest2 binary, left int, starts int, content binary, many boolean"
        pieces = written(hulls.join(large, "key", "left_semi").select(*hull, "many").mapInArrow(_narrower(width, length), kinds), "suffix-pieces")
        inner = settle(pieces.select(F.col("key2").alias("key"), F.col("digest2").alias("digest"), "left", "starts", "content", "many"),
                       length, width, bucket)
        # stored: a piece that many windows share makes a skewed join, and Spark splits those between plain exchanges only
        inner = written(inner.select(F.col("key").alias("key2"), F.col("digest").alias("digest2"), "a", "b"), "suffix-inner")
        out = out.unionByName(pieces.select("key", "digest", "key2", "digest2").join(inner, ["key2", "digest2"]).select("key", "digest", "a", "b"))
    return out


# ---- texts

def deduplicate(docs: DataFrame, columns: list[str] | None = None, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET,
                chunk: int = CHUNK) -> DataFrame:
    """Rows of ``docs`` as struct ``doc`` (``columns``, or all) with n_bytes, n_removed,
    spans (array of start and end of each maximal removed run, in UTF-8 bytes) and kept (binary, what remains).

    Strings are judged on the input, in the same text or another one, overlaps
    included. A null text is empty; texts shorter than ``length`` keep all. Rows that
    repeat remove each other's bytes; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    columns = columns or docs.columns
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("doc"), docs["text"].alias("text"))
    packed = written(rows.mapInArrow(chunks(chunk), "chunk long, rows binary"), "suffix-chunks")

    def anchors(batches):
        find = Finder(length, gram)
        for batch in batches:
            for at, blob in zip(batch.column("chunk").to_pylist(), batch.column("rows")):
                h, n = np.unique(find.windows(*_texts(list(chunk_rows(blob))))[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), at)), pa.array(h), pa.array(np.minimum(n, 2))], ["chunk", "key", "n"])

    seen = written(packed.mapInArrow(anchors, "chunk long, key long, n long"), "suffix-anchors")
    twice = seen.groupBy("key").agg(F.sum("n").alias("times")).where("times > 1").select("key")
    wanted = seen.select("chunk", "key").join(twice, "key", "left_semi")

    def cut(part: pa.Table, wanted: pa.Table) -> pa.Table:
        out: dict = {}
        for at, blob in zip(part["chunk"].to_pylist(), part["rows"].combine_chunks() if part.num_rows else []):
            b, ends = _texts(list(chunk_rows(blob)))
            a, lo, hi, h = Finder(length, gram).windows(b, ends)
            ok, raw = np.isin(h, wanted["key"].to_numpy()), b.data
            for a, lo, hi, key in zip(*(x[ok].tolist() for x in (a, lo, hi, h))):
                content = raw[lo:hi + length]
                k = (key, _digest(a - lo, content))
                out[k] = (at, a - lo, hi - lo + 1, out[k][3] if k in out else bytes(content), k in out)
        cols = list(zip(*((*v[:1], *k, *v[1:]) for k, v in out.items()))) or [()] * 7
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()))],
                        ["chunk", "key", "digest", "left", "starts", "content", "many"])

    windows = written(packed.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(
        cut, "chunk long, key long, digest binary, left int, starts int, content binary, many boolean"), "suffix-windows")
    found = written(settle(windows.drop("chunk"), length, 1 << (length - 1).bit_length(), bucket), "suffix-found")
    told = windows.select("chunk", "key", "digest").join(found, ["key", "digest"])
    kind = f"doc {rows.schema['doc'].dataType.simpleString()}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"

    def strip(part: pa.Table, told: pa.Table) -> pa.Table:
        verdict: dict = {}
        for key, digest, a, z in zip(*(told[c].to_pylist() for c in ("key", "digest", "a", "b"))):
            verdict.setdefault((key, digest), []).append((a, z))
        out = []
        for blob in part["rows"].combine_chunks() if part.num_rows else []:
            batches = list(chunk_rows(blob))
            b, ends = _texts(batches)
            raw, spans = b.data, []
            if verdict:
                a, lo, hi, h = Finder(length, gram).windows(b, ends)
                ok = np.isin(h, np.array([k for k, _ in verdict], np.int64))
                for at, lo, hi, key in zip(*(x[ok].tolist() for x in (a, lo, hi, h))):
                    spans += [(at - x, at - z + length) for x, z in verdict.get((key, _digest(at - lo, raw[lo:hi + length])), ())]
            out += _stripped(batches, raw, ends.tolist(), *_merged(spans, ends))
        return pa.Table.from_batches(out)

    return packed.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(strip, kind)


def _merged(spans: list[tuple[int, int]], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that ``spans`` cover, none beyond a text."""
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = np.array(sorted(spans), np.int64).T
    last = np.maximum.accumulate(last)
    text = np.searchsorted(ends, first, "right")
    new = np.concatenate([[True], (first[1:] > last[:-1]) | (text[1:] != text[:-1])])
    at = np.flatnonzero(new)
    return first[at], last[np.concatenate([at[1:], [len(first)]]) - 1]


def _stripped(batches: list[pa.RecordBatch], raw, ends: list[int], first: np.ndarray, last: np.ndarray):
    """Result rows of a chunk's batches."""
    cut, row, begin = np.searchsorted(first, ends).tolist(), 0, 0
    for batch in batches:
        rows = []
        for _ in range(batch.num_rows):
            i, j, end = cut[row - 1] if row else 0, cut[row], ends[row]
            here = [(int(x), int(y)) for x, y in zip(first[i:j], last[i:j])]
            edges = [begin, *(p for run in here for p in run), end]
            kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
            rows.append((end - begin, sum(y - x for x, y in here), [{"start": x - begin, "end": y - begin} for x, y in here], kept))
            begin, row = end, row + 1
        doc = batch.column("doc")
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        yield pa.RecordBatch.from_arrays([doc.cast(nullable(doc.type)), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))],
                                         ["doc", "n_bytes", "n_removed", "spans", "kept"])
