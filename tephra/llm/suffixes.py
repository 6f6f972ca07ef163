"""Suffixes that may begin a repeat, gathered in partitions that can be worked alone.

A repeat is a run of WORDS words or more that occurs twice or more. Of each window
of WORDS words one anchor is chosen, the least of the hashes of its runs of GRAM
words: equal windows have the same anchor at the same place. So all occurrences of
a repeat share the anchor of its first window, and they meet where that anchor's
occurrences are gathered, whatever the number of documents. Anchors that occur once
begin no repeat, and neither do those before which all occurrences agree for a whole
window: a repeat found there could be prolonged to the left. What is left, each with
the text up to where repeated windows end, is sent to the anchor's partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tephra.llm import words as W
from tephra.llm.frames import mapped, parts, unused

WORDS = 50
ROWS = "key long, rid long, doc_id long, at int, times int, left int, size int, body binary"
_packer = pa.Codec("zstd", compression_level=1)
_LOW = np.uint64((1 << 24) - 1)


def packed(text: bytes) -> bytes:
    return _packer.compress(text, asbytes=True)


def unpacked(body: bytes, size: int) -> bytes:
    return _packer.decompress(body, size, asbytes=True)


def gram_of(words: int) -> int:
    return max(1, words // 2)


def _leftmost_least(g: np.ndarray, w: int) -> np.ndarray:
    """The place of the least of each w hashes in a row, of fewer than 2 ** 24 + 1."""
    # the lower bits hold the place, so that the leftmost of equal hashes is the least
    least = (g & ~_LOW) | np.arange(len(g), dtype=np.uint64)
    span = 1
    while 2 * span <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    return (least & _LOW).astype(np.int64)


def anchors(h: np.ndarray, first: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the gram at each word, starts of full windows, each window's anchor)."""
    k = gram_of(words)
    g = W.grams(h, k)
    w = words - k + 1
    m = len(g) - w + 1
    if m <= 0:
        return g, np.zeros(0, np.int64), np.zeros(0, np.int64)
    chosen = np.empty(m, np.int64)
    step = int(_LOW) + 2 - w  # windows whose grams' places fit in the lower bits
    for a in range(0, m, step):
        b = min(a + step, m)
        chosen[a:b] = a + _leftmost_least(g[a : b + w - 1], w)
    ok = np.zeros(m, bool)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= words:
            ok[a : b - words + 1] = True
    start = np.flatnonzero(ok)
    return g, start, chosen[start]


def _before(h: np.ndarray, at: np.ndarray, row: np.ndarray, first: np.ndarray, w: int, tag: np.ndarray) -> np.ndarray:
    """Hash of the w words before each place; where a text begins, of fewer words and the text itself."""
    total = np.zeros(len(at), np.uint64)
    begin = first[row]
    for t in range(1, w + 1):
        there = at - t >= begin
        total = total * W._R + np.where(there, h[np.maximum(at - t, 0)], np.uint64(7))
    return np.where(at - w < begin, W.mix(total + tag[row]), W.mix(total)).view(np.int64)


def row_id():
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), "text")


def gathered(docs: DataFrame, words: int) -> DataFrame:
    """(key, rid, doc_id, at, times, left, size, body): one row for each suffix, or run of them.

    rid: hash of doc_id and text; key: the anchor; at: its word number in the document; body: the text from
    `left` words before it (all that the text has, if fewer than a window) to where
    repeats that begin in its window must have ended. times: as many suffixes, each a
    word further on, have the same anchor (one word again and again). body is
    compressed from `size` bytes.
    """
    docs = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    w = words - gram_of(words) + 1
    rows = docs.withColumn("rid", row_id())

    def find(batches):
        for batch in batches:
            texts, ids = W.column(batch, "text"), W.column(batch, "rid").to_numpy()
            for a, b in W.chunks(texts):
                x = W.Words(texts, a, b)
                g, _, chosen = anchors(x.hash, x.first, words)
                at = np.unique(chosen)
                row = np.searchsorted(x.first, at, "right") - 1
                tag = ids[a:b].view(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[at].view(np.int64)), pa.array(ids[a:b][row]), pa.array((at - x.first[row]).astype(np.int32)), pa.array(_before(x.hash, at, row, x.first, w, tag))],
                    names=["key", "rid", "at", "before"],
                )

    def several(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        key, rid, at, before = (table.column(n).to_numpy() for n in ("key", "rid", "at", "before"))
        order = np.lexsort((at, rid, key))
        key, rid, at, before = key[order], rid[order], at[order], before[order]
        new = np.ones(len(key), bool)  # rows that repeat a document are one document
        new[1:] = (key[1:] != key[:-1]) | (rid[1:] != rid[:-1]) | (at[1:] != at[:-1])
        key, rid, at, before = key[new], rid[new], at[new], before[new]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(cut, len(key)))
        differs = np.maximum.reduceat(before, cut) != np.minimum.reduceat(before, cut)
        many = np.repeat(size > 1, size)
        yield pa.RecordBatch.from_arrays([pa.array(rid[many]), pa.array(at[many]), pa.array(np.repeat(differs, size)[many])], names=["rid", "at", "opens"])

    found = rows.transform(mapped, find, "key long, rid long, at int, before long")
    marks = found.repartition(parts(docs), "key").transform(mapped, several, "rid long, at int, opens boolean")
    marks = marks.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("at", "opens"))).alias("marks")).select("rid", F.col("marks.at").alias("at"), F.col("marks.opens").alias("opens"))

    def cut(batches):
        for batch in batches:
            texts, ids, rids = W.column(batch, "text"), W.column(batch, "doc_id"), W.column(batch, "rid")
            ats, opens = W.column(batch, "at"), W.column(batch, "opens")
            for a, b in W.chunks(texts):
                x = W.Words(texts, a, b)
                g, start, chosen = anchors(x.hash, x.first, words)
                out = [[], [], [], [], [], [], []]
                repeated = np.zeros(len(x.hash) + 1, bool)
                marks = []
                for i in range(a, b):
                    at = np.asarray(ats[i].values.to_numpy(zero_copy_only=False)) + x.first[i - a]
                    repeated[at] = True
                    marks.append(at[np.asarray(opens[i].values.to_numpy(zero_copy_only=False))])
                good = np.zeros(len(x.hash) + 1, bool)
                good[start] = repeated[chosen]
                stops = np.flatnonzero(~good)  # no repeat covers a window that begins here
                for i in range(a, b):
                    lo, hi = int(x.first[i - a]), int(x.first[i - a + 1])
                    at = marks[i - a]
                    if not len(at):
                        continue
                    end = np.minimum(stops[np.searchsorted(stops, at, "right")] + words - 1, hi)
                    new = np.ones(len(at), bool)
                    new[1:] = (at[1:] != at[:-1] + 1) | (g[at[1:]] != g[at[:-1]])
                    head = np.flatnonzero(new)
                    times = np.diff(np.append(head, len(at)))
                    for p, e, n in zip(at[head].tolist(), np.maximum.reduceat(end, head).tolist(), times.tolist()):
                        left = min(w, p - lo)
                        text = x.text(p - left, e)
                        for to, v in zip(out, (int(g[p].view(np.int64)), i, p - lo, n, left, len(text), packed(text))):
                            to.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), rids.take(pa.array(out[1], pa.int64())), ids.take(pa.array(out[1], pa.int64())), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.int32()), pa.array(out[6], pa.binary())],
                    names=["key", "rid", "doc_id", "at", "times", "left", "size", "body"],
                )

    kept = rows.join(marks, "rid").select("rid", "doc_id", "text", "at", "opens")
    return kept.transform(mapped, cut, ROWS)


class Suffix:
    """A suffix from an anchor on: word hashes to its right and, nearest first, to its left."""

    __slots__ = ("rid", "doc", "at", "left", "right")

    def __init__(self, rid: int, doc, at: int, left: np.ndarray, right: np.ndarray):
        self.rid, self.doc, self.at, self.left, self.right = rid, doc, at, left, right


def agree(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    d = np.flatnonzero(a[:n] != b[:n])
    return int(d[0]) if len(d) else n


class Family:
    """Suffixes that agree in the o words to their left, in the order of their right sides.

    lcp: lengths of neighbours' common prefixes; before: what stands further left,
    unlike anything else where the text begins; rank: order by document and place.
    """

    def __init__(self, o: int, members: list[Suffix]):
        self.o = o
        self.members = members = sorted(members, key=lambda s: s.right.astype(">u8").tobytes())
        self.lcp = [agree(a.right, b.right) for a, b in zip(members, members[1:])]
        self.before = np.array([int(s.left[o]) if o < len(s.left) else (s.rid * 0x9E3779B97F4A7C15 + s.at * 0xD6E8FEB86659FD93 + 1) % 2**64 for s in members], np.uint64)
        self.rid = np.array([s.rid for s in members], np.int64)
        self.start = np.array([s.at - o for s in members], np.int64)
        self.doc = np.array([s.doc or 0 for s in members], np.int64)
        self.known = np.array([s.doc is not None for s in members])
        self._changes = np.concatenate([[0], np.cumsum(self.before[1:] != self.before[:-1])]).tolist()
        self._begins: dict[bytes, bool] = {}
        self.rank = np.empty(len(members), np.int64)
        self.rank[np.lexsort((self.rid, self.start, self.doc, self.known))] = np.arange(len(members))

    def maximal(self, lo: int, hi: int, depth: int, words: int) -> bool:
        """Whether suffixes lo to hi, that share `depth` words, are a repeat that is to be reported here."""
        if self.o + depth < words:
            return False
        if self._changes[lo] == self._changes[hi]:
            return False
        window = self.members[lo].right[: words - self.o].tobytes()
        if window not in self._begins:
            self._begins[window] = begins(self.members[lo], self.o, words)
        return self._begins[window]


def openings(members: list[Suffix], words: int) -> Iterator[Family]:
    """The families at each o at which some members' left sides part, if repeats may begin there."""
    k = gram_of(words)
    w = words - k + 1
    order = sorted(members, key=lambda s: s.left.astype(">u8").tobytes())
    same = [agree(a.left, b.left) for a, b in zip(order, order[1:])]
    for o in sorted({x for x in same if x < w}):
        lo = 0
        for hi in range(1, len(order) + 1):
            if hi == len(order) or same[hi - 1] < o:
                if hi - lo > 1:
                    head = order[lo]
                    g = W.grams(np.concatenate([head.left[:o][::-1], head.right[:k]]), k) >> np.uint64(24)
                    if (g[:-1] > g[-1]).all():  # else another anchor comes first
                        yield Family(o, order[lo:hi])
                lo = hi


def begins(s: Suffix, o: int, words: int) -> bool:
    """Whether the window from o words before the anchor has it as its anchor, so that its repeats are found here alone."""
    first = np.concatenate([s.left[:o][::-1], s.right[: words - o]])
    return len(first) == words and int(anchors(first, np.array([0, words]), words)[2][0]) == o


class Partition:
    """A task's suffixes, packed; `memory` limits the bytes that are unpacked at once (0: no limit)."""

    def __init__(self, batches, words: int, memory: int = 0):
        batches = [b for b in batches if b.num_rows]
        self.words, self.memory = words, memory
        self.w = words - gram_of(words) + 1
        self.table = pa.Table.from_batches(batches).combine_chunks() if batches else None

    def groups(self) -> Iterator[tuple[list[Suffix], int, int]]:
        """(suffixes, low, high) of each key: repeats are to be looked for whose right sides have low to high - 1 words."""
        if self.table is None:
            return
        key, rid, at = (self.table.column(n).to_numpy() for n in ("key", "rid", "at"))
        order = np.lexsort((at, rid, key))
        same = (key[order][1:] == key[order][:-1]) & (rid[order][1:] == rid[order][:-1]) & (at[order][1:] == at[order][:-1])
        order = order[np.concatenate([[True], ~same])]  # repeated rows count once
        key, size = key[order], self.table.column("size").to_numpy()[order].astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends, total = np.append(cut[1:], len(order)), np.add.reduceat(size, cut)
        upto = np.cumsum(total)
        i = 0
        while i < len(cut):
            if self.memory and total[i] > self.memory:
                yield from self._split([(r, None) for r in order[cut[i] : ends[i]]], 2 * self.words, 0)
                i += 1
                continue
            j = i + 1  # some keys at a time, of about a megabyte
            while j < len(cut) and upto[j] - upto[i] + total[i] < W.CHUNK_BYTES and not (self.memory and total[j] > self.memory):
                j += 1
            made = self._unpacked(order[cut[i] : ends[j - 1]])
            for c in range(i, j):
                members = [s for some in made[cut[c] - cut[i] : ends[c] - cut[i]] for s in some]
                if len(members) > 1:
                    yield members, 0, 1 << 31
            i = j

    def _unpacked(self, rows: np.ndarray) -> list[list[Suffix]]:
        some = self.table.take(pa.array(rows))
        rid, doc, at, times, left, size, body = (some.column(n).to_pylist() for n in ("rid", "doc_id", "at", "times", "left", "size", "body"))
        texts = pa.array([unpacked(b, n) for b, n in zip(body, size)], pa.large_binary()).view(pa.large_string())
        made = []
        for a, b in W.chunks(texts):
            x = W.Words(texts, a, b)
            for r in range(a, b):
                lo, hi = int(x.first[r - a]), int(x.first[r - a + 1])
                mid = lo + left[r]
                made.append([Suffix(rid[r], doc[r], at[r] + t, x.hash[max(lo, mid + t - self.w) : mid + t][::-1], x.hash[mid + t : hi]) for t in range(times[r])])
        return made

    def _split(self, wanted: list[tuple[int, int | None]], length: int, low: int) -> Iterator[tuple[list[Suffix], int, int]]:
        """The top of the suffixes' tree, cut to `length` words, and then the subtrees below, one prefix of that length after the other."""
        top, below = [], {}
        for row, t in wanted:
            some = self._unpacked(np.array([row]))[0]
            for k, s in enumerate(some) if t is None else [(t, some[t])]:
                top.append(Suffix(s.rid, s.doc, s.at, s.left.copy(), s.right[:length].copy()))
                if len(s.right) >= length:
                    below.setdefault(s.right[:length].tobytes(), []).append((row, k, 8 * len(s.right)))
        yield top, low, length
        del top
        for some in below.values():
            if len(some) < 2:
                continue
            if sum(n for _, _, n in some) > self.memory:
                yield from self._split([(row, k) for row, k, _ in some], 2 * length, length)
            else:
                yield [self._unpacked(np.array([row]))[0][k] for row, k, _ in some], length, 1 << 31


def found(docs: DataFrame, words: int, work: Callable[[Iterator[tuple[list[Suffix], int, int]]], Iterator[pa.RecordBatch]], schema: str, memory: int = 0) -> DataFrame:
    def run(batches):
        yield from work(Partition(batches, words, memory).groups())

    return gathered(docs, words).repartition(parts(docs), "key").transform(mapped, run, schema)


def repeat_id(s: Suffix, o: int, length: int) -> int:
    """From the repeat's words alone."""
    h = np.concatenate([s.left[:o][::-1], s.right[: length - o]])
    total = (h * W.powers(length)).sum(dtype=np.uint64) + np.uint64(length)
    return int(W.mix(np.array([total]))[0].view(np.int64))


CUTS = "rid long, doc_id long, start int, n_words int, first_doc_id long, first_start int"


def cutter(words: int, inner: Callable[[Family], Iterator[tuple[int, int, int]]]):
    """Work that gives a row for each place to cut.

    inner: (depth, first, last) of the inner nodes of a family, the deeper first on
    each path. For each suffix the deepest repeat counts whose first occurrence is
    another one and isn't overlapped.
    """

    def work(keys):
        for members, low, high in keys:
            for f in openings(members, words):
                size, first = np.zeros(len(f.rank), np.int64), np.zeros(len(f.rank), np.int64)
                for depth, lo, hi in inner(f):
                    if low <= depth < high and f.maximal(lo, hi, depth, words):
                        n, head = f.o + depth, lo + int(f.rank[lo : hi + 1].argmin())
                        cut = (size[lo : hi + 1] == 0) & ((f.rid[lo : hi + 1] != f.rid[head]) | (f.start[lo : hi + 1] - f.start[head] >= n))
                        at = lo + np.flatnonzero(cut)
                        size[at], first[at] = n, head
                at = np.flatnonzero(size)
                if len(at):
                    head = first[at]
                    columns = [pa.array(f.rid[at]), pa.array(f.doc[at], mask=~f.known[at]), pa.array(f.start[at].astype(np.int32)), pa.array(size[at].astype(np.int32)), pa.array(f.doc[head], mask=~f.known[head]), pa.array(f.start[head].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["rid", "doc_id", "start", "n_words", "first_doc_id", "first_start"])

    return work


def removed(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """`docs` without the words that `cuts` (rid, start, n_words) covers, n_chars counted anew; a text left without words goes."""
    p, names = unused(docs), docs.columns
    spans = cuts.groupBy(F.col("rid").alias(p + "rid")).agg(F.collect_list(F.struct("start", "n_words")).alias(p + "cuts"))
    joined = docs.withColumn(p + "own", row_id()).join(spans, F.col(p + "own") == F.col(p + "rid"), "left").select(*names, F.col(p + "cuts.start").alias(p + "start"), F.col(p + "cuts.n_words").alias(p + "n"))

    def run(batches):
        for batch in batches:
            texts, starts, counts = W.column(batch, "text"), W.column(batch, p + "start"), W.column(batch, p + "n")
            new, stays = texts.to_pylist(), np.ones(len(texts), bool)
            for i in np.flatnonzero(starts.is_valid().to_numpy(zero_copy_only=False)):
                if new[i] is None:
                    continue
                x = W.of_bytes(new[i].encode("utf-8", "surrogatepass"))
                gone = np.zeros(len(x.hash) + 1, np.int64)
                s = starts[i].values.to_numpy()
                np.add.at(gone, s, 1)
                np.add.at(gone, s + counts[i].values.to_numpy(), -1)
                keep = np.cumsum(gone)[:-1] == 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
                ends = [len(x.data) if b == len(keep) else x.start[b] for b in edge[1::2]]
                new[i] = b"".join(x.data[(0 if a == 0 else x.start[a]) : b].tobytes() for a, b in zip(edge[::2], ends)).decode("utf-8", "surrogatepass")
                stays[i] = len(edge) > 0
            arrays = [pa.array(new, texts.type) if n == "text" else batch.column(k) for k, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array(stays))

    out = joined.transform(mapped, run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
