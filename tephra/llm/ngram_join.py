"""Self-join of documents on the Jaccard similarity of their word n-gram sets.

Each n-gram set is a count vector: its hashes fall into GROUPS groups, and the
groups' counts are a point. For two sets the overlap is at most the sum over
groups of the smaller count, and for a box of points at most the sum of minima
with the box's upper corner; an R-tree of boxes over each candidate partition is
searched with that bound, and what survives is verified on the sets themselves.

Candidates are partitioned by signature n-grams: the SIGNATURE n-grams of a set
whose hashes are least. Of those of the union, which are in both signatures where
both sets have them, two sets of similarity J share a binomial number at least, so
fewer than `shared_at_least` with a chance of MISS at most, whatever else the corpus
holds; sets whose unions have up to (SIGNATURE - shared) / (1 - threshold) n-grams
are always found. As so many are shared, one of them is left where each signature
drops one fewer of its most frequent n-grams: what is left is its prefix, and n-grams
that very many texts have are in few prefixes. A pair is looked at only in the
partition of the least n-gram that its prefixes share. An n-gram that more than HEAVY
prefixes hold is split: its sets fall into pieces by a hash, and each two pieces are a
partition of their own, so no task grows with the n-gram's frequency.
"""

from __future__ import annotations

from collections.abc import Callable
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tephra.llm import words as W
from tephra.llm.frames import broadcast_if_small, documents, mapped, parts, unused, written

N = 3
THRESHOLD = 0.6
#: Groups of a small set; larger ones have so many more that a group holds GROUPED n-grams at most on average.
GROUPS = 256
GROUPED = 3
SIGNATURE = 48
#: The chance that a pair at the threshold may share fewer signature n-grams than its prefixes rely on.
MISS = 4e-7
#: A count of this size stands for any greater one too; it bounds nothing.
FULL = 15
LEAF = 32
#: Documents of one signature n-gram that are searched together; with more, pieces of as many are searched two by two.
HEAVY = 8192
#: Groups of so many rows at most are searched together, so many rows at a time: a group by itself costs a millisecond.
SMALL, POOL = 64, 8192
#: Members of a class that are paired at once with as many of another.
PIECE = 512


def sets(texts: pa.Array, n: int = N):
    """The sorted n-gram hashes of each text; a shorter text's only n-gram is all its words."""
    for a, b in W.chunks(texts):
        w = W.Words(texts, a, b)
        g = W.grams(w.hash, n)
        for i in range(b - a):
            lo, hi = int(w.first[i]), int(w.first[i + 1])
            if hi - lo >= n:
                yield np.unique(g[lo : hi - n + 1])
            elif hi > lo:
                yield W.grams(w.hash[lo:hi], hi - lo)
            else:
                yield w.hash[:0]


def _vector(s: np.ndarray) -> bytes:
    """Counts of the groups, two in a byte."""
    groups = GROUPS
    while len(s) > GROUPED * groups:
        groups *= 2
    v = np.minimum(np.bincount((s >> np.uint64(20) & np.uint64(groups - 1)).astype(np.int64), minlength=groups), FULL)
    return (v[: groups // 2] | v[groups // 2 :] << 4).astype(np.uint8).tobytes()


class Vectors:
    """Count vectors of a partition; those of more groups fold into fewer ones."""

    def __init__(self, packed: list[bytes]):
        self.own = [np.frombuffer(p, np.uint8) for p in packed]
        self.groups = np.array([2 * len(p) for p in packed])
        self._at: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(self, groups: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows that have at least so many groups, their vectors of exactly so many)."""
        if groups not in self._at:
            rows = np.flatnonzero(self.groups >= groups)
            out = np.empty((len(rows), groups), np.uint16)
            alike = self.groups[rows] == groups
            if alike.any():
                v = np.stack([self.own[r] for r in rows[alike]])
                v = np.concatenate([v & 15, v >> 4], 1).astype(np.uint16)
                v[v == FULL] = 30000
                out[alike] = v
            for i, r in zip(np.flatnonzero(~alike), rows[~alike]):
                v = np.concatenate([self.own[r] & 15, self.own[r] >> 4]).astype(np.uint32)
                v[v == FULL] = 30000
                out[i] = np.minimum(v.reshape(-1, groups).sum(0), 60000)
            self._at[groups] = rows, out
        return self._at[groups]

    def near(self, i: np.ndarray, j: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
        """Whether the pairs' bound by all the groups that both have reaches what they need."""
        ok, both = np.ones(len(i), bool), np.minimum(self.groups[i], self.groups[j])
        for groups in np.unique(both[both > GROUPS]):
            rows, v = self.at(int(groups))
            at = np.flatnonzero(both == groups)
            for lo in range(0, len(at), step := max(1, (1 << 20) // int(groups))):
                p = at[lo : lo + step]
                bound = np.minimum(v[np.searchsorted(rows, i[p])], v[np.searchsorted(rows, j[p])]).sum(1, dtype=np.uint32)
                ok[p] = bound >= _needed(sizes[i[p]], sizes[j[p]], threshold)
        return ok


def shared_at_least(threshold: float) -> int:
    """Signature n-grams that a pair shares but for a chance of MISS (one at least is relied on)."""
    chance, m = 0.0, 0
    while m < SIGNATURE and (chance := chance + comb(SIGNATURE, m) * threshold**m * (1 - threshold) ** (SIGNATURE - m)) <= MISS:
        m += 1
    return max(m, 1)


def _signature(s: np.ndarray) -> np.ndarray:
    """The least hashes of a sorted set; zeros fill a small one up."""
    out = np.zeros(SIGNATURE, np.uint64)
    out[: len(s)] = s[:SIGNATURE]
    return out


def _needed(a, b, threshold: float):
    """The least overlap that two sets of these sizes must have; a little less for rounding."""
    return threshold / (1 + threshold) * (np.asarray(a, np.float64) + b) - 1e-6


class CountTree:
    """R-tree, bulk-loaded by size and then by the fullest groups, over count vectors."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((vectors.argmax(1), sizes))
        self.vectors, self.sizes = vectors[self.order], sizes[self.order]
        self.levels = []  # upper corners, least and greatest sizes; leaves first
        high, low, top = self.vectors, self.sizes, self.sizes
        while len(high) > 1:
            cut = np.arange(0, len(high), LEAF)
            high, low, top = np.maximum.reduceat(high, cut, 0), np.minimum.reduceat(low, cut), np.maximum.reduceat(top, cut)
            self.levels.append((high, low, top))

    def pairs(self, threshold: float, block: int = 512):
        """Pairs of rows whose bound reaches what the threshold needs, a block of queries at a time."""
        for begin in range(0, len(self.sizes), block):
            yield self._search(np.arange(begin, min(begin + block, len(self.sizes))), threshold)

    def _search(self, query: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        node = np.zeros(len(query), np.int64)
        for d in range(len(self.levels) - 1, -2, -1):
            if d < len(self.levels) - 1:  # children of the nodes that were reached
                count = len(self.sizes) if d < 0 else len(self.levels[d][0])
                child = node[:, None] * LEAF + np.arange(LEAF)
                ok = child < count
                query, node = np.repeat(query, LEAF)[ok.ravel()], child[ok]
            if d < 0:
                high, low, top = self.vectors, self.sizes, self.sizes
                near = query < node
            else:
                high, low, top = self.levels[d]
                near = node >= query // LEAF ** (d + 1)  # each pair once
            mine = self.sizes[query]
            near &= (low[node] * threshold <= mine + 1e-6) & (top[node] >= mine * threshold - 1e-6)
            query, node = query[near], node[near]
            keep = np.zeros(len(query), bool)
            for lo in range(0, len(query), 1 << 12):
                q, m = query[lo : lo + (1 << 12)], node[lo : lo + (1 << 12)]
                bound = np.minimum(self.vectors[q], high[m]).sum(1, dtype=np.uint32)
                keep[lo : lo + (1 << 12)] = bound >= _needed(self.sizes[q], low[m], threshold)
            query, node = query[keep], node[keep]
        return self.order[query], self.order[node]


def _candidates(key: int, signatures: np.ndarray, packed: list[bytes], sizes: np.ndarray, threshold: float, piece: np.ndarray | None = None):
    """Pairs that survive the bound and of whose shared n-grams in `signatures` (zeros fill short ones up) `key` is the least; of unlike pieces only, if given."""
    lower = _lower(signatures, np.uint64(key))
    vectors = Vectors(packed)
    for i, j in CountTree(vectors.at(GROUPS)[1], sizes).pairs(threshold):
        if piece is not None:
            apart = piece[i] != piece[j]
            i, j = i[apart], j[apart]
        near = vectors.near(i, j, sizes, threshold)
        i, j = i[near], j[near]
        ok = _apart(lower, i, j)
        yield i[ok], j[ok]


def _lower(signatures: np.ndarray, key) -> np.ndarray:
    """The n-grams of each row below its key; zeros come first."""
    lower = np.sort(np.where(signatures < key, signatures, np.uint64(0)), 1)
    return lower[:, lower.shape[1] - int((lower != 0).sum(1).max(initial=0)) :]


def _apart(lower: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the pairs' rows share nothing but zeros."""
    ok = np.ones(len(i), bool)
    for lo in range(0, len(i), 1 << 13):
        x, y = lower[i[lo : lo + (1 << 13)]], lower[j[lo : lo + (1 << 13)]]
        ok[lo : lo + (1 << 13)] = ~((x[:, :, None] == y[:, None, :]) & (x != 0)[:, :, None]).any((1, 2))
    return ok


def _of_small(size: np.ndarray, key: np.ndarray, signatures: np.ndarray, packed: list[bytes], sizes: np.ndarray, threshold: float, split: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of _candidates of many small groups, `size` rows each, without a tree: all of them are bounded at once."""
    end = np.repeat(np.cumsum(size), size)
    count = end - np.arange(len(end)) - 1
    i = np.repeat(np.arange(len(end)), count)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
    a, b = sizes[i], sizes[j]
    ok = (np.minimum(a, b) >= np.maximum(a, b) * threshold - 1e-6) & (~split[i] | (piece[i] != piece[j]))
    i, j = i[ok], j[ok]
    vectors = Vectors(packed)
    v = vectors.at(GROUPS)[1]
    ok = np.ones(len(i), bool)
    for lo in range(0, len(i), 1 << 12):
        x, y = i[lo : lo + (1 << 12)], j[lo : lo + (1 << 12)]
        ok[lo : lo + (1 << 12)] = np.minimum(v[x], v[y]).sum(1, dtype=np.uint32) >= _needed(sizes[x], sizes[y], threshold)
    i, j = i[ok], j[ok]
    ok = vectors.near(i, j, sizes, threshold)
    i, j = i[ok], j[ok]
    ok = _apart(_lower(signatures, key[:, None]), i, j)
    return i[ok], j[ok]


#: What a group of candidates is known by: n-gram, and the two pieces of a split one.
_GROUP = ["key", "one", "two"]


def _groups(batches, names: list[str]):
    """The rows of a partition by _GROUP: (key, whether it's two pieces, columns)."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    key, one, two = (table.column(n).to_numpy() for n in _GROUP)
    order = np.lexsort((two, one, key))
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (key, one, two)], 0)
    cut = np.flatnonzero(new)
    columns = [table.column(n) for n in names]
    columns = [c.cast(pa.large_string()) if pa.types.is_string(c.type) else c for c in columns]  # a group's texts may be over 2 GB
    for lo, hi in zip(cut, [*cut[1:], len(order)]):
        if hi - lo > 1:
            first = order[lo]
            yield (int(key[first]), int(one[first]), int(two[first])), [c.take(pa.array(order[lo:hi])) for c in columns]


def _pools(batches, names: list[str]):
    """The rows of a partition by _GROUP: (rows of each group, key, one, two, columns), small groups some at a time."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    group = [table.column(n).to_numpy() for n in _GROUP]
    order = np.lexsort(group[::-1])
    group = [x[order] for x in group]
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in group], 0)
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    end = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = lo + 1
        if size[lo] <= SMALL:
            large = np.flatnonzero(size[lo:] > SMALL)
            hi = max(hi, min(lo + int(large[0]) if len(large) else len(size), int(np.searchsorted(end, end[lo] + POOL, "right"))))
        a, b = end[lo] - size[lo], end[hi - 1]
        yield size[lo:hi], *(x[a:b] for x in group), [table.column(n).take(pa.array(order[a:b])).combine_chunks() for n in names]
        lo = hi


def _matrix(column, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _padded(lists) -> np.ndarray:
    """The rows of a column of lists of n-grams, with zeros at their ends."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = lists.value_lengths().to_numpy()
    out = np.zeros((len(size), int(size.max(initial=0))), np.uint64)
    out[np.arange(out.shape[1]) < size[:, None]] = lists.flatten().to_numpy().view(np.uint64)
    return out


def _class_of(s: np.ndarray) -> tuple[int, int, int]:
    """What tells a set from others: two sums of its hashes and its size."""
    return int(s.sum().view(np.int64)), int(W.mix(s).sum().view(np.int64)), len(s)


class _Sums:
    """What a group's pairs come to, without keeping them: who hangs together, and the links of each row."""

    def __init__(self, members: np.ndarray):
        self.members, self.label = members, np.arange(len(members))
        self.links = np.zeros(len(members), np.int64)

    def add(self, a: int, b: np.ndarray) -> None:
        """Pairs of a row with other rows."""
        self.links[a] += self.members[b].sum()
        self.links[b] += self.members[a]
        if (self.label[b] != self.label[a]).any():
            both = np.unique(np.append(self.label[b], self.label[a]))
            to = np.arange(len(self.label))
            to[both] = both[0]
            self.label = to[self.label]

    def rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows that are in pairs, the least id that each of them hangs together with)."""
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, self.label, ids)
        at = np.flatnonzero(self.links)
        return at, least[self.label[at]]


def _found(docs: DataFrame, threshold: float, n: int) -> tuple[DataFrame, DataFrame, Callable[[bool], DataFrame]]:
    """(documents with their classes, classes of equal sets with their least doc_id, a function that gives the pairs of
    unequal sets' documents with their classes a and b or, asked for sums, a row for each class of a pair and each group
    that has it in pairs: its document, the least one that it hangs together with there, and its links).

    Of each class only the least doc_id is looked at for pairs. Pairs can be as many as the squares of clusters, the
    sums' rows are no more than those of the prefixes.
    """
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    def describe(batches):
        for batch in batches:
            rows = [(), [], [], [], [], []]
            ids = W.column(batch, "doc_id")
            keep = []
            for i, s in enumerate(sets(W.column(batch, "text"), n)):
                if not len(s):
                    continue
                keep.append(i)
                for to, x in zip(rows[1:4], _class_of(s)):
                    to.append(x)
                rows[4].append(_signature(s).tobytes())
                rows[5].append(_vector(s))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(keep, pa.int64())), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.binary()), pa.array(rows[5], pa.binary())],
                names=["doc_id", "sum1", "sum2", "size", "signature", "vector"],
            )

    described = written(docs.transform(mapped, describe, "doc_id long, sum1 long, sum2 long, size long, signature binary, vector binary"))
    classes = written(described.groupBy("sum1", "sum2", "size").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"), F.first("vector").alias("vector")))

    def explode(batches):
        for batch in batches:
            keys = _matrix(W.column(batch, "signature"), np.int64, SIGNATURE) if batch.num_rows else np.zeros((0, SIGNATURE), np.int64)
            row, place = np.nonzero(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys[row, place]), W.column(batch, "sum2").take(pa.array(row))], names=["key", "id"])

    def several(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        key, own = (table.column(n).to_numpy() for n in ("key", "id"))
        order = np.argsort(key)
        key, own = key[order], own[order]
        size = np.diff(np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key)))
        many, size = np.repeat(size > 1, size), np.repeat(size, size)
        yield pa.RecordBatch.from_arrays([pa.array(own[many]), pa.array(size[many].astype(np.int64)), pa.array(key[many])], names=["id", "c", "key"])

    width = parts(docs)
    postings = classes.select("sum2", "signature").transform(mapped, explode, "key long, id long")
    frequent = postings.repartition(width, "key").transform(mapped, several, "id long, c long, key long").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("keys"))
    prefix = classes.select(F.col("sum2").alias("id"), "doc_id", "size", "vector").join(frequent, "id")
    # n-grams that no other signature has are the rarest of all, and nothing is found by them
    prefix = prefix.withColumn("n", (F.size("keys") - F.least(F.lit(shared_at_least(threshold)), F.greatest(F.lit(1), F.ceil(F.col("size") * threshold - 1e-6))) + 1).cast("int")).where("n > 0")
    prefix = written(prefix.select("id", "doc_id", "size", "vector", F.slice("keys.key", F.lit(1), F.col("n")).alias("keys")))
    held = prefix.select(F.explode("keys").alias("key"), "id")
    split = F.ceil(F.col("c") / HEAVY).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("n")).cast("int")
    groups = held.join(held.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "key")
    groups = groups.withColumn("n", split).withColumn("piece", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    groups = written(groups.select("key", F.least("piece", "other").alias("one"), F.greatest("piece", "other").alias("two"), "piece", "id"))

    def search(batches):
        for counts, key, one, two, (ids, docs, piece, size, keys, vector) in _pools(batches, ["id", "doc_id", "piece", "size", "keys", "vector"]):
            found = np.zeros(len(ids), bool)
            prefixes, packed, sizes, pieces = _padded(keys), vector.to_pylist(), size.to_numpy(), piece.to_numpy()
            if counts[0] > SMALL:
                pairs = _candidates(int(key[0].view(np.uint64)), prefixes, packed, sizes, threshold, pieces if one[0] < two[0] else None)
            else:
                pairs = [_of_small(counts, key.view(np.uint64), prefixes, packed, sizes, threshold, one < two, pieces)]
            for i, j in pairs:
                found[i] = found[j] = True
            if found.any():
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[at]) for x in (key, one, two)), *(c.take(pa.array(at)) for c in (piece, ids, docs, keys))], names=[*_GROUP, "piece", "id", "doc_id", "keys"])

    wanted = written(groups.join(prefix, "id").repartition(width, *_GROUP).transform(mapped, search, "key long, one int, two int, piece int, id long, doc_id long, keys array<long>"))

    def verify(batches, sums):
        for (key, one, two), (of, ids, piece, keys, texts, c) in _groups(batches, ["id", "doc_id", "piece", "keys", "text", "c"]):
            has = np.asarray(texts.is_valid())
            prefixes = dict(zip(of.to_numpy()[~has].tolist(), _padded(keys.filter(pa.array(~has)))))
            of, ids, piece, c, own = of.to_numpy()[has].tolist(), ids.to_numpy()[has], piece.to_numpy()[has], c.to_numpy()[has], list(sets(texts.filter(pa.array(has)).combine_chunks(), n))
            once = {of[r]: r for r, s in enumerate(own) if len(s) and _class_of(s)[1] == of[r]}  # repeated rows, and other texts of the doc_id
            if len(once) < 2:
                continue
            ids, piece, own, prefixes = ids[[*once.values()]], piece[[*once.values()]], [own[r] for r in once.values()], np.stack([prefixes[x] for x in once])
            sizes = np.array([len(s) for s in own])
            classes = np.array([_class_of(s) for s in own], np.int64)
            every, place = np.unique(np.concatenate(own), return_inverse=True)
            first = np.concatenate([[0], np.cumsum(sizes)])
            mark = np.zeros(len(every), bool)
            out, total = [[], [], [], [], []], _Sums(c[[*once.values()]])
            for i, j in _candidates(np.int64(key).view(np.uint64), prefixes, [_vector(s) for s in own], sizes, threshold, piece if one < two else None):
                order = np.argsort(i, kind="stable")
                i, j = i[order], j[order]
                cut = np.flatnonzero(np.diff(i, prepend=-1))
                for lo, hi in zip(cut, [*cut[1:], len(i)]):
                    a = i[lo]
                    mine = place[first[a] : first[a + 1]]
                    mark[mine] = True
                    for k in range(lo, hi, 1024):
                        some = j[k : min(hi, k + 1024)]
                        at = np.concatenate([place[first[b] : first[b + 1]] for b in some])
                        both = np.add.reduceat(mark[at].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
                        value = both / (sizes[a] + sizes[some] - both)
                        good = value >= threshold
                        if sums:
                            total.add(a, some[good])
                            continue
                        for to, x in zip(out, (np.full(good.sum(), ids[a]), ids[some[good]], value[good], np.tile(classes[a], (good.sum(), 1)), classes[some[good]])):
                            to.append(x)
                    mark[mine] = False
            if sums:
                at, root = total.rows(ids)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (ids[at], root, *classes[at].T, total.links[at]))], names=["doc_id", "root", "sum1", "sum2", "size", "links"])
            elif out[0]:
                a, b, value, of_a, of_b = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(value), *(pa.array(x) for x in (*of_a.T, *of_b.T))], names=["doc_id_a", "doc_id_b", "jaccard", "a1", "a2", "a3", "b1", "b2", "b3"])

    def verified(sums: bool) -> DataFrame:
        asked = wanted.withColumn("c", F.lit(1).cast("long"))
        if sums:  # the doc_ids of a class
            count = described.select(F.col("sum2").alias("id"), "doc_id").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("c"))
            asked = written(wanted.join(count, "id"))
        near = docs.join(broadcast_if_small(asked.drop("keys")), "doc_id").select(*_GROUP, "piece", "id", "doc_id", F.lit(None).cast("array<long>").alias("keys"), "text", "c")
        near = near.union(asked.select(*_GROUP, "piece", "id", "doc_id", "keys", F.lit(None).cast("string"), "c")).repartition(width, *_GROUP)
        if sums:
            return near.transform(mapped, lambda batches: verify(batches, True), "doc_id long, root long, sum1 long, sum2 long, size long, links long")
        near = near.transform(mapped, lambda batches: verify(batches, False), "doc_id_a long, doc_id_b long, jaccard double, a1 long, a2 long, a3 long, b1 long, b2 long, b3 long")
        return near.select("doc_id_a", "doc_id_b", "jaccard", *(F.struct(F.col(x + "1").alias("sum1"), F.col(x + "2").alias("sum2"), F.col(x + "3").cast("long").alias("size")).alias(x) for x in "ab"))

    return described, classes, verified


def join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """Pairs (doc_id_a, doc_id_b, jaccard) of similarity `threshold` at least, doc_id_a < doc_id_b, reduced by classes.

    Documents whose sets are equal form a class: its smallest doc_id is paired with
    each other member (similarity 1) and alone stands for the class in all further
    pairs, which hold for every member. So copies cost rows in proportion to their
    number, and every group hangs together. `all_pairs` gives the others too.

    Rows with a null doc_id, a null text or a text without words take no part.
    Repeated rows count once, and rows of one doc_id are never paired. The result
    of an empty table is empty. Only doc_id and text are read, so other columns may
    have any names.
    """
    described, classes, verified = _found(docs, threshold, n)
    near = verified(False)
    copies = described.select("sum1", "sum2", "size", F.col("doc_id").alias("doc_id_b")).distinct().join(classes.select("sum1", "sum2", "size", F.col("doc_id").alias("doc_id_a")), ["sum1", "sum2", "size"]).where("doc_id_a <> doc_id_b")
    near = near.select(F.least("doc_id_a", "doc_id_b").alias("doc_id_a"), F.greatest("doc_id_a", "doc_id_b").alias("doc_id_b"), "jaccard").where("doc_id_a <> doc_id_b")
    exact = copies.select("doc_id_a", "doc_id_b", F.lit(1.0).alias("jaccard"))
    return near.union(exact).groupBy("doc_id_a", "doc_id_b").agg(F.max("jaccard").alias("jaccard"))


def _members(described: DataFrame) -> DataFrame:
    """(doc_id, several, class): the classes of each doc_id, and whether they are more than one."""
    own = described.select("doc_id", F.struct("sum1", "sum2", F.col("size").cast("long").alias("size")).alias("class")).groupBy("doc_id").agg(F.collect_set("class").alias("classes"))
    return own.select("doc_id", (F.size("classes") > 1).alias("several"), F.explode("classes").alias("class"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, piece: int = PIECE) -> DataFrame:
    """(doc_id, class_id, links): one row for each doc_id.

    class_id is the least doc_id that it hangs together with by pairs of similarity
    `threshold` at least, its own if there are none; links is the number of other doc_ids
    in such pairs with it, copies included: that of its rows in `all_pairs`. Pairs of
    unequal sets are each looked at, and copies counted, not paired.

    Rows with a null doc_id take no part. A doc_id of which all texts are null or
    without words has no links. Repeated rows count once. The result of an empty table
    is empty. Only doc_id and text are read.
    """
    described, _, verified = _found(docs, threshold, n)
    members = written(_members(described))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    first = members.groupBy("class").agg(F.min("doc_id").alias("doc_id_a"))
    copies = members.join(first, "class").select("doc_id_a", F.col("doc_id").alias("doc_id_b")).where("doc_id_a <> doc_id_b")
    if members.where("several").isEmpty():  # then pairs are counted where they are found
        near = written(verified(True))
        roots = components(near.select(F.col("doc_id").alias("doc_id_a"), F.col("root").alias("doc_id_b")).union(copies)).select("doc_id", "root")
        count = members.groupBy("class").agg((F.count(F.lit(1)) - 1).alias("links"))
        links = near.select(F.struct("sum1", "sum2", "size").alias("class"), "links").union(count).groupBy("class").agg(F.sum("links").alias("links"))
        return _told(every, roots, members.join(links, "class").select("doc_id", "links"))
    near = written(verified(False).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("doc_id_a", "doc_id_b").alias("doc_id_a"), F.greatest("doc_id_a", "doc_id_b").alias("doc_id_b"), "jaccard").distinct())
    edges = near.select("doc_id_a", "doc_id_b").where("doc_id_a <> doc_id_b").union(copies)
    roots = components(edges).select("doc_id", "root")
    count = members.where("NOT several").groupBy("class").agg(F.count(F.lit(1)).alias("c"))
    pairs = near.select("a", "b").where("a <> b").distinct()
    both = pairs.union(pairs.select("b", "a")).join(count.select(F.col("class").alias("b"), "c"), "b").select(F.col("a").alias("class"), "c").union(count.select("class", F.col("c") - 1))
    links = members.where("NOT several").join(both.groupBy("class").agg(F.sum("c").alias("links")), "class").select("doc_id", "links")
    mixed = _pairs(members, near, piece, True, parts(docs))
    links = links.union(mixed.select(F.explode(F.array("doc_id_a", "doc_id_b")).alias("doc_id"), F.lit(1).cast("long"))).groupBy("doc_id").agg(F.sum("links").alias("links"))
    return _told(every, roots, links)


def _told(every: DataFrame, roots: DataFrame, links: DataFrame) -> DataFrame:
    out = every.join(roots, "doc_id", "left").join(links, "doc_id", "left")
    return out.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def all_pairs(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, piece: int = PIECE) -> DataFrame:
    """Pairs (doc_id_a, doc_id_b, jaccard) of similarity `threshold` at least, doc_id_a < doc_id_b: all of them.

    Those of `join`, and each pair of classes (a class with itself too) given for
    all pairs of their members: a class of m copies has m * (m - 1) / 2 rows. Members
    go in pieces of `piece`, so a task's rows in memory are few however large a class is.
    Which rows take part is as in `join`.
    """
    described, _, verified = _found(docs, threshold, n)
    members = written(_members(described))
    near = written(verified(False))
    out = _pairs(members, near, piece, False, parts(docs))
    return out if members.where("several").isEmpty() else out.union(_pairs(members, near, piece, True, parts(docs)))


def _pairs(members: DataFrame, near: DataFrame, piece: int, several: bool, width: int) -> DataFrame:
    """The pairs of doc_ids that have one class each, or (`several`) those with one that has more, by which it can be paired with another several times."""
    members = members.groupBy("class", "several").agg(F.collect_list("doc_id").alias("ids"))
    many = members.groupBy("class").agg(F.sum(F.size("ids")).alias("n")).where("n > 1")
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard").where("a <> b")
    pairs = pairs.union(many.select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("jaccard"))).groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))
    cut = F.expr(f"transform(sequence(0, (size(ids) - 1) div {piece}), i -> slice(ids, cast(i * {piece} + 1 AS int), {piece}))")
    pieces = members.select("class", "several", F.posexplode(cut).alias("at", "ids"))
    one, other = (pieces.select(F.col("class").alias(x), F.struct("several", "at").alias("at_" + x), F.col("ids").alias("ids_" + x)) for x in "ab")
    some = pairs.join(one, "a").join(other, "b").where("a <> b OR at_a <= at_b").where(("" if several else "NOT ") + "(at_a.several OR at_b.several)")
    some = some.select("jaccard", (F.expr("a = b AND at_a = at_b")).alias("same"), "ids_a", "ids_b").repartition(width)
    some = some.select("jaccard", "same", "ids_b", F.explode("ids_a").alias("x")).select("jaccard", "same", "x", F.explode("ids_b").alias("y"))
    some = some.where("x < y OR (x > y AND NOT same)").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"), "jaccard")
    return some.groupBy("doc_id_a", "doc_id_b").agg(F.max("jaccard").alias("jaccard")) if several else some  # else each pair comes once


def all_pairs_sql(table: str = "documents", threshold: float = THRESHOLD) -> str:
    """The pairs of `all_pairs` for 3-grams, from a join on every n-gram."""
    return rf"""
WITH w AS (SELECT DISTINCT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\x0B]+') AS w FROM {table} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT doc_id, row_number() OVER () AS r, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [array_to_string(w, ' ')] END) AS g FROM w WHERE len(w) > 0),
p AS (SELECT r, doc_id, len(g) AS n, unnest(g) AS gram FROM s),
c AS (SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS both_have FROM p a JOIN p b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY a.r, b.r, a.doc_id, b.doc_id)
SELECT doc_id_a, doc_id_b, max(both_have::DOUBLE / (m + n - both_have)) AS jaccard FROM c WHERE both_have::DOUBLE / (m + n - both_have) >= {threshold} GROUP BY doc_id_a, doc_id_b"""


def classes_sql(table: str = "documents", threshold: float = THRESHOLD) -> str:
    """The rows of `classes` for 3-grams, from all pairs."""
    return rf"""
WITH RECURSIVE pairs AS MATERIALIZED (SELECT doc_id_a, doc_id_b FROM ({all_pairs_sql(table, threshold)})),
near AS MATERIALIZED (SELECT doc_id_a AS a, doc_id_b AS b FROM pairs UNION ALL SELECT doc_id_b, doc_id_a FROM pairs),
reached AS (SELECT DISTINCT a, a AS b FROM near UNION SELECT r.a, n.b FROM reached r JOIN near n ON r.b = n.a),
root AS (SELECT a, min(b) AS root FROM reached GROUP BY a),
links AS (SELECT a, count(*) AS links FROM near GROUP BY a)
SELECT d.doc_id, coalesce(root, d.doc_id) AS class_id, coalesce(links, 0) AS links FROM (SELECT DISTINCT doc_id FROM {table} WHERE doc_id IS NOT NULL) d LEFT JOIN root ON root.a = d.doc_id LEFT JOIN links ON links.a = d.doc_id"""


def components(edges: DataFrame, a: str = "doc_id_a", b: str = "doc_id_b") -> DataFrame:
    """(doc_id, root): the smallest id that each id hangs together with; roots included.

    Each task first contracts its own edges; large-star and small-star rounds, as
    many as the logarithm of the longest chain needs, do the rest.
    """

    def contract(batches):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = find(x), find(y)
                parent[max(x, y)] = min(x, y)
        ids = [x for x in parent if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], names=["u", "v"])

    now = written(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").transform(mapped, contract, "u long, v long"))
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = written(small)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("doc_id"), "root").union(now.select(F.col("v").alias("doc_id"), F.col("v").alias("root")).distinct())


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """`docs` with one row of each group of similar documents: that of the smallest doc_id.

    Repeated rows of that doc_id all stay, as do rows that take no part in the join.
    """
    described, classes, verified = _found(docs, threshold, n)
    copies = described.select("sum1", "sum2", "size", F.col("doc_id").alias("doc_id_a")).join(classes.select("sum1", "sum2", "size", F.col("doc_id").alias("doc_id_b")), ["sum1", "sum2", "size"])
    edges = written(verified(True).select(F.col("doc_id").alias("doc_id_a"), F.col("root").alias("doc_id_b")).union(copies.select("doc_id_a", "doc_id_b")).where("doc_id_a <> doc_id_b"))
    name = unused(docs) + "gone"
    gone = components(edges).where("doc_id <> root").select(F.col("doc_id").alias(name))
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))
