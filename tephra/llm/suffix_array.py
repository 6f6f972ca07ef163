"""Repeats from the interval tree of common prefixes of an enhanced suffix array.

In each anchor's partition the suffixes are sorted and the lengths of neighbours'
common prefixes are scanned with a stack. Each interval of the scan is a repeat that
can't be prolonged to the right by all its occurrences; those whose left extensions
differ are the maximal ones and are given with all their occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tephra.llm import suffixes as S
from tephra.llm.frames import documents, written

WORDS = S.WORDS
#: Bytes of text whose suffixes are unpacked at once.
MEMORY = 64 << 20
#: Occurrences in a batch of rows.
ROWS = 1 << 16


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of each interval, inner ones first; lcp[i] is that of suffixes i and i + 1."""
    stack = [(0, 0)]
    for i, l in enumerate([*lcp, 0]):
        begin = i
        while stack[-1][0] > l:
            height, begin = stack.pop()
            yield height, begin, i
        if stack[-1][0] < l:
            stack.append((l, begin))


def inner(f: S.Family) -> Iterator[tuple[int, int, int]]:
    return intervals(f.lcp)


def _groups(words: int):
    def work(keys):
        for members, low, high in keys:
            rows, held = [[], [], [], [], [], [], []], 0
            for f in S.openings(members, words):
                for depth, lo, hi in intervals(f.lcp):
                    if low <= depth < high and f.maximal(lo, hi, depth, words):
                        at = lo + np.argsort(f.rank[lo : hi + 1])
                        rid, start = f.rid[at], f.start[at]
                        head = np.flatnonzero(np.concatenate([[True], (rid[1:] != rid[:-1]) | (start[1:] != start[:-1] + 1)]))
                        first, n = at[head], len(head)
                        new = (np.full(n, S.repeat_id(f.members[lo], f.o, f.o + depth)), np.full(n, f.o + depth), f.rid[first], f.doc[first], f.known[first], f.start[first], np.diff(np.append(head, len(at))))
                        for to, x in zip(rows, new):
                            to.append(x)
                        held += n
                        if held >= ROWS:
                            yield _batch(rows)
                            rows, held = [[], [], [], [], [], [], []], 0
            if held:
                yield _batch(rows)

    return work


def _batch(rows: list[list[np.ndarray]]) -> pa.RecordBatch:
    repeat, n, rid, doc, known, start, times = map(np.concatenate, rows)
    columns = [pa.array(repeat, pa.int64()), pa.array(n.astype(np.int32)), pa.array(rid), pa.array(doc, mask=~known), pa.array(start.astype(np.int32)), pa.array(times.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["repeat_hash", "n_words", "rid", "doc_id", "start", "times"])


def repeats(docs: DataFrame, words: int = WORDS, memory: int = MEMORY) -> DataFrame:
    """(repeat_hash, n_words, rid, doc_id, start, times): each maximal repeat of `words` words or more, with all occurrences.

    A row for each occurrence, at word number `start`; `times` of them begin there, each a
    word after the other (more than one only in runs of one word). A repeat is maximal if
    neither its left nor its right neighbour word is the same in all occurrences. Words are
    runs of bytes other than ASCII white space. Suffixes of more than `memory` bytes under
    one anchor are worked in parts; it changes no result.

    Rows with a null text have no words; a null doc_id is an id of its own. Rows
    equal in doc_id and text count once; rows of one doc_id with other texts are
    documents of their own, told apart by rid, the hash of doc_id and text. Texts
    under `words` words have no repeats; an empty table gives none. Only doc_id and
    text are read.
    """
    return S.found(docs, words, _groups(words), "repeat_hash long, n_words int, rid long, doc_id long, start int, times int", memory)


NESTED = "repeat_hash long, n_words int, occurrences long, parent long, rid long, doc_id long, start int, times int"


def _nested(words: int):
    def work(keys):
        rows, held = [], 0
        for members, low, high in keys:
            for f in S.openings(members, words):
                rank, hashes, size, count, parent, at, of = f.rank.tolist(), [], [], [], [], [], []
                done: list[tuple[int, int, int, int]] = []  # first and last suffix, repeat and earliest suffix of intervals without a parent yet
                for depth, lo, hi in intervals(f.lcp):
                    if not (low <= depth < high and f.maximal(lo, hi, depth, words)):
                        continue
                    own, end, best = [], hi + 1, -1
                    while done and done[-1][0] >= lo:
                        a, b, child, first = done.pop()
                        parent[child] = len(hashes)
                        own += range(b + 1, end)
                        end = a
                        best = first if best < 0 or rank[first] < rank[best] else best
                    own += range(lo, end)
                    for x in own:
                        best = x if best < 0 or rank[x] < rank[best] else best
                    own = own or [best]
                    at += own
                    of += [len(hashes)] * len(own)
                    done.append((lo, hi, len(hashes), best))
                    for to, x in zip((hashes, size, count, parent), (S.repeat_id(f.members[lo], f.o, f.o + depth), f.o + depth, hi - lo + 1, -1)):
                        to.append(x)
                if not hashes:
                    continue
                at, of = np.array(at), np.array(of)
                order = np.lexsort((f.rank[at], of))
                at, of = at[order], of[order]
                rid, start = f.rid[at], f.start[at]
                head = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (rid[1:] != rid[:-1]) | (start[1:] != start[:-1] + 1)]))
                first, r, above = at[head], of[head], np.array(parent)[of[head]]
                hashes = np.array(hashes, np.int64)
                rows.append((hashes[r], np.array(size)[r], np.array(count)[r], hashes[above], above >= 0, f.rid[first], f.doc[first], f.known[first], f.start[first], np.diff(np.append(head, len(at)))))
                held += len(head)
                if held >= ROWS:
                    yield _nested_batch(rows)
                    rows, held = [], 0
        if held:
            yield _nested_batch(rows)

    return work


def _nested_batch(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    repeat, n, count, parent, has, rid, doc, known, start, times = map(np.concatenate, zip(*rows))
    columns = [pa.array(repeat), pa.array(n.astype(np.int32)), pa.array(count.astype(np.int64)), pa.array(parent, mask=~has), pa.array(rid), pa.array(doc, mask=~known), pa.array(start.astype(np.int32)), pa.array(times.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["repeat_hash", "n_words", "occurrences", "parent", "rid", "doc_id", "start", "times"])


def nested(docs: DataFrame, words: int = WORDS, memory: int = MEMORY) -> DataFrame:
    """(repeat_hash, n_words, occurrences, parent, rid, doc_id, start, times): the repeats of `repeats`, each place once by its longest.

    A row for each place (or run of places, as there) with the longest maximal repeat
    that begins there. `parent` is the next shorter repeat that begins wherever this one
    does, null if there is none. A repeat that begins nowhere as the longest has one row,
    at its first occurrence. So a repeat's occurrences are the places of its own rows and
    of those of the repeats below it, `occurrences` in all: nothing is lost, and rows are
    two for each place at most, where `repeats` has one for each pair of place and repeat.

    Under an anchor of more than `memory` bytes the shorter repeats and the longer
    ones of each prefix are worked in parts: places have a row in each part, and the
    shortest repeats of a part have no parent. Occurrences are found in the same way.
    Which rows take part is as in `repeats`.
    """
    return S.found(docs, words, _nested(words), NESTED, memory)


def deduplicate(docs: DataFrame, words: int = WORDS, memory: int = MEMORY) -> DataFrame:
    """`docs` with all but the first occurrence of each repeat cut from the texts.

    First is the one of the least doc_id and place. Occurrences that overlap the
    first one stay. A text of which no word is left goes.
    Repeated rows are cut alike. n_chars is counted anew.
    """
    return S.removed(docs, written(S.found(docs, words, S.cutter(words, inner), S.CUTS, memory)))


def query(spark, sf_dir: str) -> DataFrame:
    return nested(documents(spark, sf_dir))
