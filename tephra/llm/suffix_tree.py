"""Repeats from suffix trees over partitions of common prefixes.

Suffixes are split by prefixes of varying length: the anchor's words first (by which
they are shuffled), and longer and longer ones where they would not fit in a task's
memory unpacked. A prefix that is split further leaves its suffixes, cut to the next
length, behind as the top of its tree, so no inner node is lost. Each partition's tree is built on its own, and its
deep inner nodes with differing left extensions are the maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tephra.llm import suffixes as S
from tephra.llm.frames import documents

WORDS = S.WORDS
#: Bytes of text whose suffixes are unpacked at once.
MEMORY = 64 << 20


class Tree:
    """Suffix tree of a family's right sides: each suffix in turn is hung on the rightmost path.

    Nodes in parallel lists: depth in words, first and last leaf, parent.
    """

    def __init__(self, lcp: list[int]):
        self.depth, self.first, self.last, self.parent = [0], [0], [len(lcp)], [-1]
        path = [0]
        for leaf, shared in enumerate(lcp):
            below = -1
            while self.depth[path[-1]] > shared:
                below = path.pop()
                self.last[below] = leaf
            if self.depth[path[-1]] < shared:  # an edge is split, or a leaf's edge gets a node
                node = len(self.depth)
                for to, x in zip((self.depth, self.first, self.last, self.parent), (shared, self.first[below] if below >= 0 else leaf, len(lcp), path[-1])):
                    to.append(x)
                if below >= 0:
                    self.parent[below] = node
                path.append(node)

    def inner(self) -> Iterator[tuple[int, int, int]]:
        """(depth, first leaf, last leaf), children before parents."""
        for i in sorted(range(len(self.depth)), key=lambda i: -self.depth[i]):
            yield self.depth[i], self.first[i], self.last[i]


def repeats(docs: DataFrame, words: int = WORDS, memory: int = MEMORY) -> DataFrame:
    """(rid, doc_id, start, n_words, first_doc_id, first_start): what to cut so that each repeat is left once.

    A row for each place at which a repeat of `words` words or more begins that has
    an earlier occurrence (by doc_id, then place): the longest such repeat, and where
    it is first. start and first_start are word numbers; words are runs of bytes
    other than ASCII white space. An overlap with the first occurrence in the same
    text is left out.

    Rows with a null text have no words; a null doc_id is an id of its own and comes
    first. Rows equal in doc_id and text count once; rows of one doc_id with other
    texts are documents of their own, told apart by rid, the hash of doc_id and text.
    Shorter texts have no repeats; an empty table gives none. Only doc_id and text are
    read.
    """
    cuts = S.found(docs, words, S.cutter(words, lambda f: Tree(f.lcp).inner()), S.CUTS, memory)
    # places that two partitions of one tree answer for
    return cuts.groupBy("rid", "doc_id", "start").agg(F.max(F.struct("n_words", -F.col("first_doc_id"), -F.col("first_start"))).alias("m")).select("rid", "doc_id", "start", "m.n_words", (-F.col("m.col2")).alias("first_doc_id"), (-F.col("m.col3")).alias("first_start"))


def query(spark, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir))
