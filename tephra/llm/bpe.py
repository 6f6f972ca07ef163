"""Byte-level BPE by dynamic programming over prefixes.

For each byte prefix of a piece exactly one token can come last in the encoding
of that prefix: a vocabulary token t that ends there and whose predecessor u, the
last token of the prefix before t, leaves (u, t) unmerged. The table of last
tokens therefore answers every prefix, grows by appends without rework, and the
encoding is read off backwards.

Vocabularies are rank files (base64 token, rank); their path is a parameter.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from array import array
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tephra.llm import words as W
from tephra.llm.frames import documents, mapped, with_fields

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Entries of one generation of a worker's caches, two of which are kept, and the characters
#: that an entry may have: some tens of MB in all. Longer pieces are encoded each time.
#: Results don't depend on either.
CACHE = 300_000
CACHED = 48
#: Characters of text whose new words are encoded ahead together (one row at least).
AHEAD = 2_000_000


#: Numbers that aren't decimal digits: `re` takes them for letters.
_ODD = "".join(map(re.escape, (c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("No", "Nl"))))
#: White_Space of Unicode; `re` counts U+001C to U+001F too.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_REST = rf"| ?(?:[^{_WHITE}\w]|_)+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
_ENDS = r"'s|'t|'re|'ve|'m|'ll|'d"
_HAS_ODD = re.compile(f"[{_ODD}]")
_PLAIN = re.compile(rf"{_ENDS}| ?[^\W\d_]+| ?\d+{_REST}")
_FULL = re.compile(rf"{_ENDS}| ?[^\W\d_{_ODD}]+| ?[\d{_ODD}]+{_REST}")


def pieces(text: str) -> list[str]:
    """Splits as the usual pattern does, its \\p{L} and \\p{N} spelt in classes that `re` has."""
    return (_PLAIN if text.isascii() or not _HAS_ODD.search(text) else _FULL).findall(text)


#: A space before another character than white space always begins a piece.
_CUT = re.compile(f" (?=[^{_WHITE}])")
_UNCUT = re.compile(rf" (?:[{_WHITE}]|\Z)")
#: Begins a piece whatever comes in place of what follows.
_SAFE = re.compile(f"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")


class Vocabulary:
    def __init__(self, path: str):
        self.rank: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.rank[base64.b64decode(token)] = int(rank)
        self.bytes = dict(zip(self.rank.values(), self.rank))
        self.reach: dict[bytes, int] = {}  # the longest token that ends in these three bytes
        for token in self.rank:
            if len(token) > self.reach.get(token[-3:], 2):
                self.reach[token[-3:]] = len(token)
        self.code = "H" if max(self.bytes) < 65536 else "I"
        self.dtype = np.dtype(self.code)
        self._pair: dict[int, bool] = {}
        self._half: dict[int, tuple[int, int]] = {}
        self._joined: dict[int, int] = {}
        for token, t in sorted(self.rank.items(), key=lambda x: x[1]):  # the two tokens whose merge made t
            for cut in range(1, len(token)):
                u, v = self.rank.get(token[:cut], t), self.rank.get(token[cut:], t)
                if u < t and v < t and self._apart(u, v):
                    self._half[t] = (u, v)
                    self._joined[u << 32 | v] = t
                    break

    def _apart(self, u: int, v: int) -> bool:
        """Whether no merge crosses the border of u and v: undoes the later of the two merges beside it, again and again."""
        most, joined, half = 1 << 60, self._joined, self._half
        while True:
            if joined.get(u << 32 | v, most) < most:
                return False
            left, right = half.get(u), half.get(v)
            if left and (u > v or not right):
                most, u = u, left[1]
            elif right:
                most, v = v + 1, right[0]
            else:
                return True

    def merged(self, piece: bytes) -> list[int]:
        """Plain merging, lowest rank first: the definition that the table is held against."""
        parts, rank = [piece[i : i + 1] for i in range(len(piece))], self.rank
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (rank.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [rank[p] for p in parts]

    def may_follow(self, u: int, t: int) -> bool:
        """Whether t right after u stays as it is; u = -1: whether t is the encoding of its own bytes."""
        key = (u + 1) << 32 | t
        known = self._pair.get(key)
        if known is None:
            if len(self._pair) > 2 * CACHE:
                self._pair.clear()
            known = self._pair[key] = self._apart(u, t) if u >= 0 else len(self.bytes[t]) == 1 or t in self._half
        return known

    def decode(self, tokens) -> bytes:
        return b"".join(map(self.bytes.__getitem__, tokens))


class Prefixes:
    """Last tokens of all prefixes of one piece of bytes; last[0] is a sentinel."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> "Prefixes":
        """Appends bytes; no entry that is there changes."""
        v, last = self.vocabulary, self.last
        rank, reach, pair, check = v.rank.get, v.reach.get, v._pair.get, v.may_follow
        begin, self.piece = len(self.piece), self.piece + more
        piece = self.piece
        for i in range(begin + 1, len(piece) + 1):
            j = i - reach(piece[i - 3 : i], 2) if i > 2 else 0
            for j in range(j if j > 0 else 0, i):
                t = rank(piece[j:i])
                if t is not None:
                    u = last[j]
                    known = pair((u + 1) << 32 | t)
                    if known if known is not None else check(u, t):
                        last.append(t)
                        break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return self

    def truncate(self, n: int) -> "Prefixes":
        self.piece, self.last = self.piece[:n], self.last[: n + 1]
        return self

    def tokens(self, n: int | None = None) -> list[int]:
        """Encoding of the first n bytes (all by default)."""
        i, out = len(self.piece) if n is None else n, []
        while i:
            out.append(self.last[i])
            i -= len(self.vocabulary.bytes[out[-1]])
        return out[::-1]


class _Generations(dict):
    """A cache of two generations; a full one becomes the old one."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > CACHED:
                return value
        self.turn()
        self[key] = value
        return value

    def turn(self) -> None:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Whole texts: split into pieces, each encoded through its prefix table.

    A space before another character than white space always begins a piece, so what
    stands between such spaces is encoded (and, if short, remembered) on its own.
    Pieces that are new in a batch are encoded in sorted order: each takes over the
    table of its predecessor as far as their bytes agree.
    """

    def __init__(self, path: str = VOCABULARY):
        self.vocabulary = v = Vocabulary(path)
        self._piece = _Generations(lambda piece: array(v.code, Prefixes(v, piece.encode("utf-8", "surrogatepass")).tokens()).tobytes())
        self._segment = _Generations(self._new)

    def _new(self, s: str) -> bytes:
        if s[-1:] in (".", ",", "!") and s[:-1].isalpha():
            return self._segment[s[:-1]] + self._piece[s[-1]]
        return self._plain(" " + s)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._piece.__getitem__, pieces(text)))

    def prepare(self, texts: list[str]) -> None:
        """Encodes the words that are new in `texts` ahead, in sorted order."""
        new = set()
        for text in texts:
            new.update(text.split(" "))
        known, old = self._segment, self._segment.old
        new = [s for s in new if s not in known]
        for s in [s for s in new if s in old]:
            known[s]
        new = [s if s.isalpha() else s[:-1] for s in new if s not in old and (s.isalpha() or s[-1:] in (".", ",", "!") and s[:-1].isalpha())]
        new = sorted(" " + s for s in {*new} if s not in known and s not in old)
        table, code, before = Prefixes(self.vocabulary), self.vocabulary.code, b""
        known.turn()
        for s in new:
            if len(s) > CACHED:
                continue
            piece = s.encode()
            n = len(before)
            if n > len(piece):
                n = len(piece)
            if before[:n] != piece[:n]:
                i = 0
                while before[i] == piece[i]:
                    i += 1
                n = i
            known[s[1:]] = array(code, table.truncate(n).append(piece[n:]).tokens()).tobytes()
            before = piece

    def forget(self) -> None:
        """Empties the caches: worker processes outlive their tasks, and other work needs the memory."""
        for cache in (self._segment, self._piece):
            cache.clear()
            cache.old = {}
        self.vocabulary._pair.clear()

    def packed(self, text: str) -> bytes:
        head, *rest = _CUT.split(text) if _UNCUT.search(text) else text.split(" ")
        return self._plain(head) + b"".join(map(self._segment.__getitem__, rest))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), self.vocabulary.dtype)

    def decode(self, tokens) -> str:
        return self.vocabulary.decode(tokens).decode("utf-8", "surrogatepass")


class Document:
    """An encoded text that can be edited.

    The prefix tables of all pieces are kept between cuts that no edit elsewhere can move.
    An edit looks its cuts up by bisection and takes over the tables that it leaves as they
    are, and the part of the others before the first byte that differs.
    """

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.cuts, self.parts, _ = self._encode(text, [])

    def _encode(self, text: str, old: list[Prefixes]) -> tuple[list[int], list[list[Prefixes]], int]:
        """(cuts, the tables between them, bytes that were encoded anew)."""
        cuts, same, rest, fresh = [0, *(m.start() for m in _SAFE.finditer(text)), len(text)], True, {}, 0
        at = iter(old)
        parts = []
        for a, b in zip(cuts, cuts[1:]):
            tables = []
            for piece in pieces(text[a:b]):
                piece = piece.encode("utf-8", "surrogatepass")
                table = next(at, None) if same else None
                if table is None or table.piece != piece:
                    if same:
                        same = False
                        rest = {t.piece: t for t in at}
                    known = rest.pop(piece, None)
                    if known is None:
                        known = table or Prefixes(self.encoder.vocabulary)
                        n = _agree(known.piece, piece)
                        fresh += len(piece) - n
                        known.truncate(n).append(piece[n:])
                    table = known
                tables.append(table)
            parts.append(tables)
        return cuts, parts, fresh

    def tokens(self) -> list[int]:
        return [t for part in self.parts for table in part for t in table.tokens()]

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, a: int, b: int, new: str) -> int:
        """Replaces characters a to b; returns how many bytes were encoded again."""
        i = max(bisect_left(self.cuts, max(a, 1)) - 1, 0)
        j = min(bisect_right(self.cuts, b), len(self.cuts) - 1)
        lo, hi = self.cuts[i], self.cuts[j]
        middle = self.text[lo:a] + new + self.text[b:hi]
        self.text = self.text[:a] + new + self.text[b:]
        cuts, parts, fresh = self._encode(middle, [t for part in self.parts[i:j] for t in part])
        shift = len(new) - (b - a)
        self.cuts = self.cuts[:i] + [lo + c for c in cuts] + [c + shift for c in self.cuts[j + 1 :]]
        self.parts = self.parts[:i] + parts + self.parts[j:]
        return fresh


def _agree(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)) if n else ()
    return int(differ[0]) if len(differ) else n


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """`docs` with `tokens` (array<int>), `n_tokens` and `exact` (whether decoding gives the text back).

    A null text has null in all three, an empty one no tokens. Input columns of
    these names are replaced; other columns, repeated rows and rows of any length
    are passed through.
    """
    docs = docs.drop("tokens", "n_tokens", "exact")

    def run(batches):
        enc = encoder(vocabulary)
        dtype, table = enc.vocabulary.dtype, enc.vocabulary.bytes.__getitem__
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for lo, hi in W.chunks(batch.column(at), AHEAD):
                part = batch.slice(lo, hi - lo)
                texts, packed, exact = part.column(at).to_pylist(), [], []
                enc.prepare([t for t in texts if t])
                for text in texts:
                    one = None if text is None else enc.packed(text)
                    packed.append(b"" if one is None else one)
                    exact.append(None if one is None else b"".join(map(table, np.frombuffer(one, dtype).tolist())) == text.encode("utf-8", "surrogatepass"))
                sizes = np.array([len(p) // dtype.itemsize for p in packed], np.int64)
                offsets = np.zeros(len(sizes) + 1, np.int32)
                np.cumsum(sizes, out=offsets[1:])
                values = np.frombuffer(b"".join(packed), dtype).astype(np.int32)
                null = np.array([e is None for e in exact], bool)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(null)) if len(sizes) else pa.array([], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, tokens, pa.array(sizes.astype(np.int32), mask=null), pa.array(exact, pa.bool_())],
                    names=[*part.schema.names, "tokens", "n_tokens", "exact"],
                )
        enc.forget()

    return docs.transform(mapped, run, with_fields(docs, "tokens array<int>, n_tokens int, exact boolean"))


def query(spark, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
