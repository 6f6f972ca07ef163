"""Vectorised word hashing over Arrow string columns.

A word is a maximal run of UTF-8 bytes other than ASCII white space. Words are
identified by 64-bit polynomial hashes; nothing here copies a text into Python
objects.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 2**64))
_K = np.uint64(0xD6E8FEB86659FD93)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * _K
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), CHUNK_BYTES)
        for at, base in enumerate((_R, _RINV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[at] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def powers(n: int) -> np.ndarray:
    """1, R, R^2, ... of the polynomial hash."""
    return _power_tables(n)[0][:n]


def chunks(col: pa.Array, most: int = CHUNK_BYTES):
    """Row ranges [a, b) of a string array, each of about `most` bytes (one row at least)."""
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int32 if pa.types.is_string(col.type) else np.int64)[col.offset : col.offset + n + 1]
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, int(off[a]) + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


class Words:
    """Words of the rows [a, b) of a string array; null rows have none.

    hash: word hashes; first[i]:first[i + 1] are the words of row i; start, end:
    byte positions in `data`, whose row i begins at row[i].
    """

    def __init__(self, col: pa.Array, a: int, b: int):
        wide = np.int32 if pa.types.is_string(col.type) else np.int64
        off = np.frombuffer(col.buffers()[1], wide)[col.offset + a : col.offset + b + 1].astype(np.int64)
        lo, hi = int(off[0]), int(off[-1])
        raw = col.buffers()[2]
        self.data = data = np.frombuffer(raw, np.uint8)[lo:hi] if raw is not None else np.zeros(0, np.uint8)
        self.row = off - lo
        n = len(data)
        solid = ~WHITE[data]
        edge = np.zeros(n + 1, bool)
        edge[self.row] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = solid[:-1], solid[1:]
        self.start = np.flatnonzero(solid & (~before | edge[:n]))
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        up, down = _power_tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, self.row)

    def text(self, i: int, j: int) -> bytes:
        """Bytes from word i up to the end of word j - 1."""
        return self.data[self.start[i] : self.end[j - 1]].tobytes() if j > i else b""


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on (rows are not told apart here)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    g = np.zeros(m, np.uint64)
    for t in range(n):
        g *= _R
        g += h[t : t + m]
    return mix(g)


def of_bytes(text: bytes) -> "Words":
    """Words of one text."""
    return Words(pa.array([text], pa.binary()).cast(pa.large_binary()).view(pa.large_string()), 0, 1)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
