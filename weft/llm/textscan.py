"""Vectorised scanning of Arrow text columns: word spans, word hashes, sequence hashes, sliding minima.

Hashes are polynomial prefix sums over 64-bit wrapping arithmetic with an odd base, finished by an avalanche mix; the
hash of any span is a difference of two prefix sums, so one pass serves words and word sequences of every length.
Equal byte sequences always have equal hashes; whoever needs exact equality compares the words afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one pass handles (a longer single text is one pass).
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit avalanche (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        full = np.full(size, np.uint64(base))
        full[0] = 1
        have = _powers[base] = np.multiply.accumulate(full)
    return have[:n]


_INVERSE = pow(_BASE, -1, 1 << 64)


def _span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each span; values are uint64."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power(_BASE, n), out=sums[1:])
    return mix((sums[end] - sums[start]) * _power(_INVERSE, n + 1)[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of a run of texts: byte spans in ``data``, index of the text, hash."""

    first: int  # index of the first text in the column
    n_docs: int
    data: np.ndarray
    offsets: np.ndarray  # of the texts, in bytes
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-word sequences that start at each word, and whether each stays in one text."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        at = np.arange(n - k + 1)
        return _span_hash(self.hash, at, at + k), self.doc[k - 1 :] == self.doc[: n - k + 1]

    def text(self, a: int, b: int) -> str:
        """Words a..b-1 joined by one space."""
        # bytes.split() knows exactly the six white-space characters of the contracts
        raw = self.data[self.start[a] : self.end[b - 1]].tobytes()
        return b" ".join(raw.split()).decode("utf-8", "surrogatepass")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` bytes: (first, after the last)."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def scan(column: pa.Array, lower: bool = False, limit: int = CHUNK) -> Iterator[Words]:
    """The words of every text, in runs; ``lower`` lower-cases A-Z alone."""
    data, offsets = buffers(column)
    for a, b in chunks(offsets, limit):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if lower:
            part = _LOWER[part]
        yield words(part, off, a)


def words(data: np.ndarray, offsets: np.ndarray, first: int = 0) -> Words:
    n = len(data)
    n_docs = len(offsets) - 1
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(first, n_docs, data, offsets, none, none, none, np.zeros(0, np.uint64))
    solid = ~_SPACE[data]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    opens[inner] = solid[inner]
    closes[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(first, n_docs, data, offsets, start, end, doc, _span_hash(data.astype(np.uint64) + np.uint64(1), start, end))


def joined(w: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text (those that ``keep`` marks) joined by one space: bytes, offsets of the texts, start of each kept word."""
    at = np.flatnonzero(keep) if keep is not None else np.arange(len(w.start))
    edge = np.zeros(len(w.data) + 1, np.int8)
    edge[w.start[at]] += 1
    edge[w.end[at]] -= 1  # a word's end may be the next text's first word: both count
    mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
    # the white space right after a word stays if another word of the text follows
    gap = w.end[at[:-1]][w.doc[at[1:]] == w.doc[at[:-1]]]
    data = w.data.copy()
    data[gap] = 0x20
    mask[gap] = True
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return data[mask], sums[w.offsets], sums[w.start[at]]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column from UTF-8 bytes and offsets."""
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """A string column of data[start:end] for each pair."""
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    return strings(data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])], offsets)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def distinct_by_doc(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs, ordered by text."""
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    keep = np.ones(len(d), bool)
    keep[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[keep], h[keep]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def count_words(column: pa.Array) -> np.ndarray:
    """Words of each text."""
    data, offsets = buffers(column)
    out = np.zeros(len(offsets) - 1, np.int64)
    for a, b in chunks(offsets, 4 * CHUNK):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if len(part):
            solid = ~_SPACE[part]
            opens = solid.copy()
            opens[1:] &= ~solid[:-1]
            inner = off[1:-1]
            inner = inner[(inner > 0) & (inner < len(part))]
            opens[inner] = solid[inner]
            sums = np.zeros(len(part) + 1, np.int64)
            np.cumsum(opens, out=sums[1:])
            out[a:b] = sums[off[1:]] - sums[off[:-1]]
    return out
