"""Vectorised word and shingle hashing over the UTF-8 buffers of Arrow string columns.

A "kind" of word is a 256-entry table that says which bytes belong to a word; every multi-byte
character is a word character in all kinds used here, so working on bytes equals working on code points.
Texts are taken in chunks of whole rows, so memory follows the chunk (or the longest single text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 20


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; different salts give independent-looking hashes."""
    with np.errstate(over="ignore"):
        return _splitmix(x ^ U64((salt * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF))


def space_words() -> np.ndarray:
    """Words of characters other than U+0020 and U+0009 to U+000D."""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def alnum_words() -> np.ndarray:
    """Words of ASCII digits and letters and of all characters beyond ASCII."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    return t


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            m = max(n + 1, len(self.up) + len(self.up) // 4)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[U64(1), np.full(m, self.base, U64)], dtype=U64)
                self.down = np.cumprod(np.r_[U64(1), np.full(m, self.inverse, U64)], dtype=U64)
        return self.up[:n], self.down[:n]


_BYTES = _Powers(0x9E3779B97F4A7C15 | 1)
_SEQ = (_Powers(0xC2B2AE3D27D4EB4F | 1), _Powers(0x165667B19E3779F9 | 1))
_BYTE_CODES = mix(np.arange(256, dtype=U64), 7)


@dataclass
class Chunk:
    """Rows first..last of a batch: their bytes, and word bounds and hashes of all of them in row order."""

    first: int
    data: np.ndarray
    doc_at: np.ndarray  # byte offsets of the rows, one more than rows
    start: np.ndarray
    end: np.ndarray
    word_at: np.ndarray  # word offsets of the rows, one more than rows
    hashes: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.doc_at) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts())


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    up, down = _BYTES.upto(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def row_chunks(raw: np.ndarray, at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``limit`` bytes."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def chunks(texts: pa.Array, kind: np.ndarray, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The rows of a string column as tokenised chunks, in order; every row is in exactly one."""
    raw, at = buffers(texts)
    for i, j in row_chunks(raw, at, limit):
        data, doc_at = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        if lower:
            data = LOWER[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = kind[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[doc_at] = True
        start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        yield Chunk(i, data, doc_at, start, end, np.searchsorted(start, doc_at), hash_spans(data, start, end))


def ngrams(c: Chunk, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(word index, 64-bit hash) of every run of k words within one row; ``which``: one of two independent hashes."""
    n = len(c.hashes)
    up, down = _SEQ[which].upto(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U64)
        np.cumsum(mix(c.hashes, 11 + which) * up[:n], out=sums[1:])
        counts = c.counts()
        last = np.repeat(c.word_at[1:], counts) - k
        at = np.flatnonzero(np.arange(n) <= last)
        return at, mix((sums[at + k] - sums[at]) * down[at], 23 + which)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours (by doubling; len - width + 1 values)."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        more = width - have
        out = np.minimum(out[: len(out) - more], out[more:])
    return out


def joined(raw: bytes, keep: np.ndarray | None = None) -> bytes:
    """The (kept) words of a text, joined by a space; bytes.split parts at exactly what space_words() leaves out."""
    words = raw.split()
    return b" ".join(words if keep is None else compress(words, keep.tolist()))
