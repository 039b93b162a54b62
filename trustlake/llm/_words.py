"""Vectorised words, word hashes and word windows of Arrow text columns.

A batch of texts is cut into words with a handful of numpy passes over its
UTF-8 bytes; no Python object is made per word. Nulls count as empty texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PUNCT = np.ones(256, dtype=bool)
_PUNCT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LANE = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=U)
LONG_WORD = 512
SEGMENT = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer, in a new array."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and the n+1 offsets of the texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + n + 1)[column.offset :] if n else np.zeros(1, dtype=np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch of texts. ``first[d]:first[d+1]`` are the words of text d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    @property
    def position(self) -> np.ndarray:
        return np.arange(len(self.hash)) - np.repeat(self.first[:-1], self.count)


def _spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = [], []
    edges = np.unique(offsets)
    for lo in range(0, len(data), SEGMENT):
        hi = min(lo + SEGMENT, len(data))
        word = ~gap[data[lo:hi]]
        before = np.empty(hi - lo, dtype=bool)
        before[1:] = word[:-1]
        before[0] = lo > 0 and not gap[data[lo - 1]]
        after = np.empty(hi - lo, dtype=bool)
        after[:-1] = word[1:]
        after[-1] = hi < len(data) and not gap[data[hi]]
        cut = edges[np.searchsorted(edges, lo) : np.searchsorted(edges, hi)] - lo
        before[cut] = False
        cut = edges[np.searchsorted(edges, lo + 1) : np.searchsorted(edges, hi + 1)] - lo - 1
        after[cut] = False
        starts.append(np.flatnonzero(word & ~before) + lo)
        ends.append(np.flatnonzero(word & ~after) + lo + 1)
    if not starts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(starts), np.concatenate(ends)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    lanes = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    length = end - start
    out = mix(length.astype(U) * U(0x9E3779B97F4A7C15) + U(seed))
    todo = np.flatnonzero(length <= LONG_WORD)
    at = 0
    while len(todo):
        lane = lanes[start[todo] + at] & _LANE[np.minimum(length[todo] - at, 8)]
        out[todo] = mix((out[todo] ^ lane) * U(0xD6E8FEB86659FD93) + U(0x2545F4914F6CDD1D))
        at += 8
        todo = todo[length[todo] > at]
    for i in np.flatnonzero(length > LONG_WORD):
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def words(column: pa.Array, *, lower: bool = False, punctuation: bool = False, seed: int = 0) -> Words:
    """Cut a text column at ``[\\x20\\x09-\\x0D]+``; with ``punctuation`` at ASCII punctuation as well."""
    data, offsets = text_bytes(column)
    if lower:
        data = _LOWER[data]
    start, end = _spans(data, offsets, _PUNCT if punctuation else _SPACE)
    return Words(data, start, end, np.searchsorted(start, offsets), _hashes(data, start, end, seed))


def windows(w: Words, k: int, hashes: np.ndarray | None = None) -> np.ndarray:
    """Hash of the k words from each word on, over the whole batch (those that cross a text's end are meaningless)."""
    h = w.hash if hashes is None else hashes
    n = max(0, len(h) - k + 1)
    powers, size = {1: h}, 1
    while size * 2 <= k:
        prev = powers[size]
        m = len(prev) - size
        powers[size * 2] = mix(prev[: max(m, 0)] * U(0x9E3779B97F4A7C15) + prev[size:]) if m > 0 else prev[:0]
        size *= 2
    out = np.full(n, U(k))
    at = 0
    for size in sorted(powers, reverse=True):
        if k - at >= size:
            out = mix(out * U(0xC2B2AE3D27D4EB4F) + powers[size][at : at + n])
            at += size
    return out


def inside(w: Words, k: int) -> np.ndarray:
    """Indices of the words from which k words of the same text follow."""
    n = np.maximum(w.count - k + 1, 0)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(w.first[:-1], n)


def parts(batch: pa.RecordBatch, text: str, most: int = 8 << 20, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text (one row at least) and ``rows`` rows each, so that memory stays bounded and a text's place fits 14 bits."""
    size = batch.column(batch.schema.get_field_index(text)).nbytes
    if (size <= most and batch.num_rows <= rows) or batch.num_rows <= 1:
        yield batch
        return
    half = batch.num_rows // 2
    yield from parts(batch.slice(0, half), text, most, rows)
    yield from parts(batch.slice(half), text, most, rows)


def groups(sorted_keys: np.ndarray) -> np.ndarray:
    """First index of each run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1])
