"""Vectorised token and shingle hashing over Arrow text buffers.

Texts are treated as UTF-8 bytes.  A token's identity is a 64-bit polynomial hash of its bytes,
obtained from prefix sums so that a whole batch is hashed without a Python loop.  Work is done in
chunks of bounded size that end between tokens, so one very long text needs no more scratch memory
than many short ones.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2 << 20
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values, the same on every machine."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + U64(seed << 20)) * U64(0x9E3779B97F4A7C15))


BYTE_CODE = seeded(256, 7)
RADIX = int(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Everything but ASCII white space.
VISIBLE = np.ones(256, dtype=bool)
VISIBLE[[9, 10, 11, 12, 13, 32]] = False
#: ASCII digits, lower-case ASCII letters and every byte of a non-ASCII character.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(1 << 16, 1 << n.bit_length()), base & (2**64 - 1), dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have)
        if len(have) > 4 * CHUNK:
            _powers.pop(base)
    return have


INVERSE = pow(RADIX, -1, 2**64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(pc.cast(column, pa.large_string()), "")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give memory that is free in this worker back to the machine: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not with every C library
        pass


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; what is free after each goes back to the machine."""
    for batch in batches:
        yield batch
        release()


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose text takes about `limit` bytes at most (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(size, dtype=np.int64) // limit
        cuts = np.flatnonzero(np.diff(block)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


@dataclass
class Tokens:
    """Tokens of a batch of texts: byte ranges in the (lower-cased) buffer, text index and hash."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    n_docs: int

    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def _hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(RADIX, len(data))[: len(data)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * powers(INVERSE, len(data))[start])


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and do not overlap."""
    parts, at = [], 0
    while at < len(start):
        upto = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK, side="right")))
        lo, hi = start[at], end[upto - 1]
        parts.append(_hash_ranges(data[lo:hi], start[at:upto] - lo, end[at:upto] - lo))
        at = upto
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def tokenize(raw: np.ndarray, offsets: np.ndarray, keep: np.ndarray, lower: bool = True) -> Tokens:
    """Maximal runs of bytes that `keep` marks, never across two texts."""
    data = _LOWER[raw] if lower else raw
    n = len(data)
    inside = keep[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    opens = np.empty(n, dtype=bool)
    if n:
        opens[0] = inside[0]
        opens[1:] = inside[1:] & (~inside[:-1] | edge[1:-1])
    start = np.flatnonzero(opens)
    if n:
        opens[-1] = inside[-1]
        opens[:-1] = inside[:-1] & (~inside[1:] | edge[1:-1])
    end = np.flatnonzero(opens) + 1
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    return Tokens(data, start, end, doc, span_hashes(data, start, end), len(offsets) - 1)


def windows(tokens: Tokens, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first token) of each run of `width` tokens inside one text."""
    n = len(tokens.hash) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.full(n, seed * 2 + width, dtype=np.uint64)
    for j in range(width):
        total *= U64(0xD6E8FEB86659FD93)
        total += tokens.hash[j : j + n]
    first = np.flatnonzero(tokens.doc[:n] == tokens.doc[width - 1 :])
    return mix(total[first]), first


def shingles(tokens: Tokens, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of all word shingles; a text of fewer words, but not none, has one of all its words."""
    hashes, first = windows(tokens, width)
    docs = tokens.doc[first]
    count = tokens.per_doc()
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        begin = np.searchsorted(tokens.doc, short)
        total = count[short].astype(np.uint64)
        for j in range(width - 1):
            live = count[short] > j
            step = tokens.hash[np.minimum(begin + j, len(tokens.hash) - 1)]
            total = np.where(live, total * U64(0xD6E8FEB86659FD93) + step, total)
        docs = np.concatenate([docs, short])
        hashes = np.concatenate([hashes, mix(total)])
        order = np.argsort(docs, kind="stable")
        docs, hashes = docs[order], hashes[order]
    return hashes, docs


def take_text(tokens: Tokens, first: int, width: int) -> bytes:
    """The words of a window, one space between two."""
    return b" ".join(tokens.data[tokens.start[i] : tokens.end[i]].tobytes() for i in range(first, first + width))


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values."""
    if not len(sorted_values):
        return np.empty(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1])
