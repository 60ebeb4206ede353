"""Vectorised helpers over UTF-8 text held in Arrow string arrays.

Tasks see texts as one byte buffer plus offsets, so tokenising and hashing need no
per-word Python. A null text counts as empty everywhere in this module.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))

#: [^\x20\x09-\x0D]+ on bytes: everything but ASCII white space.
WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[9, 10, 11, 12, 13, 32]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: digits, a-z, all non-ASCII.
ALNUM_BYTES = np.zeros(256, bool)
ALNUM_BYTES[0x30:0x3A] = True
ALNUM_BYTES[0x61:0x7B] = True
ALNUM_BYTES[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and len+1 offsets; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents, each of about ``most`` bytes (a longer text stands alone)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place on a fresh array."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


#: Bytes that one polynomial spans. Longer buffers are hashed in blocks, so the tables of powers have a fixed size.
_SPAN = 1 << 16


def _powers(base: np.uint64) -> np.ndarray:
    out = np.full(_SPAN, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(BASE), _powers(BASE_INVERSE)
_BLOCK_UP, _BLOCK_DOWN = (np.uint64(pow(int(b), _SPAN, 2**64)) for b in (BASE, BASE_INVERSE))


def _power(table: np.ndarray, step: np.uint64, at: np.ndarray, blocks: int) -> np.ndarray:
    """base ** at for positions below blocks * _SPAN."""
    if blocks <= 1:
        return table.take(at)
    whole = np.full(blocks, step, np.uint64)
    whole[0] = 1
    whole = np.multiply.accumulate(whole)
    return table.take(at & (_SPAN - 1)) * whole.take(at >> 16)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """len+1 polynomial prefix sums modulo 2**64, for ``range_hashes``."""
    terms = BYTE_CODES[data]
    for k, a in enumerate(range(0, len(data), _SPAN)):
        part = terms[a : a + _SPAN]
        part *= _UP[: len(part)]
        if k:
            part *= np.uint64(pow(int(_BLOCK_UP), k, 2**64))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(terms, out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range [start, end): equal for equal bytes, wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * _power(_DOWN, _BLOCK_DOWN, starts, len(prefix) // _SPAN + 1) + (ends - starts).astype(np.uint64))


class Table:
    """A fixed map from int64 keys to int64 values, looked up for whole arrays. Keys are sorted by a mixed form."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        mixed = self._mixed(keys)
        order = np.argsort(mixed)
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        self.keys = np.append(mixed[order], np.uint64(2**64 - 1))
        self.values = np.append(values[order], missing)
        self.missing = missing
        self.first = np.searchsorted(self.keys[:-1] >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))
        self.most = int(np.diff(self.first).max(initial=0))

    @staticmethod
    def _mixed(keys: np.ndarray) -> np.ndarray:
        h = np.ascontiguousarray(keys).view(np.uint64) * BASE  # odd factors and shifts: one to one
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h

    def get(self, keys: np.ndarray) -> np.ndarray:
        mixed = self._mixed(keys)
        at = self.first.take((mixed >> np.uint64(64 - self.bits)).view(np.int64))
        todo = np.flatnonzero(self.keys.take(at) < mixed)
        for _ in range(self.most):
            if not len(todo):
                break
            at[todo] += 1
            todo = todo[self.keys.take(at[todo]) < mixed[todo]]
        out = self.values.take(at)
        out[self.keys.take(at) != mixed] = self.missing
        return out


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and len(docs)+1 offsets of the documents into them."""
    is_word = table[data]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    edge = offsets[1:-1]
    inner = edge[(edge > 0) & (edge < len(data))]
    first[inner] = is_word[inner]
    last[inner - 1] = is_word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def owners(bounds: np.ndarray) -> np.ndarray:
    """For offsets of groups, the group of each element."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
