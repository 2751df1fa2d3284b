"""Texts as flat numpy arrays: the vectorised kernels that the Arrow-batch operators share.

A batch of texts becomes one array of code points plus one array of document offsets. Words, lines and n-grams
are then index ranges in it, and a range is named by a 64-bit hash; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Code points that one chunk holds, unless a single text is longer.
CHUNK = 1 << 19


class Texts:
    """Some texts: ``cp`` has their code points end to end, text i is ``cp[at[i]:at[i + 1]]``. Null is empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string())
        filled = pc.fill_null(column, "")
        lengths = pc.utf8_length(filled).to_numpy(zero_copy_only=False)
        self.at = np.zeros(len(filled) + 1, np.int64)
        np.cumsum(lengths, out=self.at[1:])
        offsets = np.frombuffer(filled.buffers()[1], np.int64, len(filled) + 1, filled.offset * 8)
        data = filled.buffers()[2]
        raw = memoryview(data)[offsets[0] : offsets[-1]] if data is not None and len(filled) else b""
        self.cp = np.frombuffer(str(raw, "utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)

    def __len__(self) -> int:
        return len(self.at) - 1

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        """Which text each ascending position lies in."""
        return np.searchsorted(self.at, positions, side="right") - 1


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cuts a batch by rows into pieces of about ``most`` bytes of text, so that memory stays bounded."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.maximum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), 1)
    piece = np.cumsum(sizes) // most if len(sizes) else sizes
    cuts = np.flatnonzero(np.diff(piece)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True):
        if hi > lo:
            part = batch.slice(lo, hi - lo)
            yield part, Texts(part.column(part.schema.get_field_index(text)))
    release()


def release() -> None:
    """Gives memory that is no longer used back to the system: a worker outlives its tasks, and the next operator needs the room."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_libc(), "malloc_trim", None):
        trim(0)


@lru_cache(maxsize=1)
def _libc() -> object:
    import ctypes
    import ctypes.util

    name = ctypes.util.find_library("c")
    return ctypes.CDLL(name) if name else None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xA0761D6478BD642F)
    x ^= x >> U64(32)
    return x


#: Symbols that one step of the tree of ``range_hashes`` takes together.
FAN = 8


def range_hashes(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each ``symbols[start:end]``; the same content hashes alike anywhere. Other seeds give independent hashes.

    Every ``FAN`` symbols are chained by a multiplication and a shift each, and the results are hashed in the same way until one is left, so no algebra ties the hashes of different contents together.
    """
    length = (end - start).astype(np.int64)
    h = _tree(symbols, start.astype(np.int64), length, U64((0x51ED270B9F1F3E35 + seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    return mix(h ^ (length.astype(U64) * U64(0x9FB21C651E98DF25)))


def _tree(symbols: np.ndarray, start: np.ndarray, length: np.ndarray, seed: np.uint64) -> np.ndarray:
    n_blocks = np.maximum(-(-length // FAN), 1)
    long = n_blocks > 1
    if long.any():
        first = np.zeros(len(length) + 1, np.int64)
        np.cumsum(n_blocks, out=first[1:])
        inside = np.arange(first[-1]) - np.repeat(first[:-1], n_blocks)
        at = np.repeat(start, n_blocks) + FAN * inside
        left = np.minimum(np.repeat(length, n_blocks) - FAN * inside, FAN)
    else:
        at, left = start, length
    h = np.full(len(at), seed, U64)
    last = max(len(symbols) - 1, 0)
    for k in range(int(left.max(initial=0))):
        value = symbols[np.minimum(at + k, last)].astype(U64)
        value[left <= k] = 0xFFFFFFFF
        h = (h ^ value) * U64(0xD6E8FEB86659FD93)
        h ^= h >> U64(32)
    # The same number of steps for every block, wherever it stands.
    for _ in range(FAN - int(left.max(initial=0))):
        h = (h ^ U64(0xFFFFFFFF)) * U64(0xD6E8FEB86659FD93)
        h ^= h >> U64(32)
    if not long.any():
        return h
    out = h[first[:-1]]
    out[long] = _tree(h, first[:-1][long], n_blocks[long], seed ^ U64(0xA0761D6478BD642F))
    return out


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true positions; no run crosses a text's bounds."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = at[(at > 0) & (at < n)]
    begins[cut] = inside[cut]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cut - 1] = inside[cut - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def counts_by_doc(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)


def sums_by_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values[at[i]:at[i + 1]] for every i."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


@lru_cache(maxsize=1)
def ascii_word_table() -> np.ndarray:
    """Code points below 256 that belong to words: digits, letters and all from 0x80 on."""
    table = np.zeros(0x100, bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = True
    table[0x80:] = True
    return table


def plain_words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of ASCII letters, digits and anything beyond ASCII, with A-Z lower-cased: hashes, and each text's first word's index (one more at the end), and word starts."""
    cp = texts.cp
    upper = (cp >= 0x41) & (cp <= 0x5A)
    lowered = cp + (upper.astype(np.uint32) << 5)
    start, end = runs(ascii_word_table()[np.minimum(cp, 0xFF)], texts.at)
    return range_hashes(lowered, start, end), np.searchsorted(start, texts.at), start


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``size`` words and the text of each; a text of fewer words, but not none, has one shingle of all of them."""
    n_words = np.diff(first)
    n = np.maximum(n_words - size + 1, np.minimum(n_words, 1))
    begin = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=begin[1:])
    doc = np.repeat(np.arange(len(n)), n)
    at = first[:-1][doc] + np.arange(begin[-1]) - begin[:-1][doc]
    h = np.zeros(len(at), U64)
    stop = first[1:][doc]
    for k in range(size):
        inside = at + k < stop
        w = words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else np.zeros(len(at), U64)
        h = np.where(inside, (h ^ w) * U64(0x9FB21C651E98DF25) + U64(k + 1), h)
        h ^= h >> U64(31)
    return mix(h), doc


def distinct_pairs(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (doc, value) pairs, sorted by both; doc must be ascending."""
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return v[keep], d[keep]
