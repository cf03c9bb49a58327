"""Word and shingle hashes of whole texts, vectorised over an Arrow batch.

Words are the maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lowered, so a
word is the same run of code points the contracts name. A word's hash is a polynomial of
random byte values modulo 2**64, finished by a mixing step; a document is never cut.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Regular expression of a word, for JVM and DuckDB expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text hashed together: bounds the temporaries; one longer document is hashed alone.
CHUNK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.default_rng(20).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_power = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        _power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 256) - 1, _BASE)]))
    return _power


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser with good avalanche: distinct inputs stay distinct."""
    x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) over pieces of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        to = min(to, n)
        yield at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def give_back() -> None:
    """Return memory that a finished task freed: idle Python workers count against their executor."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """A ``mapInArrow`` function that gives memory back when its task ends."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


class Words:
    """Words of a piece of text: byte spans, per-document offsets and hashes.

    ``breaks``: further bytes at which a word begins. ``lower``: whether A-Z count as a-z.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None, lower: bool = True):
        space = _SPACE[raw]
        before = np.empty(len(raw), dtype=bool)
        if len(raw):
            before[0] = True
            before[1:] = space[:-1]
            before[offsets[:-1][offsets[:-1] < len(raw)]] = True
            if breaks is not None:
                before |= breaks
        inner = np.flatnonzero(~space)
        self.first = np.flatnonzero(before[inner])  # positions among the non-space bytes
        self.begin = inner[self.first]
        self.length = np.diff(np.append(self.first, len(inner)))
        self.of_doc = np.searchsorted(self.begin, offsets)  # word offsets per document
        self._bytes = (_LOWER[raw] if lower else raw)[inner]
        self._place = np.arange(len(inner), dtype=np.int64) - np.repeat(self.first, self.length)
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.begin)

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its first ``prefix`` bytes."""
        if not len(self):
            return np.zeros(0, np.uint64)
        if self._sums is None:  # running sums of the terms serve every prefix
            terms = _VALUE[self._bytes] * powers(int(self.length.max()))[self._place]
            self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        size = self.length if prefix is None else np.minimum(self.length, prefix)
        total = self._sums[self.first + size] - self._sums[self.first]
        return mix(total + size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + h[j : n + j])
    return out


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Per document the sorted distinct ``k``-word shingles; a shorter text is one shingle."""
    h = words.hashes()
    joined = windows(h, k)
    for a, b in zip(words.of_doc[:-1], words.of_doc[1:]):
        if b - a >= k:
            yield np.unique(joined[a : b - k + 1])
        else:
            yield windows(h[a:b], int(b - a))[:1] if b > a else np.zeros(0, np.uint64)
