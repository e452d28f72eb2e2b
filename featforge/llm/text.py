"""Words, lines and n-gram hashes of a batch of texts, computed with numpy over the UTF-8 bytes of an Arrow column.

A batch is cut into runs of whole texts of about ``CHUNK`` bytes, so memory follows the chunk or the longest text, not
the batch. Hashes are 64 bits wide: a polynomial over the bytes of a word, mixed, then a polynomial over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = 0xD6E8FEB86659FD93
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _table(separators, lower: bool) -> np.ndarray:
    """Byte -> its value + 1 inside words, 0 for a separator."""
    table = np.arange(1, 257, dtype=np.uint16)
    if lower:
        table[65:91] += 32
    table[list(separators)] = 0
    return table


#: Words are runs of anything but ASCII white space: [^\x20\x09-\x0D]+
SPACED = _table([0x20, *range(0x09, 0x0E)], lower=False)
#: The same with A-Z in lower case.
SPACED_LOWER = _table([0x20, *range(0x09, 0x0E)], lower=True)
#: Words are runs of digits, letters and everything beyond ASCII, A-Z in lower case.
PLAIN_LOWER = _table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], lower=True)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit value."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, CHUNK), _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:n]


class Texts:
    """Bytes of some whole texts and where their words lie.

    ``doc`` is the text of each word, ``start`` and ``end`` its byte range in ``data``, ``edges`` the byte range of each
    text; ``first`` is the row of the first text in the batch.
    """

    def __init__(self, data: np.ndarray, edges: np.ndarray, table: np.ndarray, first: int = 0):
        self.data, self.edges, self.first, self.n = data, edges, first, len(edges) - 1
        self._codes = table[data]
        inside = self._codes != 0
        breaks = np.zeros(len(data) + 1, bool)
        breaks[edges] = True
        before = np.concatenate(([False], inside[:-1])) if len(data) else inside
        after = np.concatenate((inside[1:], [False])) if len(data) else inside
        self.start = np.flatnonzero(inside & (~before | breaks[:-1]))
        self.end = np.flatnonzero(inside & (~after | breaks[1:])) + 1
        self.doc = np.searchsorted(edges, self.start, "right") - 1
        #: Index of the first word of each text, and the number of words at the end.
        self.bounds = np.searchsorted(self.doc, np.arange(self.n + 1))

    def hashes(self, start: np.ndarray, end: np.ndarray, whole: bool = False) -> np.ndarray:
        """Hash of each byte range; ``whole`` takes the bytes as they are, separators included."""
        return self._sums(self.data.astype(np.uint64) + np.uint64(1) if whole else self._codes.astype(np.uint64), start, end)

    def _sums(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * _power("up", len(codes)), out=total[1:])
        length = (end - start).astype(np.uint64)
        return mix((total[end] - total[start]) * _power("down", len(codes) + 1)[start] + length * np.uint64(_STEP))

    def lower_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The same with A-Z in lower case, whatever the words are."""
        return self._sums(SPACED_LOWER[self.data].astype(np.uint64), start, end)

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.start, self.end)

    def points(self) -> np.ndarray:
        """Code points before each byte."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out

    def per_text(self, before: np.ndarray) -> np.ndarray:
        """Sums per text from running totals over bytes."""
        return np.diff(before[self.edges])


def ngrams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``n`` words inside one text, and the index of the first word of each."""
    if len(hashes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    last = len(hashes) - n + 1
    total, factor = np.zeros(last, np.uint64), 1
    for k in range(n):
        total += hashes[k:k + last] * np.uint64(factor)
        factor = factor * _STEP % (1 << 64)
    at = np.flatnonzero(doc[:last] == doc[n - 1:])
    return mix(total[at] + np.uint64(n)), at


def in_text(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts, to count inside each text with one sort."""
    return hashes ^ mix(doc.astype(np.uint64) + np.uint64(_STEP))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back to the system: workers outlive a stage, and what they hold would add to that of the next."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def chunks(column: pa.Array, table: np.ndarray, limit: int = CHUNK) -> Iterator[Texts]:
    """The texts of an Arrow string column in runs of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    edges = np.frombuffer(buffers[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64) \
        if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + limit, "right")) - 1)
        yield Texts(data[edges[first]:edges[last]], edges[first:last + 1] - edges[first], table, first)
        first = last
    release()
