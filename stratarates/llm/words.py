"""Words and word windows of many texts at once, as numpy arrays.

Texts stay in their Arrow buffer.  A chunk of texts is cut into words by looking up
each byte's class, and words and windows are hashed by differences of polynomial
prefix sums modulo 2**64, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_SEGMENT = 1 << 18
_U = np.uint64


def _class(members) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: bytes of ``[^\x20\x09-\x0D]``
NOT_SPACE = ~_class([0x20, *range(0x09, 0x0E)])
#: bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``: digits, a-z and all of non-ASCII
ALNUM = _class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

# Bases of the two polynomials: odd, hence invertible modulo 2**64.
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1B54A32D192ED03
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` for i < n, kept per process and grown on demand."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(1024, 1 << int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, _U)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            out.append(p)
        _powers[base] = known = (out[0], out[1])
    return known[0][:n], known[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = CHUNK_BYTES, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds ``rows`` texts of ``limit`` bytes, or one longer text.
    At the end the worker gives back what it kept for them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.frombuffer(_binary(batch.column(text))[0], np.int64)
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(size, size[at] + limit, side="right")) - 1
            stop = min(max(stop, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop
        trim()
    give_back()


def give_back() -> None:
    """Free what a worker keeps between tasks, and let the allocators return unused pages: an
    idle worker stays alive for a while beside those of the next stage."""
    _powers.clear()
    trim()


def trim() -> None:
    """Let the allocators return unused pages."""
    pa.default_memory_pool().release_unused()
    of_libc = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if of_libc is not None:
        of_libc(0)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column, nulls as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return np.ascontiguousarray(offsets), data


class Words:
    """The words of a chunk of texts.

    ``start``/``end``: byte places in ``data``; ``first[d]:first[d + 1]`` are the words
    of text d; ``doc`` is the text of each word.
    """

    def __init__(self, column: pa.Array, kind: np.ndarray = NOT_SPACE, lower: bool = False):
        offsets, data = _binary(column)
        base = int(offsets[0])
        self.offsets = offsets - base
        self.data = data[base:int(offsets[-1])]
        if lower:
            self.data = _LOWER[self.data]
        n = len(self.data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = kind[self.data]
        edge = np.zeros(n + 1, bool)  # a text begins here
        edge[self.offsets] = True
        here, before = inside[1:], inside[:-1]
        self.start = np.flatnonzero(here & (~before | edge))
        self.end = np.flatnonzero(before & (~here | edge))
        self.first = np.searchsorted(self.start, self.offsets)
        # empty texts at the end of the data have no words
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if self._hash is None:
            self._hash = self.slice_hash(self.start, self.end)
        return self._hash

    def slice_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges in ascending order of ``start``, a quarter megabyte at a time."""
        out = np.empty(len(start), _U)
        at = 0
        while at < len(start):
            origin = int(start[at])
            stop = int(np.searchsorted(start, origin + _SEGMENT))
            stop = max(stop, at + 1)
            s, e = start[at:stop] - origin, end[at:stop] - origin
            n = int(e.max())
            power, inverse = _powers_of(_BYTE_BASE, n + 1)
            sums = np.zeros(n + 1, _U)
            np.cumsum(_BYTE_VALUE[self.data[origin:origin + n]] * power[:n], out=sums[1:])
            out[at:stop] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(_U))
            at = stop
        return out

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(start word, hash) of every run of ``width`` words within one text."""
        n = len(self)
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        h = self.window_hash(width)
        at = np.flatnonzero(self.doc[:n - width + 1] == self.doc[width - 1:])
        return at, h[at]

    def window_hash(self, width: int) -> np.ndarray:
        n = len(self)
        power, inverse = _powers_of(_WORD_BASE, n + 1)
        sums = np.zeros(n + 1, _U)
        np.cumsum(self.hash * power[:n], out=sums[1:])
        return mix((sums[width:] - sums[:-width]) * inverse[:n - width + 1] + _U(width))

    def whole_hash(self, docs: np.ndarray) -> np.ndarray:
        """A hash of all words of each of ``docs``, equal to that of an equally wide window."""
        n = len(self)
        power, inverse = _powers_of(_WORD_BASE, n + 1)
        sums = np.zeros(n + 1, _U)
        np.cumsum(self.hash * power[:n], out=sums[1:])
        s, e = self.first[docs], self.first[docs + 1]
        return mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(_U))

    def code_points(self) -> np.ndarray:
        """Code points before each byte place."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return h.view(np.int64)


def cover_runs(mark: np.ndarray, width: int) -> np.ndarray:
    """Places within ``width`` of a mark at or before them: what marked windows cover."""
    n = len(mark)
    step = np.zeros(n + width + 1, np.int32)
    at = np.flatnonzero(mark)
    step[:n] += mark
    np.subtract.at(step, at + width, 1)
    return np.cumsum(step)[:n] > 0
