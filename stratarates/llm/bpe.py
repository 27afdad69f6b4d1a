"""Byte-level BPE encoding and decoding as a reduction over a tree of halves.

A piece of text is halved until its parts are short, the parts are encoded by merging
lowest ranks, and neighbours are joined.  A joined sequence is right exactly if every two
adjacent tokens are what the bytes of the two encode to.  Each side holds already, so a
join looks at the seam only: if the seam's pair holds, the tokens are concatenated,
otherwise a window around it is encoded anew and widened until its outer pairs hold too.
Then no token outside the window can change.  The first window is the seam's pair itself, and
what two tokens encode to is remembered, so most joins merge no bytes.  Decoding concatenates
up the same tree.

Nulls count as empty, empty texts give no ids, and texts of any length are encoded whole:
joins touch seams only, so a piece without any break costs O(n log n).  Every input row
gives one output row, repeated rows and null keys included; other columns pass through,
those that bear an output's name are replaced.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stratarates.llm.words import trim

LEAF_BYTES = 6
#: pieces remembered by each Python worker, twice; longer pieces are never kept.  Two workers with
#: what they remember must fit beside an executor's heap that earlier stages have filled
CACHE_PIECES, CACHE_CHARS, CACHE_PARTS = 100_000, 48, 1 << 16
_NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(1)
def _bmp_classes() -> dict[str, str]:
    """Ranges of the Basic Multilingual Plane that are letters, numbers and white space."""
    out = {"L": [], "N": [], "Z": []}
    white = {0x20, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
             *range(0x09, 0x0E), *range(0x2000, 0x200B)}
    for code in range(0x10000):
        kind = "Z" if code in white else unicodedata.category(chr(code))[0]
        if kind in out:
            ranges = out[kind]
            if ranges and ranges[-1][1] == code - 1 and (code in white) == (kind == "Z"):
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    out["Z"] = [r for r in out["Z"] if r[0] in white]
    return {k: "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in v) for k, v in out.items()}


def _plain_classes(pattern: str) -> str:
    """``pattern`` for the standard library's matcher, which is faster but lacks ``\\p``."""
    c = _bmp_classes()
    for name, ranges in ((r"\p{L}", c["L"]), (r"\p{N}", c["N"]), (r"\s", c["Z"])):
        pattern = re.sub(r"(\[[^\]]*)" + re.escape(name),
                         lambda m, r=ranges: m[1] + r, pattern)
        pattern = pattern.replace(name, f"[{ranges}]")
    return pattern.replace(r"\S", f"[^{c['Z']}]")


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.size = size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte = [ranks[bytes([b])] for b in range(256)]
        #: rank of the token that two tokens make, by the two
        self.pairs = {
            ranks[token[:i]] * size + ranks[token[i:]]: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        # Python's \s has four control characters more than Unicode's White_Space
        wide = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.all_pieces = regex.compile(wide).findall
        self.bmp_pieces = re.compile(_plain_classes(pattern)).findall
        self.seam = lru_cache(1 << 16)(self._seam)
        self.short = lru_cache(CACHE_PARTS)(self._merge)  # halves recur far more than words
        self.known = _Pieces(self)

    def _merge(self, piece: bytes) -> list[int]:
        """Merge the lowest-ranked pair, the leftmost first, until none is left."""
        pair, size = self.pairs.get, self.size
        ids = [self.byte[b] for b in piece]
        ranks = [pair(a * size + b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            at = ranks.index(best)
            ids[at:at + 2] = [best]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = pair(best * size + ids[at + 1], _NONE)
            if at:
                ranks[at - 1] = pair(ids[at - 1] * size + best, _NONE)
        return ids

    def _seam(self, left: int, right: int) -> tuple[int, ...] | None:
        """What the bytes of two tokens encode to, None if to just these."""
        ids = self._merge(self.tokens[left] + self.tokens[right])
        return None if ids == [left, right] else tuple(ids)

    def _join(self, a: list[int], b: list[int]) -> list[int]:
        if not a or not b:
            return a + b
        seam = self.seam
        middle = seam(a[-1], b[0])
        if middle is None:
            return a + b
        reach = 1
        while True:
            left, right = max(0, len(a) - reach), min(len(b), reach)
            if (left == 0 or seam(a[left - 1], middle[0]) is None) and (
                right == len(b) or seam(middle[-1], b[right]) is None
            ):
                return [*a[:left], *middle, *b[right:]]
            reach *= 2
            left, right = max(0, len(a) - reach), min(len(b), reach)
            window = b"".join([self.tokens[t] for t in a[left:] + b[:right]])
            middle = self._merge(window) if len(window) <= 32 else self._merge_wide(window)

    def _merge_wide(self, piece: bytes) -> list[int]:
        """The same merges from a heap, for windows that had to grow far."""
        n, pair, size = len(piece), self.pairs.get, self.size
        ids = [self.byte[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = pair(ids[i] * size + ids[i + 1])
            if rank is not None:
                heap.append((rank, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (up := pair(rank * size + ids[k])) is not None:
                    heapq.heappush(heap, (up, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (up := pair(ids[h] * size + rank)) is not None:
                heapq.heappush(heap, (up, h, ids[h], rank))
        return [t for t in ids if t >= 0]

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF_BYTES:
            return self.short(piece)
        half = len(piece) // 2
        return self._join(self.tree(piece[:half]), self.tree(piece[half:]))

    def piece_ids(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        return self.tree(raw) if whole is None else [whole]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        # a character beyond the BMP takes two units of UTF-16
        bmp = text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
        find = self.bmp_pieces if bmp else self.all_pieces
        return b"".join(map(self.known.__getitem__, find(text)))

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        return self._concatenate(ids, 0, len(ids))

    def _concatenate(self, ids: np.ndarray, start: int, stop: int) -> bytes:
        if stop - start <= 4096:
            return b"".join(map(self.tokens.__getitem__, ids[start:stop].tolist()))
        half = (start + stop) // 2
        return self._concatenate(ids, start, half) + self._concatenate(ids, half, stop)


class _Pieces(dict):
    """Packed ids by piece; when full, it becomes the older of two generations."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = self.codec.piece_ids(piece)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


_codecs: dict[object, Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    key = (shared.id if hasattr(shared, "id") else id(shared), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value, pattern)
    return _codecs[key]


def _map(df: DataFrame, source: str, outputs: list[tuple[str, T.DataType]],
         make: Callable[[], Callable]) -> DataFrame:
    """Append columns computed row by row from ``source``, batch by batch."""
    kept = [f for f in df.schema.fields if f.name not in {name for name, _ in outputs}]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in outputs)])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = each(part.column(source))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made],
                                                 names=[*names, *(n for n, _ in outputs)])
            trim()

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """Append ``ids`` (binary, little-endian unsigned 32-bit integers) and ``n_tokens``.

    The vocabulary (some 50,000 short byte strings, whatever the corpus) is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def make():
        codec = _codec(shared, pattern)

        def each(column: pa.Array) -> list[pa.Array]:
            packed = [codec.encode(t or "") for t in column.to_pylist()]
            return [pa.array(packed, pa.binary()),
                    pa.array([len(p) // 4 for p in packed], pa.int64())]

        return each

    return _map(df, text, [("ids", T.BinaryType()), ("n_tokens", T.LongType())], make)


def decode(df: DataFrame, ranks: dict[bytes, int], pattern: str, ids: str = "ids") -> DataFrame:
    """Append ``decoded``: the bytes that the packed ids stand for."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def make():
        codec = _codec(shared, pattern)

        def each(column: pa.Array) -> list[pa.Array]:
            return [pa.array([codec.decode(p or b"") for p in column.to_pylist()], pa.binary())]

        return each

    return _map(df, ids, [("decoded", T.BinaryType())], make)


def round_trip(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass of the same workers: appends ``ids``, ``n_tokens``
    and ``decoded``."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def make():
        codec = _codec(shared, pattern)

        def each(column: pa.Array) -> list[pa.Array]:
            packed = [codec.encode(t or "") for t in column.to_pylist()]
            return [pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([codec.decode(p) for p in packed], pa.binary())]

        return each

    return _map(df, text, [("ids", T.BinaryType()), ("n_tokens", T.LongType()), ("decoded", T.BinaryType())], make)


def unpack(packed: bytes) -> list[int]:
    out = array("I")
    out.frombytes(packed)
    return out.tolist()
