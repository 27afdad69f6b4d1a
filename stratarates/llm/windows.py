"""Removal of repeated passages by difference-cover anchors.

Word places modulo ``PERIOD`` = 13 that lie in the cover {0, 1, 3, 9} carry an anchor: the
hash of the 8 words from there.  The cover's differences give every residue, so for any two
occurrences of the same 20 words there is an offset below 13 at which both have an anchor,
and both anchors hash the same 8 words.  Hence only 4 of 13 places are hashed and dealt
out, and only windows around anchors that occur twice are extended to all 20 words.  An
extended window's first occurrence is the smallest (document, place); every later one is
removed.  Results are exact up to the equality of 64-bit hashes of anchors and of 96 bits
of extended windows.

Work grows with the words, never with pairs.  Each task asks once per chunk and anchor (or
window) value: further occurrences within the chunk are already known to be repeated.  So a
passage that stands in a third of all documents is asked for once per 8 MB of text.  Values
are grouped by hash into as many groups as keep each to ``GROUP_BYTES`` of text.  Texts
travel to their marks compressed, in one shuffle that both uses share.

Words are ``[^\\x20\\x09-\\x0D]+``.  Null, empty and short texts (under 20 words) have no
window and stay as they are.  A null key counts as the largest.  Rows that share a key are
one document for the order of occurrences: of equal rows neither is earlier, so both stay.
Texts of any length are handled; empty tables give no rows.  Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarates.llm.near import NO_KEY, keyed
from stratarates.llm.words import Words, chunks, cover_runs, mix

WIDTH, PERIOD, COVER, ANCHOR = 20, 13, (0, 1, 3, 9), 8
assert ANCHOR + PERIOD - 1 == WIDTH
assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))

_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: anchors and windows are matched within chunks of so many bytes before they are dealt out
COMBINE_BYTES = 8 << 20
#: text whose anchors, or windows, one task compares
GROUP_BYTES = 32 << 20


# Values are dealt out by hash.  A task sends one row per chunk of texts and group of values,
# which holds the chunk's values of that group as columns: eight or twelve bytes of hash and
# about two of place and text.  Texts are numbered within their chunk; a row of the chunk's
# own group keeps what the numbers stand for, and what the chunk knows without asking.
_DEALT = "group long, chunk long, n int, values binary, owners binary"
_squeeze, _expand = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _columns(*arrays: np.ndarray) -> bytes:
    return _squeeze.compress(b"".join(np.diff(a, prepend=np.int64(0)).astype(np.int64).tobytes() for a in arrays))


def _split(raw: bytes, n: int) -> list[np.ndarray]:
    return list(np.cumsum(np.frombuffer(_expand.decompress(raw), np.int64).reshape(-1, n), axis=1)) if n else []


def _rows(group, chunk, n, values, owners) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(group, pa.int64()), pa.array(chunk, pa.int64()), pa.array(n, pa.int32()),
         pa.array(values, pa.binary()), pa.array(owners, pa.binary())],
        names=["group", "chunk", "n", "values", "owners"])


def _deal(chunk: pa.RecordBatch, number: int, groups: int, doc: np.ndarray, place: np.ndarray,
          a: np.ndarray, b: np.ndarray | None, ask: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    """Rows of the values to be asked for, and the chunk's own row."""
    keys, tags = chunk.column("doc_id").to_numpy(), chunk.column("tag").to_numpy()
    me = TaskContext.get().partitionId() << 32 | number
    at = np.flatnonzero(ask)
    group = (a[at] % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    at, group = at[order], group[order]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(at) else np.zeros(0, int)
    values, owners, sizes = [], [], []
    for i, j in zip(first.tolist(), np.append(first[1:], len(at)).tolist()):
        part = at[i:j]
        sizes.append(j - i)
        values.append(a[part].tobytes() + (b"" if b is None else b[part].tobytes()))
        owners.append(_columns(doc[part], place[part], keys[doc[part]]))
    sure = np.flatnonzero(known)
    own = _columns(keys, tags), _columns(doc[sure], place[sure])
    return _rows([*group[first], -1 - me], [me] * (len(first) + 1), [*sizes, len(keys)], [*values, own[0]],
                 [*owners, len(sure).to_bytes(4, "little") + own[1]])


def _answers(dealt: DataFrame, wide: bool) -> DataFrame:
    """Per group and chunk, the (text, place) that are repeated: of ``wide`` values those
    that occur earlier too, of others all that occur more than once."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("group")[0].as_py() < 0:
            return table
        sizes, hashes, more, doc, place, keys = [], [], [], [], [], []
        for n, v, o in zip(table.column("n").to_pylist(), table.column("values"), table.column("owners")):
            v = v.as_py()
            sizes.append(n)
            hashes.append(np.frombuffer(v, np.uint64, n))
            if wide:
                more.append(np.frombuffer(v, np.uint32, n, 8 * n))
            for to, column in zip((doc, place, keys), _split(o.as_py(), n)):
                to.append(column)
        h, doc, place, keys = map(np.concatenate, (hashes, doc, place, keys))
        if wide:
            b = np.concatenate(more)
            order = np.lexsort((place, keys, b, h))
            new = np.r_[True, (h[order][1:] != h[order][:-1]) | (b[order][1:] != b[order][:-1])]
            first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            hit = np.empty(len(h), bool)
            hit[order] = (keys[order] > keys[first]) | (place[order] > place[first])
        else:
            order = np.argsort(h)
            same = h[order][1:] == h[order][:-1]
            hit = np.zeros(len(h), bool)
            hit[order[1:]] |= same
            hit[order[:-1]] |= same
        out, at = [], 0
        for c, n in zip(table.column("chunk").to_pylist(), sizes):
            some = np.flatnonzero(hit[at:at + n]) + at
            if len(some):
                out.append((c, len(some), _columns(doc[some], place[some])))
            at += n
        return pa.Table.from_batches([_rows([0] * len(out), [c for c, _, _ in out], [n for _, n, _ in out],
                                            [None] * len(out), [o for _, _, o in out])])

    return dealt.groupBy("group").applyInArrow(run, _DEALT)


def _by_text(answers: DataFrame) -> DataFrame:
    """(doc_id, tag, places) of the texts that have any.  Equal rows have equal places."""
    schema = "doc_id long not null, tag long not null, places array<int>"

    def run(table: pa.Table) -> pa.Table:
        doc, place, keys, tags = [], [], None, None
        for g, n, v, o in zip(*(table.column(c).to_pylist() for c in ("group", "n", "values", "owners"))):
            if g < 0:
                keys, tags = _split(v, n)
                n, o = int.from_bytes(o[:4], "little"), o[4:]
            if n:
                d, p = _split(o, n)
                doc.append(d)
                place.append(p)
        doc, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (doc, place))
        order = np.lexsort((place, doc))
        texts, first = np.unique(doc[order], return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)),
                                         pa.array(place[order].astype(np.int32)))
        return pa.table({"doc_id": pa.array(keys[texts]), "tag": pa.array(tags[texts]), "places": lists})

    found = answers.groupBy("chunk").applyInArrow(run, schema.replace(" not null", ""))
    return found.groupBy("doc_id", "tag").agg(F.first("places").alias("places"))


def anchors(docs: DataFrame, groups: int) -> DataFrame:
    """The anchors of every text that has a window.  Of those of a chunk that hash alike, the
    first is asked for, and all are known to be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in enumerate(chunks(batches, limit=COMBINE_BYTES)):
            w = Words(chunk.column("text"))
            at, h = w.windows(ANCHOR)
            pick = _IN_COVER[(at - w.first[w.doc[at]]) % PERIOD] & (w.count[w.doc[at]] >= WIDTH)
            at, h = at[pick], h[pick]
            if not len(at):
                continue
            order = np.argsort(h, kind="stable")
            new = np.r_[True, h[order][1:] != h[order][:-1]]
            size = np.diff(np.append(np.flatnonzero(new), len(h)))
            first, known = np.zeros(len(h), bool), np.zeros(len(h), bool)
            first[order] = new
            known[order] = np.repeat(size > 1, size)
            doc = w.doc[at]
            yield _deal(chunk, number, groups, doc, at - w.first[doc], h, None, first, known)

    return docs.mapInArrow(run, _DEALT)


def _pack(docs: DataFrame) -> DataFrame:
    """Texts compressed, as they are to be shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for chunk in chunks(batches):
            packed = [squeeze(t) for t in chunk.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), chunk.column("tag"), pa.array(packed, pa.binary())],
                names=["doc_id", "tag", "packed"])

    return docs.mapInArrow(run, "doc_id long not null, tag long not null, packed binary")


def _unpacked(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with their texts, about ``limit`` bytes or one text at a time."""
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        texts, size, at = [], 0, 0
        for i, packed in enumerate(batch.column("packed")):
            texts.append(expand(packed.as_py()))
            size += len(texts[-1])
            if size >= limit or i == batch.num_rows - 1:
                yield batch.slice(at, i + 1 - at), texts
                texts, size, at = [], 0, i + 1


def _marks(lists: pa.Array, w: Words) -> np.ndarray:
    """Whether each word's place is in the list of its text."""
    mark = np.zeros(len(w), bool)
    for d, places in enumerate(lists):
        if places.is_valid:
            mark[w.first[d] + places.values.to_numpy()] = True
    return mark


def extended(packed: DataFrame, groups: int) -> DataFrame:
    """The 20-word windows around shared anchors.  Of those of a chunk that are equal, only
    the earliest are asked for; the others are known to occur earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (chunk, texts) in enumerate(_unpacked(batches, COMBINE_BYTES)):
            w = Words(pa.array(texts, pa.binary()))
            at, a = w.windows(WIDTH)
            shared = np.zeros(len(w) + PERIOD + 1, np.int64)
            np.cumsum(_marks(chunk.column("places"), w), out=shared[1:len(w) + 1])
            shared[len(w) + 1:] = shared[len(w)]
            pick = shared[at + PERIOD] > shared[at]
            at, a = at[pick], a[pick]
            if not len(at):
                continue
            w._hash = mix(w.hash ^ np.uint64(0x5851F42D4C957F2D))
            b = (w.window_hash(WIDTH)[at] >> np.uint64(32)).astype(np.uint32)
            doc = w.doc[at]
            place = at - w.first[doc]
            keys = chunk.column("doc_id").to_numpy()[doc]
            order = np.lexsort((place, keys, b, a))
            new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
            first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            later = np.empty(len(a), bool)
            later[order] = (keys[order] > keys[first]) | (place[order] > place[first])
            yield _deal(chunk, number, groups, doc, place, a, b, ~later, later)

    return packed.mapInArrow(run, _DEALT)


def _groups(rows: DataFrame) -> int:
    """Groups of values: as many as keep one to GROUP_BYTES of text, and all cores busy."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // GROUP_BYTES))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: (doc_id, n_words, n_removed, kept_text), kept words joined by a space."""
    rows = keyed(docs, key, text)
    packed = _pack(rows)
    groups = _groups(rows)
    shared = _by_text(_answers(anchors(rows, groups), wide=False))
    later = _by_text(_answers(extended(packed.join(shared, ["doc_id", "tag"]), groups), wide=True))
    marked = packed.join(later, ["doc_id", "tag"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, texts in _unpacked(batches, 2 << 20):
            n_words, n_removed, kept = [], [], []
            for raw, places in zip(texts, chunk.column("places")):
                words = raw.split()  # of bytes: at ASCII white space only
                n_words.append(len(words))
                if places.is_valid:
                    mark = np.zeros(len(words), bool)
                    mark[places.values.to_numpy()] = True
                    stay = ~cover_runs(mark, WIDTH)
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"])

    out = marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_KEY, F.col("doc_id")))
