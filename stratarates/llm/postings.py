"""Benchmark contamination from a distributed positional inverted index.

The index is partitioned by documents: a block of documents has, for each term of the
test items, one posting list with the places of the term in the block.  Building it takes
one pass over the corpus and shuffles nothing but the lists of test terms.  A search then
intersects, per block, the offset-adjusted lists of a phrase's terms, beginning with the
term that is rarest in the block, and stops as soon as a list is empty.  With ``slop`` > 0
the terms may stand up to so many places from where the phrase has them.

A block holds about ``words.CHUNK_BYTES`` of text (or one longer document), so no list
grows with the corpus: a word that stands in a third of all documents has one list per
block.  The windows of the test items are cut by Spark and staged as distinct (phrase, item)
pairs.  They are sent to the tasks in groups of about ``GROUP_PHRASES`` pairs, dealt by hash; each
group has an index of its terms alone and is searched and written before the next is read,
so what the driver and a task hold has a fixed bound, and a larger benchmark takes more passes.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and non-ASCII
characters.  Null and empty texts have no words and are never hit; an item with fewer
words than the width is one phrase, one without words none.  Items with a null id are
searched for, and their words are hit, but they have no name in ``items``.  Repeated items count
once by id, repeated documents each give a row, and a document without a hit gives a row with
zeros.  An empty benchmark or corpus is fine.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarates.llm import scratch
from stratarates.llm.words import ALNUM, Words, chunks
from stratarates.sources.places import with_file

#: pairs of a phrase and an item held by a task at a time
GROUP_PHRASES = 200_000
_U = np.uint64


class Phrases(NamedTuple):
    """Distinct word sequences of the test items and the items that have each."""

    terms: np.ndarray  # sorted distinct term hashes
    of: np.ndarray  # (phrases, width) places in terms, -1 beyond a short phrase's end
    length: np.ndarray
    items: list[np.ndarray]  # places in ids, per phrase
    ids: list[str]


def pairs(benchmark: DataFrame, width: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (phrase, item): the windows of ``width`` words of each item, or all words of a
    shorter one, as the 64-bit hashes of their words."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            w = Words(chunk.column("text"), ALNUM, lower=True)
            phrase, owner = [], []
            for doc, (first, n) in enumerate(zip(w.first.tolist(), w.count.tolist())):
                h = w.hash[first:first + n]
                made = [h[at:at + width].tobytes() for at in range(max(1, n - width + 1))] if n else []
                phrase += made
                owner += [doc] * len(made)
            yield pa.RecordBatch.from_arrays(
                [pa.array(phrase, pa.binary()), chunk.column("item").take(pa.array(owner, pa.int64()))],
                names=["phrase", "item"])

    return rows.mapInArrow(run, "phrase binary, item string").distinct()


def gathered(found: pa.Table, width: int) -> Phrases:
    """The phrases of a group of pairs."""
    items: dict[bytes, list[int]] = {}
    ids: dict[str, int] = {}
    for phrase, item in zip(found.column("phrase").to_pylist(), found.column("item").to_pylist()):
        mine = items.setdefault(phrase, [])
        if item is not None:
            mine.append(ids.setdefault(item, len(ids)))
    sequences = [np.frombuffer(k, _U) for k in items]
    terms = np.unique(np.concatenate(sequences)) if sequences else np.zeros(0, _U)
    of = np.full((len(sequences), width), -1, np.int32)
    for row, h in zip(of, sequences):
        row[:len(h)] = np.searchsorted(terms, h)
    return Phrases(terms, of, np.array([len(h) for h in sequences], np.int32),
                   [np.array(v, np.int32) for v in items.values()], list(ids))


INDEX = "block long, kind int, term int, places binary, row binary"


def build(docs: DataFrame, terms: np.ndarray, gap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: per block a row with the documents (kind 0: in ``places`` the words of
    each, in ``row`` the keys) and one per test term (kind 1: ascending places, as
    differences of 32-bit words).  Documents lie ``gap`` places apart."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        part = TaskContext.get().partitionId()
        for number, chunk in enumerate(chunks(batches)):
            block = part << 32 | number
            w = Words(chunk.column("text"), ALNUM, lower=True)
            at = np.searchsorted(terms, w.hash)
            at[at == len(terms)] = 0
            known = np.flatnonzero(terms[at] == w.hash) if len(terms) else np.zeros(0, np.int64)
            term = at[known]
            order = np.argsort(term, kind="stable")
            place = (known + w.doc[known] * gap)[order].astype(np.uint32)
            term = term[order]
            first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, int)
            step = np.diff(place, prepend=np.uint32(0)).astype(np.uint32)
            step[first] = place[first]
            ends = np.append(first[1:], len(term))
            lists = [step[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist())]
            keys = chunk.column("key").to_pylist()
            ids = b"".join(b"\0" * 9 if k is None else b"\1" + int(k).to_bytes(8, "little", signed=True)
                           for k in keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(lists) + 1, block, np.int64)),
                 pa.array(np.r_[0, np.ones(len(lists), int)].astype(np.int32)),
                 pa.array(np.r_[-1, term[first]].astype(np.int32)),
                 pa.array([w.count.astype(np.int64).tobytes(), *lists], pa.binary()),
                 pa.array([ids, *[None] * len(lists)], pa.binary())],
                names=["block", "kind", "term", "places", "row"])

    return docs.mapInArrow(run, INDEX)


def _intersect(lists: list[np.ndarray], slop: int) -> np.ndarray:
    """Starts of a phrase whose k-th term has the places lists[k]."""
    order = sorted(range(len(lists)), key=lambda k: len(lists[k]))
    starts = lists[order[0]] - order[0]
    if slop:  # the rarest term may itself be displaced
        starts = np.unique((starts[:, None] + np.arange(-slop, slop + 1)).ravel())
    for k in order if slop else order[1:]:
        if not len(starts):
            break
        there = lists[k]
        i = np.searchsorted(there, starts + k - slop)
        i[i == len(there)] = len(there) - 1
        starts = starts[(there[i] >= starts + k - slop) & (there[i] <= starts + k + slop)]
    return starts


def _search_block(places: dict[int, np.ndarray], query: Phrases, slop: int) -> list[tuple[int, np.ndarray]]:
    have = np.zeros(len(query.terms) + 1, bool)
    have[list(places)] = True
    have[-1] = True  # place -1: beyond a short phrase's end
    out = []
    for p in np.flatnonzero(have[query.of].all(axis=1)).tolist():
        lists = [places[t] for t in query.of[p, :query.length[p]].tolist()]
        starts = _intersect(lists, slop)
        if len(starts):
            out.append((p, starts))
    return out


FOUND = ("block long, row long, doc_id long, n_words long, n_hit long, n_items long, items array<string>, "
         "spans binary")


def search(index: DataFrame, query: Phrases, gap: int, slop: int = 0) -> DataFrame:
    """One row per indexed document: words, hit words, items and their sorted ids, and the hit
    runs as pairs of 32-bit word places (first, last + 1)."""
    shared = index.sparkSession.sparkContext.broadcast(query)

    def run(table: pa.Table) -> pa.Table:
        query = shared.value
        kind = table.column("kind").to_numpy()
        head = int(np.flatnonzero(kind == 0)[0])
        n_words = np.frombuffer(table.column("places")[head].as_py(), np.int64)
        raw = table.column("row")[head].as_py()
        keys = [int.from_bytes(raw[i + 1:i + 9], "little", signed=True) if raw[i] else None
                for i in range(0, len(raw), 9)]
        starts_of = np.zeros(len(n_words) + 1, np.int64)
        np.cumsum(n_words, out=starts_of[1:])
        begin = starts_of[:-1] + np.arange(len(n_words)) * gap
        places = {}
        for t, blob in zip(table.column("term").to_pylist(), table.column("places")):
            if t >= 0:
                places[t] = np.cumsum(np.frombuffer(blob.as_py(), np.uint32), dtype=np.int64)
        total = int(begin[-1] + n_words[-1]) if len(begin) else 0
        cover = np.zeros(total + 1, np.int32)
        items: dict[int, set[int]] = {}
        for p, starts in _search_block(places, query, slop):
            stop = np.minimum(starts + query.length[p], total)
            np.add.at(cover, np.maximum(starts, 0), 1)
            np.subtract.at(cover, stop, 1)
            docs = np.unique(np.searchsorted(begin, starts + min(slop, 1), side="right") - 1)
            for d in docs.tolist():
                items.setdefault(d, set()).update(query.items[p].tolist())
        hit = np.cumsum(cover)[:total] > 0
        n_hit, spans, names = [], [], []
        for d in range(len(n_words)):
            if d not in items:
                n_hit.append(0), spans.append(b""), names.append([])
                continue
            mine = hit[begin[d]:begin[d] + n_words[d]].astype(np.int8)
            edges = np.flatnonzero(np.diff(np.r_[0, mine, 0]).astype(bool)).astype(np.uint32)
            n_hit.append(int(mine.sum()))
            spans.append(edges.tobytes())
            names.append(sorted(query.ids[i] for i in items[d]))
        return pa.table({
            "block": pa.array(np.full(len(n_words), table.column("block")[0].as_py(), np.int64)),
            "row": pa.array(np.arange(len(n_words), dtype=np.int64)),
            "doc_id": pa.array(keys, pa.int64()), "n_words": pa.array(n_words),
            "n_hit": pa.array(n_hit, pa.int64()),
            "n_items": pa.array([len(items.get(d, ())) for d in range(len(n_words))], pa.int64()),
            "items": pa.array(names, pa.list_(pa.string())), "spans": pa.array(spans, pa.binary()),
        })

    return index.groupBy("block").applyInArrow(run, FOUND)


def _merged(found: DataFrame) -> DataFrame:
    """One row per document from those of several groups of phrases, a few thousand at a time."""

    def run(table: pa.Table) -> pa.Table:
        rows = {}
        for r in table.to_pylist():
            old = rows.setdefault(r["doc_id"], r | {"names": set(), "cover": []})
            old["names"].update(r["items"])
            old["cover"].append(np.frombuffer(r["spans"], np.uint32).reshape(-1, 2))
        for r in rows.values():
            mark = np.zeros(r["n_words"] + 1, np.int32)
            for a, b in np.concatenate(r.pop("cover")).tolist():
                mark[a] += 1
                mark[b] -= 1
            hit = (np.cumsum(mark)[:-1] > 0).astype(np.int8)
            names = sorted(r.pop("names"))
            r["n_hit"], r["n_items"], r["items"] = int(hit.sum()), len(names), names
            r["spans"] = np.flatnonzero(np.diff(np.r_[0, hit, 0])).astype(np.uint32).tobytes()
        return pa.Table.from_pylist(list(rows.values()), schema=table.schema)

    return found.groupBy(F.floor(F.col("doc_id") / 4096)).applyInArrow(run, FOUND)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 0,
                  key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """``search`` for all phrases of the benchmark in all documents."""
    found = scratch.stage(pairs(benchmark, width, item, item_text), "benchmark-phrases")
    groups = max(1, -(-found.count() // GROUP_PHRASES))
    gap = width + 2 * slop + 1

    def group(number: int) -> Phrases:
        return gathered(found.where(F.pmod(F.xxhash64("phrase", "item"), F.lit(groups)) == number).toArrow(), width)

    if groups == 1:
        query = group(0)
        return search(build(docs, query.terms, gap, key, text), query, gap, slop)
    # a row's place on disk is its name in all passes
    rows = scratch.stage(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), "corpus")
    named = with_file(rows, "file", "at").withColumn("place", F.col("file") * F.lit(1 << 40) + F.col("at"))
    parts = None
    for number in range(groups):
        query = group(number)
        part = scratch.stage(search(build(named, query.terms, gap, "place", "text"), query, gap, slop), "contamination")
        parts = part if parts is None else parts.unionByName(part)
    merged = _merged(parts).withColumnRenamed("doc_id", "place")
    return named.select("place", F.col("key").alias("doc_id")).join(merged, "place").select(*parts.columns)
