"""Quality rules from the frequency of lines across documents of a host.

Lines are normalised (runs of white space become one space, ends trimmed, A-Z
lower-cased) and hashed; a host's line is counted once per distinct text, so copies of a
document never make its own lines frequent.  A line is over the limit if more than
``share`` of the host's distinct texts have it, and at least ``least`` of them.  Lines over
the limit are removed, and a document is rejected if what remains is depleted: if less than
``remain`` of its words stand in other lines and bear no markup or currency symbol, or if a
base rule fails (under ten words, or a fifth of the words in repeated five-word windows).

Counting is a hash aggregation with map-side combine: a host that owns a third of all
documents and a line that stands in all of them send one row per task.  The lines over the
limit are joined back with a join that AQE may split; nothing is broadcast by hand.

Null texts count as empty: no words, base rule fails.  A null host is a host of its own,
a null key stays null.  Repeated rows get equal verdicts.  Texts of any length are one row
of line hashes.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarates.llm import scratch
from stratarates.llm.words import _LOWER, Words, chunks, cover_runs, mix

SHARE, LEAST, REMAIN = 0.05, 20, 0.25
REPEAT_WIDTH = 5
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_U = np.uint64

METRICS = ("doc_id long, host string, text_key string, n_words long, n_clean long, word_chars long, n_symbols long, "
           "n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>")


def _sum_by(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[at])


def _repeated(group: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether (group, h) occurs more than once."""
    order = np.lexsort((h, group))
    same = (group[order][1:] == group[order][:-1]) & (h[order][1:] == h[order][:-1])
    out = np.zeros(len(h), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _line_hashes(w: Words) -> tuple[np.ndarray, ...]:
    """For lines with a word: (text, raw hash, normalised hash, words, words with symbols)."""
    newline = np.flatnonzero(w.data == 0x0A)
    begin = np.union1d(newline + 1, w.offsets[:-1])
    begin = begin[begin < len(w.data)]
    end = np.append(begin[1:], len(w.data))
    end = end - (w.data[end - 1] == 0x0A)  # the newline itself is in no line
    first = np.searchsorted(w.start, begin)
    last = np.searchsorted(w.start, end)
    some = last > first
    begin, end, first, last = begin[some], end[some], first[some], last[some]
    doc = w.doc[first] if len(first) else np.zeros(0, np.int64)
    raw = w.slice_hash(begin, end)
    # the words' hashes with their place in the line, so that white space does not matter
    place = np.arange(len(w)) - np.repeat(first, last - first) if len(w) else np.zeros(0, np.int64)
    parts = mix(w.lower_hash + place.astype(_U) * _U(0x9E3779B97F4A7C15))
    total = np.zeros(len(w) + 1, _U)
    np.cumsum(parts, out=total[1:])
    symbols = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(_SYMBOL[w.data], out=symbols[1:])
    marked = (symbols[w.end] > symbols[w.start]).astype(np.int64)
    return doc, raw, total[last] - total[first], last - first, _sum_of(marked, first, last)


def _sum_of(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[last] - total[first]


class _Text(Words):
    @property
    def lower_hash(self) -> np.ndarray:
        kept, self.data = self.data, _LOWER[self.data]
        out = self.slice_hash(self.start, self.end)
        self.data = kept
        return out


def text_key(text: str):
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def metrics(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The base figures of each document, the hashes of its lines that have words, and of
    each line the words that bear no symbol."""
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"),
                       F.col(host).cast("string").alias("host"), text_key(text).alias("text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            w = _Text(chunk.column("text"))
            n = chunk.num_rows
            points = w.code_points()
            chars = _sum_by(points[w.end] - points[w.start], w.first)
            symbols = _sum_by(_SYMBOL[w.data], w.offsets)
            at, h = w.windows(REPEAT_WIDTH)
            mark = np.zeros(len(w), bool)
            if len(at):
                mark[at[_repeated(w.doc[at], h)]] = True
            repeat = _sum_by(cover_runs(mark, REPEAT_WIDTH).astype(np.int64), w.first)
            doc, raw, line, words, marked = _line_hashes(w)
            dup = np.zeros(n, np.int64)
            if len(doc):
                order = np.lexsort((raw, doc))
                same = (doc[order][1:] == doc[order][:-1]) & (raw[order][1:] == raw[order][:-1])
                np.add.at(dup, doc[order][1:][same], 1)
            clean = np.bincount(doc, words - marked, n).astype(np.int64)
            lists = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("key"), chunk.column("host"), chunk.column("text_key"),
                 pa.array(w.count.astype(np.int64)), pa.array(clean), pa.array(chars), pa.array(symbols),
                 pa.array(dup), pa.array(repeat),
                 pa.ListArray.from_arrays(pa.array(lists), pa.array(line.view(np.int64))),
                 pa.ListArray.from_arrays(pa.array(lists), pa.array((words - marked).astype(np.int32)))],
                names=[c.split()[0] for c in METRICS.split(", ")])

    return docs.mapInArrow(run, METRICS)


def over_limit(found: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """Per (host, text_key) of texts that have lines over the limit: their hashes in
    ``over``, and how many words without symbols and how many lines they are."""
    texts = found.groupBy("host", "text_key").agg(F.first(F.struct("lines", "line_words")).alias("l"))
    size = texts.groupBy("host").agg(F.count("*").alias("texts"))
    lines = (texts.select("host", "text_key", F.explode(F.arrays_zip("l.lines", "l.line_words")).alias("x"))
             .groupBy("host", "text_key", F.col("x.lines").alias("line"))
             .agg(F.sum("x.line_words").alias("clean"), F.count("*").alias("times")))
    count = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    a, b = count.alias("a"), size.alias("b")
    limit = (a.join(b, F.col("a.host").eqNullSafe(F.col("b.host")))
             .where(F.col("n") > share * F.col("texts"))
             .select(F.col("a.host").alias("host"), "line"))
    a, b = lines.alias("a"), limit.alias("b")
    return (a.join(b, F.col("a.host").eqNullSafe(F.col("b.host")) & (F.col("a.line") == F.col("b.line")))
            .groupBy("a.host", "a.text_key")
            .agg(F.collect_list("a.line").alias("over"), F.sum("clean").alias("over_words"),
                 F.sum("times").alias("n_removed_lines")))


def verdicts(docs: DataFrame, share: float = SHARE, least: int = LEAST, remain: float = REMAIN,
             **names) -> DataFrame:
    """The figures of each document with ``base_failed``, ``n_removed_lines``, ``over`` and
    ``kept``."""
    found = scratch.stage(metrics(docs, **names), "line-metrics")
    over = over_limit(found, share, least).withColumnRenamed("host", "h").withColumnRenamed("text_key", "k")
    rows = found.drop("lines", "line_words").join(
        over, F.col("host").eqNullSafe(F.col("h")) & (F.col("text_key") == F.col("k")), "left").drop("h", "k")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_clean") - F.coalesce("over_words", F.lit(0))
    return rows.select(
        "*", failed.alias("base_failed"),
        (~failed & (left >= remain * F.col("n_words"))).alias("kept"),
    ).fillna({"n_removed_lines": 0}).drop("over_words")


def filtered(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
             **limits) -> DataFrame:
    """The documents that are kept, without their lines over the limit.  All columns stay;
    only texts that lose a line are rewritten."""
    found = verdicts(docs, key=key, text=text, host=host, **limits)
    ruled = (found.where("kept").groupBy(F.col("host").alias("__h"), F.col("text_key").alias("__k"))
             .agg(F.first("over").alias("__over")))
    kept = docs.join(ruled, F.col(host).cast("string").eqNullSafe(F.col("__h")) & (text_key(text) == F.col("__k")))
    kept = kept.select(*docs.columns, "__over")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, text):
            column = chunk.column(text)
            over = chunk.column("__over").to_pylist()
            lose = [i for i, x in enumerate(over) if x]
            if lose:
                texts = column.to_pylist()
                for i in lose:
                    texts[i] = without(texts[i], np.array(over[i], np.int64))
                column = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays(
                [column if c == text else chunk.column(c) for c in names], names=names)

    return kept.mapInArrow(run, docs.schema)


def without(text: str, over: np.ndarray) -> str:
    """``text`` without the lines whose hash is in ``over``; blank lines stay."""
    lines = text.split("\n")
    some = [i for i, line in enumerate(lines) if len(line.encode().split())]
    _, _, h, _, _ = _line_hashes(_Text(pa.array([text])))
    gone = {i for i, drop in zip(some, np.isin(h.view(np.int64), over)) if drop}
    return "\n".join(line for i, line in enumerate(lines) if i not in gone)
