"""Toxic passages as maximal-scoring segments of token log-odds.

A token's score is the log-odds of its share of toxic occurrences against the share of all
tokens, less a drift that makes ordinary text score below zero.  Shares are smoothed with
Dirichlet priors that back off: a word's prior is the share of its prefix of six bytes,
whose prior is that of five, and so on to all tokens, so unseen inflections of a known stem
score too.  A linear scan finds every maximal-scoring segment.  Their scores are calibrated
by extreme values: in clean texts the best of n tokens exceeds S about K n exp(-lambda S)
times, and a document's evidence is the sum of the negative logarithms of these numbers
over its significant segments.  A logistic curve turns evidence into a score.

The model is a table of counts by hash with ``WORDS`` + 4 ``PREFIXES`` cells whatever the
corpus, so what is collected and broadcast has a fixed size.  Counts come from one part of
the labelled rows, calibration from another; both are bounded by ``LABELLED`` rows picked
by hash.  Scoring reads every whole text and shuffles nothing.

Null and empty texts have no tokens and get the score of no evidence.  Null labels are not
learnt from; of conflicting labels of a key the largest counts.  Rows with a null key are
scored and count as not held out.  Repeated rows get equal scores.  Without labels of both
classes every score is the share of the toxic among them, or 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarates.llm import scratch
from stratarates.llm.words import ALNUM, Words, chunks, mix

WORDS, PREFIXES, LENGTHS = 1 << 18, 1 << 16, (3, 4, 5, 6)
#: labelled rows used at most, for counting and for calibration each
LABELLED = 200_000
PRIOR, DRIFT = 5.0, 2.0
THRESHOLD = 0.7
_CELLS = WORDS + len(LENGTHS) * PREFIXES
_U = np.uint64


class Model(NamedTuple):
    toxic: np.ndarray  # texts by cell
    total: np.ndarray
    share: float  # of all tokens
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    slope: float = 1.0
    offset: float = 0.0


class Segment(NamedTuple):
    first: int
    last: int
    score: float


def cells(w: Words) -> list[np.ndarray]:
    """The cells of each word, from the shortest prefix to the whole word."""
    out = []
    for i, k in enumerate(LENGTHS):
        h = w.slice_hash(w.start, np.minimum(w.end, w.start + k))
        out.append((mix(h + _U(k)) & _U(PREFIXES - 1)).astype(np.int64) + WORDS + i * PREFIXES)
    out.append((w.hash & _U(WORDS - 1)).astype(np.int64))
    return out


def token_scores(w: Words, model: Model) -> np.ndarray:
    share = np.full(len(w), model.share)
    for at in cells(w):
        share = (model.toxic[at] + PRIOR * share) / (model.total[at] + PRIOR)
    base = np.log(model.share / (1 - model.share))
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share)) - base - DRIFT


def maximal_segments(score: np.ndarray) -> list[Segment]:
    """All maximal-scoring segments, in time linear in the scores."""
    up = score > 0
    edge = np.flatnonzero(np.diff(np.r_[False, up, False]))
    sums = np.r_[0.0, np.cumsum(score)]
    held: list[list[float]] = []  # first, last, sum before, sum after
    for first, stop in zip(edge[::2].tolist(), edge[1::2].tolist()):
        new = [first, stop - 1, sums[first], sums[stop]]
        while True:
            # candidates whose sum before is no less can never precede a merge: skip them
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j = held[j][4]
            if j < 0 or held[j][3] >= new[3]:
                held.append([*new, j])
                break
            new[0], new[2] = held[j][0], held[j][2]
            del held[j:]
    return [Segment(int(a), int(b), r - left) for a, b, left, r, _ in held]


def _documents(w: Words, model: Model) -> Iterator[list[Segment]]:
    score = token_scores(w, model)
    some = np.add.reduceat(np.r_[score > 0, False], w.first[:-1]) if len(w) else np.zeros(len(w.count))
    for d, n in enumerate(w.count.tolist()):
        a = int(w.first[d])
        yield maximal_segments(score[a:a + n]) if n and some[d] else []


def evidence(segments: list[Segment], n: int, model: Model) -> float:
    """The sum over segments of -log of how often chance gives a score as high in n tokens."""
    return sum(max(0.0, model.rate * s.score - np.log(model.scale * max(n, 1))) for s in segments)


def probability(z: np.ndarray | float, model: Model):
    return 1 / (1 + np.exp(-np.clip(model.slope * z + model.offset, -30, 30)))


def _words(column: pa.Array) -> Words:
    return Words(column, ALNUM, lower=True)


def _labelled(docs: DataFrame, labels: DataFrame, fold: int, key: str, text: str, label: str) -> DataFrame:
    """(text, toxic) of the labelled keys of a fold, at most about ``LABELLED`` rows: a key that
    repeats counts once, with the least of its texts, chosen map-side.  The labels sent to the
    tasks are as many rows of two numbers."""
    known = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
             .groupBy(F.col(key).cast("long").alias("key")).agg(F.max(F.col(label)).cast("int").alias("toxic")))
    known = known.where(F.crc32(F.col("key").cast("string")) % 3 == fold)
    n = known.count()
    if n > LABELLED:
        known = known.where(F.abs(F.xxhash64("key") % 1_000_000) < int(1_000_000 * LABELLED / n))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    found = rows.join(F.broadcast(known), "key").groupBy("key").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    return scratch.stage(found.select("text", "toxic"), "labelled")


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, total = np.zeros(_CELLS, np.int64), np.zeros(_CELLS, np.int64)
        for chunk in chunks(batches):
            w = _words(chunk.column("text"))
            bad = chunk.column("toxic").to_numpy() > 0
            for at in cells(w):  # a text counts once, however often it repeats a word
                once = np.unique(w.doc * _CELLS + at)
                text, at = once // _CELLS, once % _CELLS
                total += np.bincount(at, minlength=_CELLS)
                toxic += np.bincount(at[bad[text]], minlength=_CELLS)
        some = np.flatnonzero(total)
        for at in range(0, len(some), 1 << 16):
            part = some[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(toxic[part]), pa.array(total[part])],
                names=["cell", "toxic", "total"])

    found = rows.mapInArrow(run, "cell int, toxic long, total long").groupBy("cell").agg(
        F.sum("toxic").alias("toxic"), F.sum("total").alias("total")).toArrow()  # at most _CELLS rows
    toxic, total = np.zeros(_CELLS), np.zeros(_CELLS)
    at = found.column("cell").to_numpy()
    toxic[at], total[at] = found.column("toxic").to_numpy(), found.column("total").to_numpy()
    return toxic, total


def _figures(rows: DataFrame, model: Model, of: Callable[[list[Segment], int], float]) -> tuple[np.ndarray, ...]:
    """(toxic, words, figure) of each labelled row: three numbers of at most ``LABELLED`` rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            w = _words(chunk.column("text"))
            figures = [of(found, n) for found, n in zip(_documents(w, shared.value), w.count.tolist())]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("toxic"), pa.array(w.count.astype(np.int64)), pa.array(figures, pa.float64())],
                names=["toxic", "n", "figure"])

    found = rows.mapInArrow(run, "toxic int, n long, figure double").toArrow()
    return tuple(found.column(c).to_numpy() for c in ("toxic", "n", "figure"))


def _calibrated(rows: DataFrame, model: Model) -> Model:
    """Extreme-value parameters from the best segments of clean texts, then the logistic curve
    from the evidence that these give."""
    y, n, best = _figures(rows, model, lambda found, _: max((s.score for s in found), default=0.0))
    clean = best[(y == 0) & (n > 0)]
    if not len(clean) or not (y > 0).any():
        return model
    start = np.quantile(clean, 0.9)
    over = clean[clean > start] - start
    rate = 1 / max(over.mean(), 0.05) if len(over) else 1.0
    part = min(max((clean > start).mean(), 1e-4), 0.5)
    scale = -np.log(1 - part) * np.exp(rate * start) / max(n[(y == 0) & (n > 0)].mean(), 1)
    fitted = model._replace(rate=float(rate), scale=float(scale))
    light = fitted._replace(toxic=np.zeros(0), total=np.zeros(0))  # evidence needs two numbers of it
    y, n, z = _figures(rows, model, lambda found, words: evidence(found, words, light))
    slope, offset = _logistic(z, (y > 0).astype(float))
    return fitted._replace(slope=slope, offset=offset)


def _logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps with a weak prior on the slope, on evidence scaled by its spread."""
    unit = max(z.std(), 1e-9)
    x, at = np.column_stack([z / unit, np.ones(len(z))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        grad = x.T @ (y - p) - np.array([1e-3, 0]) * at
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-9]), grad)
        at = at + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0] / unit), float(at[1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        label: str = "toxic") -> Model:
    """Learnt from labelled rows whose crc32 of the key modulo 3 is 0 (counts) or 2
    (calibration); those with remainder 1 are never read with their labels."""
    toxic, total = _counts(_labelled(docs, labels, 0, key, text, label))
    words = slice(0, WORDS)
    n = total[words].sum()
    share = float(toxic[words].sum() / n) if n else 0.0
    if not 0 < share < 1:
        return Model(toxic, total, min(max(share, 1e-9), 1 - 1e-9), slope=0.0,
                     offset=float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))))
    return _calibrated(_labelled(docs, labels, 2, key, text, label), Model(toxic, total, share))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, passages): passages are the significant segments
    as structs of word places (first, last) and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = "doc_id long, score double, passages array<struct<first:int,last:int,score:double>>"
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for chunk in chunks(batches):
            w = _words(chunk.column("text"))
            z, passages = [], []
            for found, n in zip(_documents(w, model), w.count.tolist()):
                z.append(evidence(found, n, model))
                passages.append([s._asdict() for s in found if evidence([s], n, model) > 0])
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(probability(np.array(z), model)), pa.array(passages, kind)],
                names=["doc_id", "score", "passages"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, out).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")
