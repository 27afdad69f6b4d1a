"""Whitening of embedding vectors from the singular values of their centred rows.

Entries become whole numbers first, ``x = floor(64 * c) + 1000000``, so sums and squared
deviations are exact.  The rows are centred before anything is multiplied, as
``(n * x - S) / n`` with the integer ``n * x - S``.  Each task reduces its centred rows to one
triangular factor by blockwise QR, and factors are stacked and reduced again, a bounded number
at a time, until one is left: a matrix of dimensions x dimensions, whatever the number of rows.
Its singular values and directions come from :mod:`stratarates.llm.singular` (Householder
bidiagonalisation, dqds, twisted factorisations).  No covariance matrix is formed, so small
eigenvalues keep their digits.

The vectors are read four times (sums, factors, check, result).  Only sums and factors, a few
numbers per task, are shuffled; nothing is sampled.

Dropped are null and empty vectors, vectors with a null or non-finite entry, and vectors whose
length is not the commonest one (of equally common ones the greatest).  Null and repeated keys
are rows like others.  Components without variance (an eigenvalue at rounding level of the
largest) can't be whitened and give no rows, so a single vector or copies of one give none.
Entries must keep ``x`` below 2**52, and ``n * x`` and the sum of squared deviations must fit
into a long, else the job fails with an error.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarates.llm import scratch
from stratarates.llm.singular import right_vectors

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
ROWS = 2048
#: numbers in the factors that one task stacks
STACK = 1 << 20
_LONG = float(1 << 62)


class Whitening(NamedTuple):
    """``directions``: one column per component, already divided by the root of its eigenvalue."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    explained: np.ndarray


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(key, v) of the vectors that count, and their length."""
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dims = most[0]["d"] if most else 0
    return rows.where(F.size("v") == dims), dims


def _slices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows in pieces of at most ``ROWS``, with their whole numbers."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            c = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            scaled = np.floor(SCALE * c) + OFFSET
            if np.abs(scaled).max(initial=0) >= 2.0 ** 52:
                raise ValueError("an entry is too large for exact sums")
            yield part, scaled.astype(np.int64)


def _added(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all tasks of the array that ``partial`` makes of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([partial(batches)])], names=["a"])

    sums = rows.mapInArrow(run, f"a array<{kind}>").select(F.posexplode("a").alias("at", "x"))
    return np.array([r["x"] for r in sums.groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()])


def sums(rows: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """The number of vectors and the exact sum of each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(dims + 1, np.int64)
        for part, x in _slices(batches, dims):
            total += np.append(x.sum(axis=0), len(x))
        return total

    found = _added(rows, partial, "bigint")
    return int(found[-1]), found[:-1].astype(np.int64)


def _lifted(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n * x - S, exact."""
    if n * float(np.abs(x).max(initial=0)) >= _LONG:
        raise OverflowError("n * x does not fit into a long")
    return n * x - total


def factor(rows: DataFrame, dims: int, n: int, total: np.ndarray) -> np.ndarray:
    """The triangular factor of all centred rows."""

    def reduced(blocks: Iterator[np.ndarray]) -> bytes:
        r = np.zeros((0, dims))
        for block in blocks:
            r = np.linalg.qr(np.vstack([r, block]), mode="r")
        return np.vstack([r, np.zeros((dims - len(r), dims))]).tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = reduced(_lifted(x, n, total) / n for _, x in _slices(batches, dims))
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([made])], names=["block", "r"])

    def again(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        made = reduced(np.frombuffer(r.as_buffer()).reshape(dims, dims) for r in table.column("r"))
        return pa.table({"block": [table.column("block")[0].as_py() // fan], "r": [made]})

    fan = min(64, max(2, STACK // (dims * dims)))
    schema = "block long, r binary"
    factors = scratch.stage(rows.mapInArrow(first, schema), "factors")
    while (last := factors.agg(F.max("block")).first()[0]) > 0:
        factors = scratch.stage(
            factors.groupBy(F.floor(F.col("block") / fan).cast("long")).applyInArrow(again, schema), "factors")
    return np.frombuffer(factors.first()["r"]).reshape(dims, dims)


def fit(rows: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``usable`` rows; None if no component has variance."""
    if not dims:
        return None
    n, total = sums(rows, dims)
    r = factor(rows, dims, n, total)
    squares, v = right_vectors(r)
    kept = min(components, int((squares > 0).sum()))
    if not kept:
        return None
    values = squares[:kept] / n
    return Whitening(n, total, v[:, :kept] / np.sqrt(values), values / (float((r * r).sum()) / n))


def identity_error(rows: DataFrame, dims: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over all rows."""
    k = model.directions.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        found = np.zeros(k * k + k)
        for _, x in _slices(batches, dims):
            y = _lifted(x, model.n, model.sums) / model.n @ model.directions
            found += np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])
        return found

    found = _added(rows, partial, "double") / model.n
    mean = found[k * k:]
    return float(np.abs(found[:k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


SCHEMA = ("key long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def whiten(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector and component: its whitened coordinate, the component's share
    of the variance, and figures of the whole fit."""
    rows, dims = usable(vectors, key, vector)
    model = fit(rows, dims, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    error = identity_error(rows, dims, model)
    k = model.directions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _slices(batches, dims):
            lifted = _lifted(x, model.n, model.sums)
            if (lifted.astype(float) ** 2).sum(axis=1).max(initial=0) >= _LONG:
                raise OverflowError("the squared deviation does not fit into a long")
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(pa.array(np.repeat(np.arange(m), k))),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                 pa.array(np.repeat((lifted * lifted).sum(axis=1), k)),
                 pa.array((lifted / model.n @ model.directions).ravel()), pa.array(np.tile(model.explained, m)),
                 pa.array(np.full(m * k, error))],
                names=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)
