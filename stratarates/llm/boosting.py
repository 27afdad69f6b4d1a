"""Boosted trees: trained by Spark's GBTClassifier, scored as SQL expressions or arrays.

Training runs on executors over rows whose number the caller bounds and documents, or over
distinct rows with weights.  The
fitted trees (a few hundred numbers) are read off the model's public description, so that
scoring needs neither an assembled vector nor a model object in the tasks.  The expression that
scores walks through constant arrays of nodes, so that plans do not grow with the trees.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Split(NamedTuple):
    feature: int
    at: float
    low: Split | float
    high: Split | float


class Boosted(NamedTuple):
    trees: list[Split | float]
    weights: list[float]

    def expression(self, features: list[Column] | Column) -> Column:
        """The probability of the positive class as an expression of feature columns, or of their array."""
        of = features if isinstance(features, Column) else F.array(*features)
        nodes, roots = _Nodes([], [], [], [], []), []
        depth = max(1, *(nodes.add(tree, weight, roots) for tree, weight in zip(self.trees, self.weights)))
        feature, low, high = (_constant(x, "int") for x in (nodes.feature, nodes.low, nodes.high))
        at, value = _constant(nodes.at, "double"), _constant(nodes.value, "double")

        def leaf(root: Column) -> Column:
            return F.aggregate(_constant(range(depth), "int"), root, lambda i, _: F.when(
                F.get(of, F.get(feature, i)) <= F.get(at, i), F.get(low, i)).otherwise(F.get(high, i)))

        total = F.aggregate(_constant(roots, "int"), F.lit(0.0), lambda a, root: a + F.get(value, leaf(root)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(total * F.lit(-2.0)))

    def probability(self, features: np.ndarray) -> np.ndarray:
        total = np.zeros(len(features))
        for tree, weight in zip(self.trees, self.weights):
            total += weight * _values(tree, features)
        return 1 / (1 + np.exp(-2 * total))


class _Nodes(NamedTuple):
    """The nodes of all trees by number; both ways from a leaf lead to itself."""
    feature: list[int]
    at: list[float]
    low: list[int]
    high: list[int]
    value: list[float]

    def add(self, node: Split | float, weight: float, numbers: list[int]) -> int:
        """The levels below ``node``, whose number is appended to ``numbers``."""
        i, split = len(self.at), isinstance(node, Split)
        numbers.append(i)
        for column, x in zip(self, (node.feature, node.at, i, i, 0.0) if split else (0, 0.0, i, i, node * weight)):
            column.append(x)
        if not split:
            return 0
        below: list[int] = []
        levels = 1 + max(self.add(node.low, weight, below), self.add(node.high, weight, below))
        self.low[i], self.high[i] = below[0], below[-1]
        return levels


def _constant(numbers: Iterable[float], kind: str) -> Column:
    """An array that Spark makes once per query, written in one piece."""
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast(f"array<{kind}>")


def _values(node: Split | float, features: np.ndarray) -> np.ndarray:
    if not isinstance(node, Split):
        return np.full(len(features), float(node))
    low = features[:, node.feature] <= node.at
    out = np.empty(len(features))
    out[low] = _values(node.low, features[low])
    out[~low] = _values(node.high, features[~low])
    return out


def _parsed(text: str) -> Split | float:
    lines = iter(line.strip() for line in text.splitlines()[1:] if line.strip())

    def node() -> Split | float:
        line = next(lines)
        if line.startswith("Predict:"):
            return float(line.split(":")[1])
        feature, at = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = node()
        next(lines)  # Else
        return Split(int(feature), float(at), low, node())

    return node()


def fit(rows: DataFrame, features: list[str], label: str, trees: int = 12, depth: int = 3,
        weight: str | None = None) -> Boosted | None:
    """None if the rows have not both classes.  With a ``weight``, a row counts so often, and all
    rows give split points."""
    classes = rows.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()  # at most two rows
    if len(classes) < 2:
        return None
    numbers = [*features, label, *([weight] if weight else [])]
    vectors = VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="keep").transform(
        rows.select(*(F.col(c).cast("double").alias(c) for c in numbers)))
    learner = GBTClassifier(featuresCol="__features", labelCol=label, maxIter=trees, maxDepth=depth,
                            stepSize=0.3, seed=11, cacheNodeIds=False)
    if weight:
        # Spark takes split points from all rows if these are no more than 10,000 or the bins' square
        n = sum(r["count"] for r in classes)
        learner.setParams(weightCol=weight, maxBins=32 if n <= 10_000 else math.isqrt(n - 1) + 1)
    model = learner.fit(vectors.select("__features", *numbers[len(features):]))
    return Boosted([_parsed(t.toDebugString) for t in model.trees], [float(w) for w in model.treeWeights])
