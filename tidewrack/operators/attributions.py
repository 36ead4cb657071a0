"""Shapley values of forests of regression trees, by the paths to their leaves.

A row's share in a leaf is a product over the columns on its path: one or nothing where the row's value decides, the
share of training rows that go that way where the column isn't known. The average over all orders of getting to know
the columns is a sum of products of a few polynomials for each leaf, and is taken for a batch of rows at once.
Trees are small and go to the tasks; rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Leaf:
    """A leaf's value times its tree's weight, and for each column on its path: bounds (above, up to) and the share of
    training rows that go its way at that column's splits."""

    value: float
    columns: list[int]
    above: list[float]
    upto: list[float]
    share: list[float]


def leaves(model: PipelineModel) -> list[Leaf]:
    """All leaves of a fitted forest or boosted model; splits must be of numbers."""
    fitted = model.stages[-1]
    weights = list(fitted.treeWeights)
    total = 1.0 if "GBT" in type(fitted).__name__ else sum(weights)  # boosted trees are summed, a forest's averaged
    out: list[Leaf] = []
    for tree, weight in zip(fitted.trees, weights):
        todo = [(tree._java_obj.rootNode(), {})]
        while todo:
            node, path = todo.pop()
            if node.getClass().getSimpleName() == "LeafNode":
                columns = sorted(path)
                out.append(Leaf(float(node.prediction()) * weight / total, columns, *([path[c][k] for c in columns] for k in range(3))))
                continue
            split, rows = node.split(), float(node.impurityStats().count())
            if split.getClass().getSimpleName() != "ContinuousSplit":
                raise ValueError("splits of categories are not attributed")
            column, at = int(split.featureIndex()), float(split.threshold())
            low, high, share = path.get(column, (-np.inf, np.inf, 1.0))
            for child, bounds in ((node.leftChild(), (low, min(high, at))), (node.rightChild(), (max(low, at), high))):
                todo.append((child, path | {column: (*bounds, share * float(child.impurityStats().count()) / rows)}))
    return out


def shapley(x: np.ndarray, own: Sequence[Leaf]) -> tuple[np.ndarray, float]:
    """(rows by columns, what the model gives where nothing is known). The values of a row add up to its prediction less that."""
    out, base = np.zeros(x.shape), 0.0
    for leaf in own:
        m, share = len(leaf.columns), np.array(leaf.share)
        base += leaf.value * float(np.prod(share))
        one = np.stack([(x[:, c] > a) & (x[:, c] <= b) for c, a, b in zip(leaf.columns, leaf.above, leaf.upto)]).astype(float) if m else np.zeros((0, len(x)))
        weights = [factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)]
        for i, column in enumerate(leaf.columns):
            # coefficient s: the sum over sets of s other columns that are known
            known = np.zeros((m, len(x)))
            known[0] = 1.0
            for j in range(m):
                if j != i:
                    known[1:] = known[1:] * share[j] + known[:-1] * one[j]
                    known[0] *= share[j]
            out[:, column] += leaf.value * (one[i] - share[i]) * sum(w * k for w, k in zip(weights, known))
    return out, base


def tree_attributions(model: PipelineModel, df: DataFrame, columns: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """(ids..., prediction, base, a column for each of ``columns``): Shapley values of each row; rows with a missing value
    are left out. ``columns`` are the model's, in its order."""
    own = leaves(model)
    told = df.select(*ids, *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns))).na.drop(subset=[f"x{i}" for i in range(len(columns))])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in told.schema if f.name in ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f"x{i}").to_numpy() for i in range(len(columns))])
            values, base = shapley(x, own)
            kept = [batch.column(c) for c in ids]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(values.sum(axis=1) + base), pa.array(np.full(len(x), base)), *(pa.array(values[:, i]) for i in range(len(columns)))], [*ids, "prediction", "base", *columns])

    return told.mapInArrow(run, ", ".join([fields, "prediction double, base double", *(f"`{c}` double" for c in columns)]))


def importance(attributed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, mean_abs): mean size of each column's values."""
    return attributed.agg(*(F.avg(F.abs(c)).alias(c) for c in columns)).withColumn("__", F.lit(0)).unpivot(["__"], list(columns), "variable", "mean_abs").drop("__")
