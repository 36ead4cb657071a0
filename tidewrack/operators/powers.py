"""Likelihoods of power transforms, for many powers in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def box_cox(x: np.ndarray, power: float) -> np.ndarray:
    logs = np.log(x)
    return logs if abs(power) < 1e-12 else np.expm1(power * logs) / power


def yeo_johnson(x: np.ndarray, power: float) -> np.ndarray:
    up, out = x >= 0, np.empty(len(x))
    out[up] = box_cox(x[up] + 1, power)
    out[~up] = -box_cox(1 - x[~up], 2 - power)
    return out


def variances(df: DataFrame, transform: Callable[[np.ndarray, float], np.ndarray], powers: Mapping[str, Sequence[float]], means: Mapping[str, float]) -> dict[str, list[float | None]]:
    """For each column the population variance of its ``transform`` by each of its ``powers``.

    A task works out each distinct value of a batch once, and gives sums of departures, and of their squares, from what
    becomes of the column's mean. Rows with a missing value in a column don't count for it.
    """
    columns = list(powers)
    at = {c: [float(transform(np.array([means[c]]), g)[0]) for g in powers[c]] for c in columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {c: np.zeros((3, len(powers[c]))) for c in columns}
        for batch in batches:
            for c in columns:
                values, times = np.unique(batch.column(c).drop_null().to_numpy(zero_copy_only=False), return_counts=True)
                for j, g in enumerate(powers[c]):
                    off = transform(values, g) - at[c][j]
                    sums[c][:, j] += times.sum(), times @ off, times @ (off * off)
        rows = [(c, j, *map(float, sums[c][:, j])) for c in columns for j in range(len(powers[c]))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["name", "nth", "n", "s1", "s2"])

    parts = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).mapInArrow(run, "name string, nth long, n double, s1 double, s2 double")
    told = {(r["name"], r["nth"]): r for r in parts.groupBy("name", "nth").agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2")).collect()}

    def variance(c: str, j: int) -> float | None:
        r = told.get((c, j))
        if r is None or not r["n"]:
            return None
        v = r["s2"] / r["n"] - (r["s1"] / r["n"]) ** 2
        return 0.0 if v <= (1e-15 * at[c][j]) ** 2 else v  # one value over and over

    return {c: [variance(c, j) for j in range(len(powers[c]))] for c in columns}
