"""Preprocessing as a fitted recipe: steps that learn a few numbers from the rows in whole passes and become column
expressions, so that training and new rows go through the same ones."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.measures import yeo_johnson
from tidewrack.lineage import written
from tidewrack.operators import powers

Step = Callable[[DataFrame], DataFrame]


class Recipe:
    """``fit`` learns steps in their order; ``transform`` applies them. Steps: ``range`` (0 to 1), ``center``, ``scale``,
    ``yeo_johnson``, ``pca`` (components up to a share of the variance) and ``ica`` (as many independent components as
    there are columns). Constant columns are left as they are by ``range`` and ``scale``. Rows with a missing value are not
    learned from."""

    def __init__(self, columns: Sequence[str], steps: Sequence[str], share: float = 0.9, rounds: int = 200, seed: int = 0):
        self.columns, self.steps, self.share, self.rounds, self.seed = list(columns), list(steps), share, rounds, seed
        self.done: list[Step] = []
        self.learned: dict[str, object] = {}

    def fit(self, df: DataFrame) -> Recipe:
        now = written(df.na.drop(subset=self.columns).select(*self.columns))  # each step is a pass or more
        for step in self.steps:
            if step not in ("range", "center", "scale", "yeo_johnson", "pca", "ica"):
                raise ValueError(f"no step {step}")
            made = getattr(self, f"_{step}")(now)
            self.done.append(made)
            now = made(now)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.done:
            df = step(df)
        return df

    def _each(self, made: dict[str, Column]) -> Step:
        return lambda df: df.withColumns(made)

    def _range(self, df: DataFrame) -> Step:
        row = df.agg(*(F.min(c) for c in self.columns), *(F.max(c) for c in self.columns)).first()
        k = len(self.columns)
        return self._each({c: (F.col(c) - row[i]) / (row[k + i] - row[i]) for i, c in enumerate(self.columns) if row[i] is not None and row[k + i] > row[i]})

    def _center(self, df: DataFrame) -> Step:
        row = df.agg(*(F.avg(c) for c in self.columns)).first()
        return self._each({c: F.col(c) - row[i] for i, c in enumerate(self.columns) if row[i] is not None})

    def _scale(self, df: DataFrame) -> Step:
        row = df.agg(*(F.stddev_samp(c) for c in self.columns)).first()
        return self._each({c: F.col(c) / row[i] for i, c in enumerate(self.columns) if row[i]})

    def _yeo_johnson(self, df: DataFrame) -> Step:
        """Each column's power of the largest likelihood, by grids that narrow; a grid is one pass for all columns."""
        ends = {c: (-3.0, 3.0) for c in self.columns}
        power = dict.fromkeys(self.columns, 1.0)
        row = df.agg(F.count("*"), *(F.avg(c) for c in self.columns), *(F.sum(F.signum(F.col(c)) * F.log1p(F.abs(F.col(c)))) for c in self.columns)).first()
        n, means, logs = row[0], row[1 : 1 + len(self.columns)], row[1 + len(self.columns) :]
        for _ in range(4 if n else 0):
            grids = {c: np.linspace(*ends[c], 13) for c in self.columns}
            spread = powers.variances(df, powers.yeo_johnson, grids, dict(zip(self.columns, map(float, means))))
            for i, c in enumerate(self.columns):
                score = [-n / 2 * math.log(max(v or 0.0, 1e-300)) + (g - 1) * (logs[i] or 0.0) for v, g in zip(spread[c], grids[c])]
                best = int(np.argmax(score))
                power[c], ends[c] = float(grids[c][best]), (float(grids[c][max(0, best - 1)]), float(grids[c][min(12, best + 1)]))
        self.learned["powers"] = power
        return self._each({c: yeo_johnson(F.col(c), p) for c, p in power.items()})

    def _moments(self, df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        k = len(self.columns)
        row = df.agg(*(F.avg(c) for c in self.columns), *(F.covar_samp(a, b) for i, a in enumerate(self.columns) for b in self.columns[i:])).first()
        cov, at = np.zeros((k, k)), k
        for i in range(k):
            for j in range(i, k):
                cov[i, j] = cov[j, i] = row[at] or 0.0
                at += 1
        return np.array([v or 0.0 for v in row[:k]]), cov

    def _turned(self, means: np.ndarray, weights: np.ndarray, name: str) -> Step:
        """Replaces the columns by sums of them; ``weights`` has a row for each new column."""
        old = list(self.columns)
        new = [f"{name}{i + 1}" for i in range(len(weights))]
        made = {n: sum((float(v) * (F.col(c) - float(m)) for v, c, m in zip(row, old, means)), F.lit(0.0)) for n, row in zip(new, weights)}
        self.columns = new
        return lambda df: df.withColumns(made).drop(*(c for c in old if c not in new))

    def _pca(self, df: DataFrame) -> Step:
        means, cov = self._moments(df)
        values, vectors = np.linalg.eigh(cov)
        values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
        shares = np.cumsum(values) / max(values.sum(), 1e-300)
        k = int(np.searchsorted(shares, self.share - 1e-12)) + 1
        self.learned["variance"] = (values / max(values.sum(), 1e-300)).tolist()
        vectors = vectors[:, :k] * np.sign(vectors[np.abs(vectors[:, :k]).argmax(axis=0), np.arange(k)])
        return self._turned(means, vectors.T, "pc")

    def _ica(self, df: DataFrame) -> Step:
        """The fixed point of the largest departures from normality of whitened columns (contrast log cosh): each round is one
        pass for the moments of all components, which are then made orthogonal together."""
        means, cov = self._moments(df)
        values, vectors = np.linalg.eigh(cov)
        there = values > 1e-12 * max(values.max(), 1e-300)
        white = (vectors[:, there] / np.sqrt(values[there])).T
        k = len(white)
        z = [sum((float(v) * (F.col(c) - float(m)) for v, c, m in zip(row, self.columns, means)), F.lit(0.0)) for row in white]
        told = df.select(*(c.alias(f"z{i}") for i, c in enumerate(z)))
        w = np.linalg.qr(np.random.default_rng(self.seed).normal(size=(k, k)))[0]
        for turn in range(self.rounds):
            g = [F.tanh(sum((float(w[a, i]) * F.col(f"z{i}") for i in range(k)), F.lit(0.0))) for a in range(k)]
            row = told.select("*", *(c.alias(f"g{a}") for a, c in enumerate(g))).agg(*(F.avg(F.col(f"z{i}") * F.col(f"g{a}")) for a in range(k) for i in range(k)), *(F.avg(1 - F.col(f"g{a}") * F.col(f"g{a}")) for a in range(k))).first()
            new = np.array(row[: k * k], float).reshape(k, k) - np.array(row[k * k :], float)[:, None] * w
            u, _, v = np.linalg.svd(new)
            new = u @ v
            moved = float(np.abs(np.abs((new * w).sum(axis=1)) - 1).max())
            w = new
            if moved < 1e-6:
                break
        self.learned["rounds"] = turn + 1
        return self._turned(means, w @ white, "ic")
