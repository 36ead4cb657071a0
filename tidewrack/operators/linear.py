"""Linear models of factors and covariates: tables of variance of types I to III, selection of terms, and errors that
allow for correlation along an order.

Rows are summed up once, by cell (a combination of levels): the number of rows and sums of products of the covariates
and the response. Any model of these factors and covariates, under any coding, has its normal equations in the cells'
sums, so that reduced models take no further pass. Cells are as many as combinations of levels that occur.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.special import f_upper, t_two_sided
from tidewrack.operators.statistics import Fit, least_squares
from tidewrack.operators.windows import running_total

#: More cells than these are refused: the driver holds a small matrix of sums for each.
MOST_CELLS = 100_000
#: A column is taken as a combination of others below this share of its own sum of squares.
TIED = 1e-9

Term = tuple[str, ...]


@dataclass
class Cells:
    """Sums by combination of levels. ``products`` has a matrix for each cell: of one, the covariates and the response."""

    levels: dict[str, list]
    covariates: list[str]
    codes: np.ndarray
    products: np.ndarray

    @property
    def n(self) -> int:
        return int(self.products[:, 0, 0].sum())

    def columns(self, terms: Sequence[Term], coding: str) -> tuple[list[int], np.ndarray, list[int]]:
        """For each column of the design: which term it belongs to (-1: the constant), its code in every cell, and the
        covariate it is times (0: none)."""
        of, codes, times = [-1], [np.ones(len(self.codes))], [0]
        for k, term in enumerate(terms):
            own, covariate = [np.ones(len(self.codes))], 0
            for name in term:
                if name in self.levels:
                    at, count = self.codes[:, list(self.levels).index(name)], len(self.levels[name])
                    if coding == "sum":
                        made = [(at == j).astype(float) - (at == count - 1) for j in range(count - 1)]
                    else:
                        made = [(at == j).astype(float) for j in range(1, count)]
                    own = [a * b for a in own for b in made]
                else:
                    covariate = 1 + self.covariates.index(name)
            of += [k] * len(own)
            codes += own
            times += [covariate] * len(own)
        return of, np.array(codes), times

    def equations(self, terms: Sequence[Term], coding: str) -> tuple[list[int], np.ndarray]:
        """The term of each column, and the sums of products of all columns and the response, which is last."""
        of, codes, times = self.columns(terms, coding)
        codes, times = np.vstack([codes, np.ones(len(self.codes))]), [*times, len(self.covariates) + 1]
        gram = np.einsum("ic,jc,cij->ij", codes, codes, self.products[:, times][:, :, times])
        return of, gram


def cells(df: DataFrame, factors: Sequence[str], covariates: Sequence[str], y: str) -> Cells:
    """One pass over rows that have all of these columns; factors of one level and covariates that don't vary are left out."""
    told = df.select(*factors, *(F.col(c).cast("double").alias(c) for c in (*covariates, y))).na.drop()
    named = [*covariates, y]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(named)]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(named) for j, b in enumerate(named) if i <= j]
    made = told.groupBy(*factors).agg(F.count("*").alias("n"), *sums).where("n > 0")
    rows = (made.orderBy(*factors) if factors else made).limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} combinations of levels")
    k = len(named)
    products = np.zeros((len(rows), k + 1, k + 1))
    for r, row in enumerate(rows):
        products[r, 0, 0] = row["n"]
        for i in range(k):
            products[r, 0, i + 1] = products[r, i + 1, 0] = row[f"s{i}"] or 0.0
            for j in range(i, k):
                products[r, i + 1, j + 1] = products[r, j + 1, i + 1] = row[f"p{i}_{j}"] or 0.0
    levels = {f: sorted({row[f] for row in rows}) for f in factors}
    varied = {f: v for f, v in levels.items() if len(v) > 1}
    whole = products.sum(axis=0) if len(rows) else np.zeros((k + 1, k + 1))
    moving = [i for i in range(len(covariates)) if whole[i + 1, i + 1] * whole[0, 0] - whole[0, i + 1] ** 2 > TIED * max(whole[i + 1, i + 1] * whole[0, 0], 1e-300)]
    kept = [0, *(i + 1 for i in moving), k]
    codes = np.array([[varied[f].index(row[f]) for f in varied] for row in rows]).reshape(len(rows), len(varied))
    return Cells(varied, [covariates[i] for i in moving], codes, products[:, kept][:, :, kept])


def swept(m: np.ndarray, k: int, least: float) -> bool:
    """Sweeps a symmetric matrix on a pivot, in place: the column joins the model. False, and nothing done, where what is
    left of it is below ``least``: it is a combination of others."""
    pivot = m[k, k]
    if pivot <= least:
        return False
    row = m[k] / pivot
    m -= np.outer(m[:, k], row)
    m[k], m[:, k] = row, row
    m[k, k] = -1 / pivot
    return True


def residual(of: Sequence[int], gram: np.ndarray, terms: Sequence[int]) -> tuple[float, int]:
    """Sum of squared residuals and rank of the model of the constant and some terms."""
    m, rank = gram.copy(), 0
    for k, own in enumerate(of):
        if own == -1 or own in terms:
            rank += swept(m, k, TIED * gram[k, k])
    return max(0.0, float(m[-1, -1])), rank


@dataclass
class Effect:
    term: str
    df: int
    ss: float
    f: float
    p: float
    eta2: float


def _name(term: Term) -> str:
    return ":".join(term)


def anova(data: Cells, terms: Sequence[Term], kind: int) -> list[Effect]:
    """Effects and, last, the residual.

    Type I adds terms in their order; type II adds each to all terms that don't contain it; type III leaves each out of
    the full model under sum-to-zero codes. F is against the full model's residual; eta2 is partial.
    """
    of, gram = data.equations(terms, "sum" if kind == 3 else "treatment")
    every = range(len(terms))
    full, rank = residual(of, gram, every)
    left = data.n - rank
    out = []
    for k, term in enumerate(terms):
        if kind == 1:
            less, more = residual(of, gram, range(k)), residual(of, gram, range(k + 1))
        elif kind == 2:
            others = [j for j in every if j != k and not set(term) < set(terms[j])]
            less, more = residual(of, gram, others), residual(of, gram, [*others, k])
        else:
            less, more = residual(of, gram, [j for j in every if j != k]), (full, rank)
        ss, d = max(0.0, less[0] - more[0]), more[1] - less[1]
        f = ss / d / (full / left) if d and left > 0 and full > 0 else math.nan
        out.append(Effect(_name(term), d, ss, f, f_upper(f, d, left) if not math.isnan(f) else math.nan, ss / (ss + full) if ss + full else math.nan))
    return [*out, Effect("residual", left, full, math.nan, math.nan, math.nan)]


def terms_of(data: Cells, interactions: str = "fxc") -> tuple[list[Term], list[Term]]:
    """(main effects, interactions of factors with covariates, and for ``fxf`` also of factors)."""
    factors = list(data.levels)
    mains = [(f,) for f in factors] + [(c,) for c in data.covariates]
    crossed = [(f, c) for f in factors for c in data.covariates]
    if interactions == "fxf":
        crossed += [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    return mains, crossed


def with_interactions_if_any(data: Cells, mains: Sequence[Term], crossed: Sequence[Term], kind: int = 3, p: float = 0.05) -> tuple[list[Term], list[Term]]:
    """(the model, its significant interactions): the full model if one of its interactions is below ``p``, else the mains."""
    every = [*mains, *crossed]
    told = {e.term: e.p for e in anova(data, every, kind)}
    found = [t for t in crossed if told[_name(t)] < p]
    return (every if found else list(mains)), found


def backward(data: Cells, terms: Sequence[Term], protected: Sequence[Term] = (), p: float = 0.05, kind: int = 3) -> list[Term]:
    """Terms left when the least significant goes until all are below ``p``; protected ones and their parts stay."""
    left = list(terms)
    stay = set(protected) | {(name,) for t in protected for name in t}
    while len(left) > 1:
        told = {e.term: e.p for e in anova(data, left, kind)}
        free = [t for t in left if t not in stay and not math.isnan(told[_name(t)])]
        worst = max(free, key=lambda t: told[_name(t)], default=None)
        if worst is None or told[_name(worst)] <= p:
            break
        left.remove(worst)
    return left


def _scores(data: Cells, terms: Sequence[Term], by: str) -> float:
    of, gram = data.equations(terms, "treatment")
    rss, rank = residual(of, gram, range(len(terms)))
    n = data.n
    return n * (math.log(2 * math.pi * max(rss, 1e-300) / n) + 1) + (2 if by == "aic" else math.log(n)) * rank


def term_inflation(data: Cells, terms: Sequence[Term], coding: str = "sum") -> dict[Term, float]:
    """The largest variance inflation of each term's columns, among all columns and the constant."""
    of, gram = data.equations(terms, coding)
    k, xx = len(of), gram[:-1, :-1]
    told: dict[Term, float] = {}
    mean = xx[0] / xx[0, 0]
    for j in range(1, k):
        m = xx.copy()
        for i in range(k):
            if i != j:
                swept(m, i, TIED * xx[i, i])
        around = xx[j, j] - mean[j] ** 2 * xx[0, 0]
        own = around / m[j, j] if m[j, j] > TIED * max(around, 1e-300) else math.inf
        told[terms[of[j]]] = max(told.get(terms[of[j]], 0.0), own)
    return told


def backward_by_criterion(data: Cells, mains: Sequence[Term], crossed: Sequence[Term], by: str = "aic", most_inflation: float | None = None, release: bool = False, tolerance: float = 1e-9) -> list[Term]:
    """Terms left when each step drops the one that lowers the criterion most.

    A main effect can go once no interaction contains it. With ``most_inflation``, terms above it are the only
    candidates while there are some, interactions first; and where no removal lowers the criterion, the term of largest
    inflation goes, or with ``release`` the interaction that keeps it.
    """
    left = [*mains, *crossed]

    def held(t: Term) -> bool:
        return len(t) == 1 and any(len(o) > 1 and t[0] in o for o in left)

    while left:
        now, candidates = _scores(data, left, by), [t for t in crossed if t in left] + [t for t in mains if t in left and not held(t)]
        inflation = term_inflation(data, left) if most_inflation is not None else {}
        above = sorted((t for t in left if inflation.get(t, 0.0) > (most_inflation or math.inf)), key=lambda t: (len(t) < 2, -inflation[t]))
        offenders = [t for t in above if release or not held(t)]
        lowered = [(_scores(data, [o for o in left if o != t], by), t) for t in (offenders or candidates)]
        best = min(lowered, key=lambda r: r[0], default=(math.inf, None))
        if best[1] is not None and best[0] < now - tolerance:
            left.remove(best[1])
            continue
        if not above:
            break
        worst = max(above, key=lambda t: inflation[t])
        if not held(worst):
            left.remove(worst)
            continue
        keeps = [t for t in left if len(t) > 1 and worst[0] in t]
        if not release or not keeps:
            break
        left.remove(max(keeps, key=lambda t: inflation[t]))
    return left


def forward(data: Cells, candidates: Sequence[str], most: int = 6, p_enter: float = 0.05) -> list[tuple[str, float]]:
    """(covariate, p when it entered): each step adds the one of least p, while that is below ``p_enter``."""
    chosen: list[tuple[str, float]] = []
    left = [c for c in candidates if c in data.covariates]
    while left and len(chosen) < most:
        told = []
        for c in left:
            terms = [(v,) for v, _ in chosen] + [(c,)]
            of, gram = data.equations(terms, "treatment")
            (less, rank), (more, both) = residual(of, gram, range(len(terms) - 1)), residual(of, gram, range(len(terms)))
            d = data.n - both
            if both > rank and d > 0:
                told.append((t_two_sided(math.sqrt(max(0.0, less - more) / max(more / d, 1e-300)), d), c))
        if not told or min(told)[0] >= p_enter:
            break
        p, c = min(told)
        chosen.append((c, p))
        left.remove(c)
    return chosen


def scaled(df: DataFrame, columns: Sequence[str], mode: str) -> DataFrame:
    """``df`` with covariates as they are (``none``), less their mean (``mean``), also over their deviation (``zscore``, zero
    where that is zero), or as log(1 + x), shifted by one less the minimum where a value is at or below -1 (``log``)."""
    if mode == "none":
        return df
    told = df.agg(*(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s"), F.min(c).alias("low")).alias(c) for c in columns)).first()
    made = {}
    for c in columns:
        m, s, low = told[c]
        if m is None:
            continue
        if mode == "log":
            made[c] = F.log1p(F.col(c) + (1 - low if low <= -1 else 0.0))
        elif mode == "mean":
            made[c] = F.col(c) - m
        elif mode == "zscore":
            made[c] = (F.col(c) - m) / s if s else F.col(c) * 0.0
        else:
            raise ValueError(f"mode is none, mean, zscore or log, not {mode}")
    return df.withColumns(made)


def lag_rule(n: int, rule: Callable[[float], float] = round) -> int:
    """Lags to allow for: 4 (n / 100)^(2/9), rounded or floored, at least one."""
    return max(1, int(rule(4 * (n / 100) ** (2 / 9))))


#: Rows of a piece of the order; it is longer than the lags, so that the piece before is all that a piece needs.
PIECE = 100_000


def autocorrelated(df: DataFrame, terms: dict[str, Column], y: str, order: str, lags: int | None = None, rule: Callable[[float], float] = round) -> Fit:
    """Least squares with errors for correlation up to ``lags`` along distinct values of ``order`` (Newey and West).

    Rows are numbered over ranges and cut into pieces, each with the last rows of the piece before. All lags are one
    pass: their weights fall along a line, so that a row's weighted sum of those before it comes from two moving sums.
    """
    fit = least_squares(df, terms, y)
    lags = lag_rule(fit.n, rule) if lags is None else lags
    xs = [c.cast("double") for c in terms.values()]
    told = df.select(F.col(order).alias("o__"), F.col(y).cast("double").alias("y__"), *(c.alias(f"x{i}") for i, c in enumerate(xs))).na.drop()
    rest = F.col("y__") - sum((float(b) * F.col(f"x{i}") for i, b in enumerate(fit.coefficients)), F.lit(0.0))
    told = told.select("o__", *((F.col(f"x{i}") * rest).alias(f"u{i}") for i in range(len(xs))), F.lit(1).alias("one"))
    told = running_total(told, "o__", "one", "t").drop("one", "o__")
    piece = max(PIECE, lags)
    # the last rows of a piece are there twice: as its own, and as what comes before the next
    at = F.floor((F.col("t") - 1) / piece)
    ends = F.pmod(F.col("t") - 1, F.lit(piece)) >= piece - lags
    copies = F.explode(F.when(ends, F.array(F.struct(at.alias("piece"), F.lit(True).alias("own")), F.struct((at + 1).alias("piece"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(at.alias("piece"), F.lit(True).alias("own")))))
    told = told.withColumn("copy", copies).select("copy.piece", "copy.own", (F.col("t") - F.col("copy.piece") * piece).alias("t"), *(f"u{i}" for i in range(len(xs))))
    before = Window.partitionBy("piece").orderBy("t").rowsBetween(-lags, -1)
    drawn = [
        F.coalesce(F.sum(f"u{i}").over(before), F.lit(0.0)) - (F.col("t") * F.coalesce(F.sum(f"u{i}").over(before), F.lit(0.0)) - F.coalesce(F.sum(F.col("t") * F.col(f"u{i}")).over(before), F.lit(0.0))) / (lags + 1)
        for i in range(len(xs))
    ]
    told = told.withColumns({f"v{i}": c for i, c in enumerate(drawn)}).where("own")
    k = len(xs)
    row = told.agg(*(F.sum(F.col(f"u{i}") * F.col(f"u{j}") + F.col(f"u{i}") * F.col(f"v{j}") + F.col(f"v{i}") * F.col(f"u{j}")) for i in range(k) for j in range(k))).first()
    inverse = fit.covariance * max(1, fit.n - k) / fit.rss if fit.rss else fit.covariance
    return Fit(fit.terms, fit.coefficients, inverse @ np.array(row, float).reshape(k, k) @ inverse, fit.n, fit.rss, fit.tss)
