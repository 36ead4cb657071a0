"""Ordination and clustering of sites. Rows meet in Spark; what the driver solves is a matrix of variables by variables, or of
sites by sites where that is the method's own input, refused above ``MOST_SITES``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.measures import ratio
from tidewrack.lineage import settled
from tidewrack.operators.windows import running_total

MOST_SITES = 3000


def hellinger(table: DataFrame, site: str, x: str) -> Column:
    """Square root of a taxon's share of its site."""
    return F.sqrt(ratio(F.col(x), F.sum(x).over(Window.partitionBy(site))))


def _products(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, int]:
    """Centred sums of products of all columns, in one pass."""
    k = len(columns)
    row = df.na.drop(subset=list(columns)).agg(F.count("*"), *(F.sum(c) for c in columns), *(F.sum(F.col(a) * F.col(b)) for i, a in enumerate(columns) for b in columns[i:])).first()
    n, sums, m, at = row[0], np.array([v or 0.0 for v in row[1 : k + 1]], float), np.zeros((k, k)), k + 1
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[at] or 0.0
            at += 1
    return m - np.outer(sums, sums) / max(n, 1), n


def redundancy_analysis(df: DataFrame, ys: Sequence[str], xs: Sequence[str], conditions: Sequence[str] = ()) -> dict[str, float | list[float]]:
    """RDA of responses on predictors (less what conditions explain): inertia, constrained share, adjusted, axes.

    The fitted values' products are Sxy' Sxx^-1 Sxy, so that no row leaves the cluster.
    """
    s, n = _products(df, [*ys, *xs, *conditions])
    p, q = len(ys), len(xs)
    if conditions:
        a, b = s[: p + q, p + q :], np.linalg.pinv(s[p + q :, p + q :])
        s = s[: p + q, : p + q] - a @ b @ a.T
    total = float(np.trace(s[:p, :p]))
    fitted = s[:p, p : p + q] @ np.linalg.pinv(s[p : p + q, p : p + q]) @ s[p : p + q, :p]
    axes = np.clip(np.linalg.eigvalsh(fitted)[::-1], 0, None)
    r2 = float(np.trace(fitted)) / total if total else float("nan")
    rank, left = int(np.linalg.matrix_rank(s[p : p + q, p : p + q])), n - 1 - len(conditions)
    return {"inertia": total / max(n - 1, 1), "r2": r2, "r2_adjusted": 1 - (1 - r2) * left / max(left - rank, 1), "axes": [float(a) / max(n - 1, 1) for a in axes[: min(p, q)]], "f": (r2 / max(rank, 1)) / ((1 - r2) / max(left - rank, 1)) if r2 < 1 else float("inf")}


@dataclass
class Redundancy:
    """A fitted analysis: rows of responses less what conditions explain, regressed on predictors likewise."""

    ys: list[str]
    xs: list[str]
    conditions: list[str]
    n: int
    means: np.ndarray
    held: np.ndarray
    syy: np.ndarray
    sxx: np.ndarray
    sxy: np.ndarray
    axes: int

    @property
    def slopes(self) -> np.ndarray:
        return np.linalg.pinv(self.sxx) @ self.sxy

    @property
    def total(self) -> float:
        return float(np.trace(self.syy)) / (self.n - 1)

    def values(self, sxy: np.ndarray, xs: Sequence[int] | None = None) -> np.ndarray:
        """Variances along the axes, largest first, for cross products as these and some of the predictors."""
        own = list(range(len(self.xs))) if xs is None else list(xs)
        part = sxy[own]
        fitted = part.T @ np.linalg.pinv(self.sxx[np.ix_(own, own)]) @ part
        return np.clip(np.linalg.eigvalsh(fitted)[::-1], 0, None)[: self.axes] / (self.n - 1)

    def loadings(self) -> np.ndarray:
        """Responses by axes; of each axis the largest part is positive."""
        fitted = self.sxy.T @ self.slopes
        vectors = np.linalg.eigh(fitted)[1][:, ::-1][:, : self.axes]
        return vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])

    def f(self, values: np.ndarray) -> float:
        """Of the axes' variances."""
        left = self.n - len(self.xs) - 1
        rest = self.total - values.sum()
        return float(values.sum() / len(self.xs) / (rest / left)) if left > 0 and rest > 0 else float("nan")

    def residuals(self) -> dict[str, Column]:
        """Responses and predictors, centred and less what conditions explain, as columns."""
        names = [*self.ys, *self.xs]
        k = len(names)
        free = {c: F.col(c) - float(m) for c, m in zip([*names, *self.conditions], self.means)}
        return {c: free[c] - sum((float(self.held[i, j]) * free[v] for j, v in enumerate(self.conditions)), F.lit(0.0)) for i, c in enumerate(names[:k])}


def redundancy(df: DataFrame, ys: Sequence[str], xs: Sequence[str], conditions: Sequence[str] = (), axes: int = 2) -> Redundancy:
    """One pass for all products; rows with a missing value are left out."""
    every = [*ys, *xs, *conditions]
    s, n = _products(df, every)
    means = df.na.drop(subset=every).agg(*(F.avg(c) for c in every)).first()
    k = len(ys) + len(xs)
    held = s[:k, k:] @ np.linalg.pinv(s[k:, k:]) if conditions else np.zeros((k, 0))
    s = s[:k, :k] - held @ s[k:, :k]
    p = len(ys)
    return Redundancy(list(ys), list(xs), list(conditions), n, np.array(means, float), held, s[:p, :p], s[p:, p:], s[p:, :p], min(axes, p, len(xs)))


def redundancy_scores(df: DataFrame, fit: Redundancy) -> DataFrame:
    """``df`` with rda1, rda2...: where each row's fitted responses lie on the axes."""
    free = fit.residuals()
    weights = fit.slopes @ fit.loadings()
    scores = {f"rda{a + 1}": sum((float(weights[i, a]) * free[x] for i, x in enumerate(fit.xs)), F.lit(0.0)) for a in range(fit.axes)}
    return df.na.drop(subset=[*fit.ys, *fit.xs, *fit.conditions]).withColumns(scores)


def biplot(scores: np.ndarray, loadings: np.ndarray, values: np.ndarray, scaling: str = "none", convention: str = "current") -> tuple[np.ndarray, np.ndarray]:
    """Scores and loadings stretched by the roots of the axes' variances, by either convention."""
    root = np.sqrt(values)
    told = {("current", "scaling1"): (scores / root, loadings * root), ("current", "scaling2"): (scores, loadings * root), ("vegan", "scaling1"): (scores, loadings), ("vegan", "scaling2"): (scores / root, loadings * root)}
    if scaling == "none":
        return scores, loadings
    if (convention, scaling) not in told:
        raise ValueError(f"no biplot of {scaling} by {convention}")
    return told[convention, scaling]


def associations(df: DataFrame, xs: Sequence[str], axes: Sequence[str], method: str = "pearson") -> DataFrame:
    """(variable, axis, value): correlation of values or of their ranks, or slope of the axis on the variable."""
    if method == "spearman":
        df = settled(df.select(*dict.fromkeys([*xs, *axes])))  # rows meet their ranks by value: both must see the same one
        for c in df.columns:
            df = df.join(middle_ranks(df, c, f"{c}__rank"), c).drop(c).withColumnRenamed(f"{c}__rank", c)
    elif method not in ("pearson", "regression"):
        raise ValueError(f"method is pearson, spearman or regression, not {method}")
    made = [(F.regr_slope(a, x) if method == "regression" else F.corr(x, a)).alias(f"{x}|{a}") for x in xs for a in axes]
    told = df.agg(*made).withColumn("__", F.lit(0)).unpivot(["__"], [f"{x}|{a}" for x in xs for a in axes], "pair", "value")
    return told.select(F.split("pair", r"\|")[0].alias("variable"), F.split("pair", r"\|")[1].alias("axis"), "value")


def middle_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): the mean rank of each distinct value, from running totals over ranges."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n__"))
    return running_total(counts, column, "n__", "upto__").select(column, (F.col("upto__") - (F.col("n__") - 1) / 2).alias(name))


#: Rows that are shuffled among themselves; a smaller table is one such part.
SWAPPED = 4096


def redundancy_permutations(df: DataFrame, fit: Redundancy, ids: Sequence[str], n_perm: int = 999, seed: int = 0) -> dict[str, list]:
    """Statistics of the responses' rows shuffled against the predictors': ``global`` (F and p), ``axes`` (variance and p of
    each) and ``terms`` (what each predictor adds to the axes' variance, and p).

    Rows are dealt to parts of about ``SWAPPED`` by a hash of their ids and shuffled within them, so that no row is
    copied for a permutation; a part's answer is its cross products for every permutation, and parts are added up.
    """
    every = [*fit.ys, *fit.xs, *fit.conditions]
    rows = df.na.drop(subset=every)
    parts = max(1, -(-fit.n // SWAPPED))
    free = fit.residuals()
    told = rows.select(F.pmod(F.xxhash64(*ids), F.lit(parts)).alias("part"), F.xxhash64(F.lit(seed), *ids).alias("at"), *(free[c].alias(f"y{i}") for i, c in enumerate(fit.ys)), *(free[c].alias(f"x{i}") for i, c in enumerate(fit.xs)))
    p, q = len(fit.ys), len(fit.xs)

    def shuffle(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("at", kind="stable")
        y, x = own[[f"y{i}" for i in range(p)]].to_numpy(float), own[[f"x{i}" for i in range(q)]].to_numpy(float)
        rng = np.random.default_rng([seed, int(own["part"].iloc[0])])
        made = [(k, (x.T @ (y if not k else y[rng.permutation(len(y))])).ravel()) for k in range(n_perm + 1)]
        return pd.DataFrame({"perm": [k for k, _ in made], **{f"c{i}": [m[i] for _, m in made] for i in range(p * q)}})

    fields = ", ".join(["perm int", *(f"c{i} double" for i in range(p * q))])
    sums = told.groupBy("part").applyInPandas(shuffle, fields).groupBy("perm").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(p * q)))
    drawn = {r["perm"]: np.array(r[1:], float).reshape(q, p) for r in sums.collect()}  # predictors by responses, for each permutation
    share = lambda many, one: float((np.sum(np.asarray(many) >= one - 1e-12 * abs(one)) + 1) / (n_perm + 1))
    values = [fit.values(drawn[k]) for k in range(n_perm + 1)]
    fs = [fit.f(v) for v in values]
    less = [[fit.values(drawn[k], [j for j in range(q) if j != t]).sum() if q > 1 else 0.0 for t in range(q)] for k in range(n_perm + 1)]
    added = [[values[k].sum() - less[k][t] for t in range(q)] for k in range(n_perm + 1)]
    return {
        "global": [(fs[0], share(fs[1:], fs[0]))],
        "axes": [(float(values[0][a]), share([v[a] for v in values[1:]], values[0][a])) for a in range(fit.axes)],
        "terms": [(float(added[0][t]), share([r[t] for r in added[1:]], added[0][t])) for t in range(q)],
    }


def correspondence_axes(table: DataFrame, environment: DataFrame, site: str, taxon: str, x: str, xs: Sequence[str]) -> dict[str, float | list[float]]:
    """CCA of a long community table on environment columns of its sites: total and constrained inertia and the axes.

    Total inertia is the sum of x^2 / (row total * column total) less 1. The constrained part regresses each taxon's
    weighted profile on the weighted, centred variables; its products are sums over cells, taxa by variables.
    """
    cells = table.groupBy(site, taxon).agg(F.sum(x).alias("x")).where("x > 0")
    all_ = cells.agg(F.sum("x").alias("t"))
    rows, columns = cells.groupBy(site).agg(F.sum("x").alias("r")), cells.groupBy(taxon).agg(F.sum("x").alias("c"))
    told = cells.join(rows, site).join(columns, taxon).crossJoin(F.broadcast(all_)).join(environment.select(site, *xs), site)  # all_ is one row
    inertia = told.agg(F.sum(F.col("x") * F.col("x") / (F.col("r") * F.col("c"))) - 1).first()[0]
    sites = rows.crossJoin(F.broadcast(all_)).join(environment.select(site, *xs), site).withColumn("w", F.col("r") / F.col("t"))
    m = sites.agg(*(F.sum(F.col("w") * F.col(v)).alias(v) for v in xs)).first()
    centred = {v: F.col(v) - float(m[v]) for v in xs}
    k = len(xs)
    flat = sites.agg(*(F.sum(F.col("w") * centred[a] * centred[b]) for a in xs for b in xs)).first()
    sxx = np.array(flat, float).reshape(k, k)
    # per taxon: sum over sites of (p_ij / sqrt(c_j) - r_i sqrt(c_j)) * x_i = (sum p_ij x_i) / sqrt(c_j), since x is centred by r
    taxa = told.groupBy(taxon).agg(*(F.sum(F.col("x") / F.col("t") * centred[v]).alias(v) for v in xs), F.first("c").alias("c"), F.first("t").alias("t"))
    flat = taxa.agg(*(F.sum(F.col(a) * F.col(b) / (F.col("c") / F.col("t"))) for a in xs for b in xs)).first()
    axes = np.linalg.eigvals(np.linalg.pinv(sxx) @ np.array(flat, float).reshape(k, k)).real
    axes = np.sort(np.clip(axes, 0, None))[::-1]
    return {"inertia": float(inertia), "constrained": float(axes.sum()), "axes": [float(a) for a in axes]}


def correspondence_scores(table: DataFrame, environment: DataFrame, site: str, taxon: str, x: str, xs: Sequence[str], axes: int = 2) -> tuple[DataFrame, DataFrame, list[float], list[tuple]]:
    """(site scores, taxon scores, the axes' inertia, loadings) of a CCA. Site scores are weighted sums of the environment
    (linear constraints), of unit variance under the sites' weights; a taxon's are in proportion to the mean of those
    of its sites; loadings are weighted correlations of variables with the axes. Of each axis the largest loading is positive.
    """
    cells = table.groupBy(site, taxon).agg(F.sum(x).alias("x")).where("x > 0")
    env = environment.select(site, *(F.col(v).cast("double").alias(f"e{i}") for i, v in enumerate(xs))).na.drop()
    k, total = len(xs), cells.join(env, site, "left_semi").agg(F.sum("x")).first()[0]
    sites = cells.groupBy(site).agg((F.sum("x") / total).alias("r")).join(env, site)
    row = sites.agg(*(F.sum(F.col("r") * F.col(f"e{i}")) for i in range(k)), *(F.sum(F.col("r") * F.col(f"e{i}") * F.col(f"e{j}")) for i in range(k) for j in range(k))).first()
    mean = np.array(row[:k], float)
    sxx = np.array(row[k:], float).reshape(k, k) - np.outer(mean, mean)
    told = cells.join(env, site)
    taxa = told.groupBy(taxon).agg((F.sum("x") / total).alias("c"), *(F.sum(F.col("x") / total * (F.col(f"e{i}") - float(mean[i]))).alias(f"s{i}") for i in range(k)))
    flat = taxa.agg(*(F.sum(F.col(f"s{i}") * F.col(f"s{j}") / F.col("c")) for i in range(k) for j in range(k))).first()
    values, vectors = np.linalg.eigh(sxx)
    good = values > 1e-12 * values.max()
    root = vectors[:, good] / np.sqrt(values[good]) @ vectors[:, good].T
    inertia, turned = np.linalg.eigh(root @ np.array(flat, float).reshape(k, k) @ root)
    inertia, turned = np.clip(inertia[::-1], 0, None)[:axes], turned[:, ::-1][:, :axes]
    weights = root @ turned
    loadings = np.diag(1 / np.sqrt(np.maximum(np.diag(sxx), 1e-300))) @ sxx @ weights
    sign = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])])
    weights, loadings = weights * sign, loadings * sign
    lc = [sum((float(w) * (F.col(f"e{i}") - float(mean[i])) for i, w in enumerate(weights[:, a])), F.lit(0.0)).alias(f"cca{a + 1}") for a in range(weights.shape[1])]
    species = [(sum((float(w) * F.col(f"s{i}") for i, w in enumerate(weights[:, a])), F.lit(0.0)) / F.col("c") / float(max(np.sqrt(inertia[a]), 1e-150))).alias(f"cca{a + 1}") for a in range(weights.shape[1])]
    return sites.select(site, "r", *lc), taxa.select(taxon, "c", *species), [float(v) for v in inertia], [(v, *map(float, row)) for v, row in zip(xs, loadings)]


def _square(pairs: DataFrame) -> tuple[list, np.ndarray]:
    """A distance table as names and matrix."""
    many = pairs.select(F.col("i").alias("s")).union(pairs.select("j")).distinct()
    names = sorted(r["s"] for r in many.limit(MOST_SITES + 1).collect())
    if len(names) > MOST_SITES:
        raise ValueError(f"more than {MOST_SITES} sites; aggregate them first")
    place = {s: k for k, s in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    for i, j, v in pairs.select("i", "j", "d").toPandas().itertuples(index=False):
        d[place[i], place[j]] = d[place[j], place[i]] = v
    return names, d


def linkage(pairs: DataFrame, method: str = "average") -> DataFrame:
    """(step, a, b, height, size): merges of hierarchical clustering, clusters named by their first site."""
    names, d = _square(pairs)
    d = d.copy()
    np.fill_diagonal(d, np.inf)
    size, rows = np.ones(len(names)), []
    for step in range(len(names) - 1):
        i, j = sorted(divmod(int(d.argmin()), len(names)))
        rows.append((step, names[i], names[j], float(d[i, j]), int(size[i] + size[j])))
        new = np.maximum(d[i], d[j]) if method == "complete" else (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i], d[i, i] = new, new, np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
    return pairs.sparkSession.createDataFrame(rows, "step int, a string, b string, height double, size int")


def nonmetric_scaling(pairs: DataFrame, starts: int = 4, rounds: int = 200, seed: int = 0) -> tuple[DataFrame, float]:
    """(site, x, y) whose distances keep the order of the given ones as well as they can, and the stress."""
    names, d = _square(pairs)
    n, upper = len(names), np.triu_indices(len(names), 1)
    order = np.argsort(d[upper], kind="stable")
    best, least = np.zeros((n, 2)), np.inf
    for start in range(starts):
        p, stress = np.random.default_rng([seed, start]).normal(size=(n, 2)), np.inf
        for _ in range(rounds):
            e = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
            got = e[upper]
            fit = np.empty_like(got)
            fit[order] = _rising(got[order])
            fit *= np.sqrt((got**2).sum() / max((fit**2).sum(), 1e-300))
            now = np.sqrt(((got - fit) ** 2).sum() / max((got**2).sum(), 1e-300))
            if stress - now < 1e-7:
                break
            stress = now
            b = np.zeros((n, n))
            b[upper] = np.divide(-fit, got, out=np.zeros_like(got), where=got > 0)
            b += b.T
            np.fill_diagonal(b, -b.sum(1))
            p = b @ p / n
        if stress < least:
            best, least = p, stress
    rows = [(s, float(a), float(b)) for s, (a, b) in zip(names, best)]
    return pairs.sparkSession.createDataFrame(rows, "site string, x double, y double"), float(least)


def _rising(values: np.ndarray) -> np.ndarray:
    """The nearest sequence that doesn't fall, by pooling neighbours that do."""
    means, counts = [], []
    for v in values:
        means.append(float(v))
        counts.append(1)
        while len(means) > 1 and means[-2] > means[-1]:
            m, c = means.pop(), counts.pop()
            means[-1] = (means[-1] * counts[-1] + m * c) / (counts[-1] + c)
            counts[-1] += c
    return np.repeat(means, counts)


def k_prototypes(df: DataFrame, numbers: Sequence[str], categories: Sequence[str], k: int, gamma: float = 0.5, rounds: int = 10) -> DataFrame:
    """``df`` with ``cluster``: nearest prototype by squared distance plus ``gamma`` for each category that differs.

    Prototypes are means and most frequent values per cluster, new in each round; k rows reach the driver. The first
    ones are the rows at k quantiles of a hash.
    """
    told = df.na.drop(subset=[*numbers, *categories])
    seeds = told.orderBy(F.xxhash64(*numbers, *categories), *numbers, *categories).select(*numbers, *categories).limit(k).collect()
    centres = [tuple(r) for r in seeds]

    def assigned() -> DataFrame:
        costs = []
        for c in centres:
            far = [F.pow(F.col(v) - float(c[i]), F.lit(2.0)) for i, v in enumerate(numbers)]
            other = [F.when(F.col(v) == c[len(numbers) + i], 0.0).otherwise(gamma) for i, v in enumerate(categories)]
            costs.append(sum([*far, *other], F.lit(0.0)))
        return told.withColumn("cluster", F.array_position(F.array(*costs), F.array_min(F.array(*costs))).cast("int"))

    for _ in range(rounds):
        rows = assigned().groupBy("cluster").agg(*(F.avg(v).alias(v) for v in numbers), *(F.mode(v, True).alias(v) for v in categories)).orderBy("cluster").collect()
        new = list(centres)
        for r in rows:
            new[r["cluster"] - 1] = tuple(r[v] for v in (*numbers, *categories))
        if new == centres:
            break
        centres = new
    return assigned()
