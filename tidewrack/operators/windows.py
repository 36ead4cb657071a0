"""Windows: shares, cumulative shares, scaling, outliers, gaps. Windows run inside a key, never over a whole large table;
totals over all rows are one-row aggregates that are broadcast."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.measures import ratio


def moving_average(value: str, keys: Sequence[str], order: str, n: int) -> Column:
    """Mean of the last n rows, null until there are n values."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(w) == n, F.avg(value).over(w))


def lagged(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """The value before, rows without one left out."""
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(order))).where(F.col(name).isNotNull())


def share_of(value: str, keys: Sequence[str]) -> Column:
    """A value's share of its key's total."""
    return ratio(F.col(value), F.sum(value).over(Window.partitionBy(*keys)))


def cumulative_share(value: str, tie: str, keys: Sequence[str]) -> Column:
    """Running share of the key's total, largest value first."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), tie).rowsBetween(Window.unboundedPreceding, 0)
    return ratio(F.sum(value).over(w), F.sum(value).over(Window.partitionBy(*keys)))


def top_share(df: DataFrame, keys: Sequence[str], taxon: str, value: str, threshold: float, crossing: bool) -> DataFrame:
    """Taxa that make up a share of their key's total, the taxon that crosses it included or not."""
    told = df.groupBy(*keys, taxon).agg(F.sum(value).alias("total")).withColumn("cumulative", cumulative_share("total", taxon, keys)).withColumn("share", share_of("total", keys))
    within = F.col("cumulative") - F.col("share") < threshold if crossing else F.col("cumulative") <= threshold + 1e-12
    return told.where(within)


def top_share_of_two(df: DataFrame, keys: Sequence[str], taxon: str, first: str, second: str) -> DataFrame:
    """Cumulative percent of two values in the order of the first."""
    told = df.groupBy(*keys, taxon).agg(F.sum(first).alias("a"), F.sum(second).alias("b"))
    w, whole = Window.partitionBy(*keys).orderBy(F.desc("a"), taxon).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    return told.select(*keys, taxon, *((100 * ratio(F.sum(c).over(w), F.sum(c).over(whole))).alias(f"cumulative_{n}") for c, n in (("a", first), ("b", second))))


def imputed(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Nulls by the key's mean, or the mean of all rows where a key has none."""
    own = df.groupBy(*keys).agg(F.avg(value).alias("own_mean"))
    every = df.agg(F.avg(value).alias("all_mean"))
    filled = df.join(own, list(keys), "left").crossJoin(F.broadcast(every))  # one row
    return filled.withColumn(value, F.coalesce(value, "own_mean", "all_mean")).drop("own_mean", "all_mean")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key, numbered."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= n)


def min_max(value: str, keys: Sequence[str]) -> Column:
    """Scaled to 0..1 inside the key, 0 where the key is constant."""
    w = Window.partitionBy(*keys)
    return F.coalesce(ratio(F.col(value) - F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w)), F.lit(0.0))


def centred(value: str, keys: Sequence[str]) -> Column:
    return F.col(value) - F.avg(value).over(Window.partitionBy(*keys))


def z_score(value: str, keys: Sequence[str], constant: float | None = 0.0) -> Column:
    """Standardised by the population deviation; ``constant`` where there is none."""
    w = Window.partitionBy(*keys)
    z = ratio(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w))
    return z if constant is None else F.when(F.col(value).isNotNull(), F.coalesce(z, F.lit(constant)))


def counted_upto(df: DataFrame, keys: Sequence[str], value: str, parts: int = 200) -> DataFrame:
    """(keys..., value, t, upto, n): rows of each distinct value of a key, rows up to it, and all of the key's rows.

    Values are dealt to ranges and counted there; ranges go on from those before. So a key of any size is many tasks.
    """
    v = df.where(F.col(value).isNotNull()).select(*keys, value)
    cuts = v.agg(F.percentile_approx(F.col(value).cast("double"), F.array(*(F.lit(i / parts) for i in range(1, parts))), F.lit(1000))).first()[0] or []  # a number for each range
    counted = v.groupBy(*keys, value).agg(F.count("*").alias("t"))
    splits = [-math.inf, *sorted({c for c in cuts if math.isfinite(c)}), math.inf]
    dealt = Bucketizer(splits=splits, inputCol="at__", outputCol="part__").transform(counted.withColumn("at__", F.col(value).cast("double"))).drop("at__")
    names = [f"key{i}__" for i in range(len(keys))]  # null keys meet too
    sums = dealt.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col("part__").alias("at__")).agg(F.sum("t").alias("own__"))
    ahead = Window.partitionBy(*names).orderBy("at__")  # a row for each range
    starts = sums.select(*names, "at__", (F.sum("own__").over(ahead) - F.col("own__")).alias("before__"), F.sum("own__").over(Window.partitionBy(*names)).alias("n"))
    inside = F.sum("t").over(Window.partitionBy(*keys, "part__").orderBy(value))
    same = F.col("part__") == F.col("at__")
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return dealt.withColumn("upto", inside).join(starts, same).withColumn("upto", F.col("upto") + F.col("before__")).select(*keys, value, "t", "upto", "n")


#: Rank error of the sketch that tells where a quantile lies, as a share of a key's rows.
SKETCH = 1 / 5000


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], name: str = "q") -> DataFrame:
    """(keys..., name): exact quantiles of each key by linear interpolation, as an array.

    A sketch with a bound on its error tells between which values each quantile lies. A second pass counts what is below
    and keeps only distinct values in between, a few ten-thousandths of a key's rows, whose ranks are then exact.
    """
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("own__"))
    near = [min(1.0, max(0.0, share + off)) for share in shares for off in (-2 * SKETCH, 2 * SKETCH)]
    ends = v.groupBy(*keys).agg(F.percentile_approx("own__", F.array(*(F.lit(p) for p in near)), F.lit(round(1 / SKETCH))).alias("ends__"), F.count("*").alias("n__"))
    told = with_key(v, ends, keys)
    # a row goes with a quantile as itself if it is in between, as a count if it is below
    few = F.col("n__") < round(10 / SKETCH)  # all values of a small key are kept: its ranks are closer than the sketch's error
    ways = F.array(*(F.when(few | (F.col("own__") <= F.col("ends__")[2 * i + 1]), F.struct(F.lit(i).alias("of"), F.when(few | (F.col("own__") >= F.col("ends__")[2 * i]), F.col("own__")).alias("v"))) for i in range(len(shares))))
    rows = told.select(*keys, "n__", F.explode(F.array_compact(ways)).alias("w__")).groupBy(*keys, "n__", F.col("w__.of").alias("which__"), F.col("w__.v").alias("own__")).agg(F.count("*").alias("t__"))
    ahead = Window.partitionBy(*keys, "which__").orderBy(F.col("own__").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("upto__", F.sum("t__").over(ahead)).where(F.col("own__").isNotNull())
    made = []
    for i, share in enumerate(shares):
        place = share * (F.col("n__") - 1)
        holds = lambda k, i=i: (F.col("which__") == i) & (F.col("upto__") > k) & (F.col("upto__") - F.col("t__") <= k)
        low, high = (F.max(F.when(holds(f(place)), F.col("own__"))) for f in (F.floor, F.ceil))
        part = F.max(place - F.floor(place))
        made.append(F.when(part == 0, low).otherwise(low + (high - low) * part))
    return ranked.groupBy(*keys).agg(F.array(*made).alias(name))


def with_key(df: DataFrame, told: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with what is told of its key; null keys meet, and without keys the one row meets all."""
    if not keys:
        return df.crossJoin(F.broadcast(told))  # one row
    renamed = told.withColumnsRenamed({k: f"{k}__key" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__key"))
    return df.join(renamed, same, "left").drop(*(f"{k}__key" for k in keys))


def robust_scaled(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with each value less its key's median, over the interquartile range; null where that is zero."""
    told = with_key(df, quantiles(df, keys, value, [0.25, 0.5, 0.75], "q__"), keys)
    return told.withColumn(name, ratio(F.col(value) - F.col("q__")[1], F.col("q__")[2] - F.col("q__")[0])).drop("q__")


def outlier_scores(df: DataFrame, keys: Sequence[str], values: Sequence[str], method: str) -> DataFrame:
    """``df`` with a score z_<value> for each value: robust z by the median deviation, z, or distance in interquartile
    ranges beyond the quartiles. Keys with fewer than three values score 0."""
    moments = df.groupBy(*keys).agg(*(F.avg(v).alias(f"{v}__a") for v in values), *(F.stddev_pop(v).alias(f"{v}__s") for v in values), *(F.count(v).alias(f"{v}__n") for v in values))
    centre = moments
    long = [*keys, "of__"]

    def wide(rows: DataFrame, made: dict[str, Column]) -> DataFrame:
        return rows.groupBy(*keys).agg(*(F.max(F.when(F.col("of__") == v, c)).alias(f"{v}__{n}") for v in values for n, c in made.items()))

    if method != "zscore":  # all columns below each other, so that one pass has all of their quantiles
        stacked = df.select(*keys, *(F.col(v).cast("double").alias(v) for v in values)).unpivot(list(keys), list(values), "of__", "v__")
        shares = [0.5] if method == "mad" else [0.25, 0.75]
        found = quantiles(stacked, long, "v__", shares)
        centre = with_key(centre, wide(found, {"m": F.col("q")[0]} if method == "mad" else {"lo": F.col("q")[0], "hi": F.col("q")[1]}), keys)
    if method == "mad":
        away = with_key(stacked, found, long).select(*long, F.abs(F.col("v__") - F.col("q")[0]).alias("v__"))
        centre = with_key(centre, wide(quantiles(away, long, "v__", [0.5]), {"d": F.col("q")[0]}), keys)
    told = with_key(df, centre, keys)
    out = []
    for v in values:
        c, s = F.col(v), F.col(f"{v}__s")
        if method == "mad":
            d = F.col(f"{v}__d")
            z = 0.6745 * ratio(c - F.col(f"{v}__m"), F.when(d > 0, d).otherwise(s))
        elif method == "zscore":
            z = ratio(c - F.col(f"{v}__a"), s)
        else:
            lo, hi = F.col(f"{v}__lo"), F.col(f"{v}__hi")
            z = ratio(F.greatest(lo - c, c - hi, F.lit(0.0)), hi - lo)
        out.append(F.when(F.col(f"{v}__n") < 3, 0.0).otherwise(F.coalesce(F.abs(z), F.lit(0.0))).alias(f"z_{v}"))
    return told.select(*df.columns, *out)


def flagged(df: DataFrame, values: Sequence[str], threshold: float, rule: str = "max", count: int = 1) -> DataFrame:
    """``outlier`` where the largest score is above the threshold, or so many scores are."""
    scores = [F.col(f"z_{v}") for v in values]
    if rule == "max":
        return df.withColumn("outlier", (F.greatest(*scores) if len(scores) > 1 else scores[0]) > threshold)
    over = [F.when(z > threshold, 1).otherwise(0) for z in scores]
    return df.withColumn("outlier", sum(over[1:], over[0]) >= count)


def iqr_report(df: DataFrame, values: Sequence[str], k: float = 1.5) -> DataFrame:
    """``df`` with the names of the columns that lie beyond k interquartile ranges, for the whole table."""
    told = df
    for v in values:
        told = with_key(told, quantiles(df, [], v, [0.25, 0.75], f"{v}__q"), [])
    names = []
    for v in values:
        lo, hi = F.get(f"{v}__q", F.lit(0)), F.get(f"{v}__q", F.lit(1))
        names.append(F.when((F.col(v) < lo - k * (hi - lo)) | (F.col(v) > hi + k * (hi - lo)), F.lit(v)))
    return told.select(*df.columns, F.array_join(F.array_compact(F.array(*names)), ",").alias("outlying"))


def within_sds(df: DataFrame, value: str, k: float = 3.0) -> DataFrame:
    """Rows within k sample deviations of the mean of all rows."""
    m = df.agg(F.avg(value).alias("m__"), F.stddev_samp(value).alias("s__"))
    return df.crossJoin(F.broadcast(m)).where(F.abs(F.col(value) - F.col("m__")) <= k * F.col("s__")).drop("m__", "s__")  # one row


def clipped(df: DataFrame, value: str, q: float) -> DataFrame:
    """Values above a quantile of all rows set to it."""
    top = quantiles(df, [], value, [q]).select(F.col("q")[0].alias("q__"))
    return df.crossJoin(F.broadcast(top)).withColumn(value, F.least(value, "q__")).drop("q__")  # one row


def interpolated(df: DataFrame, keys: Sequence[str], position: str, value: str) -> DataFrame:
    """Nulls on the line between their neighbours by position; the ends take the nearest value."""
    back = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(position).rowsBetween(0, Window.unboundedFollowing)
    there = F.when(F.col(value).isNotNull(), F.col(position))
    told = df.select(
        "*", F.last(value, True).over(back).alias("v0"), F.first(value, True).over(ahead).alias("v1"),
        F.last(there, True).over(back).alias("p0"), F.first(there, True).over(ahead).alias("p1"),
    )
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * ratio((F.col(position) - F.col("p0")).cast("double"), (F.col("p1") - F.col("p0")).cast("double"))
    return told.withColumn(value, F.coalesce(value, line, "v0", "v1")).drop("v0", "v1", "p0", "p1")


def ecdf(value: str, keys: Sequence[str]) -> Column:
    return F.cume_dist().over(Window.partitionBy(*keys).orderBy(value))


def difference_variance(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Half the variance of first differences: the noise of a series."""
    step = df.withColumn("step", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))
    return step.groupBy(*keys).agg((F.var_pop("step") / 2).alias("noise"))


def every_nth(df: DataFrame, keys: Sequence[str], order: str, n: int = 2) -> DataFrame:
    """Each n-th row, the first included."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.pmod(F.col("nth") - 1, F.lit(n)) == 0).drop("nth")


def usual_step(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """The most frequent number of days between dates that follow each other, the smallest among equals."""
    gaps = df.withColumn("step", F.datediff(F.lead(date).over(Window.partitionBy(*keys).orderBy(date)), date)).where("step is not null")
    counted = gaps.groupBy(*keys, "step").agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("step").alias("step"))).alias("best")).select(*keys, F.col("best.step").alias("step"))


def last_years(df: DataFrame, keys: Sequence[str], date: str, years: int) -> DataFrame:
    """Rows of the last so many years before the key's last date."""
    ends = df.groupBy(*keys).agg(F.max(date).alias("end__"))
    return df.join(ends, list(keys)).where(F.col(date) > F.add_months("end__", -12 * years)).drop("end__")


def running_total(df: DataFrame, order: str, value: str, name: str = "upto", parts: int = 200) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each one in the order of distinct values of a column."""
    return running_totals(df, order, {value: name}, parts)


def running_totals(df: DataFrame, order: str, names: Mapping[str, str], parts: int = 200) -> DataFrame:
    """``df`` with sums of some columns over all rows up to each one in the order of distinct values of a column.

    No task gets all rows: they are dealt to ranges between approximate quantiles, summed by range, and each range runs on
    from the total of those before it.
    """
    cuts = df.agg(F.percentile_approx(order, F.array(*(F.lit(i / parts) for i in range(1, parts))), F.lit(10_000)).alias("cuts__"))
    dealt = df.crossJoin(F.broadcast(cuts)).withColumn("part__", F.size(F.filter("cuts__", lambda c: c < F.col(order)))).drop("cuts__")  # one row
    sums = dealt.groupBy("part__").agg(*(F.sum(value).alias(f"own_{value}__") for value in names))
    earlier = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sums.select("part__", *(F.coalesce(F.sum(f"own_{value}__").over(earlier), F.lit(0)).alias(f"before_{value}__") for value in names))
    inside = Window.partitionBy("part__").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    told = dealt.withColumns({name: F.sum(value).over(inside) for value, name in names.items()}).join(starts, "part__")
    return told.withColumns({name: F.col(name) + F.col(f"before_{value}__") for value, name in names.items()}).drop("part__", *(f"before_{value}__" for value in names))
