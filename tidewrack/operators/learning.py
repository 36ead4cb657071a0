"""Models with pyspark.ml: features, cross validation, forests, clusters, components, attributions."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.lineage import written
from tidewrack.operators.windows import imputed

#: Rows that a column's values are dealt among.
BUCKET = 1 << 16

#: Rows that agree in all columns are counted once for all fits where there are more than so many of each kind on average.
REPEATS = 4

#: Bootstraps that are drawn in one pass, and trees that are grown at a time.
BAGS, GROWN = 16, 4


def features(df: DataFrame, key: str, order: str, target: str, numbers: Sequence[str]) -> DataFrame:
    """Lag of the target, calendar columns and means in place of nulls."""
    told = df.withColumns({"lag_1": F.lag(target).over(Window.partitionBy(key).orderBy(order)), "month": F.month(order), "year": F.year(order)}).where("lag_1 is not null")
    return reduce(lambda d, c: imputed(d, [key], c), numbers, told)


def folds(df: DataFrame, ids: Sequence[str], k: int) -> DataFrame:
    """``df`` with ``fold``, by a hash of what tells rows apart, so that reruns agree."""
    return df.withColumn("fold", F.pmod(F.xxhash64(*ids), F.lit(k)).cast("int"))


def _assembler(columns: Sequence[str]) -> VectorAssembler:
    """One for many fits is compiled once: its own name is in what Spark compiles for columns that aren't doubles."""
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip")


def _pipeline(columns: Sequence[str], model) -> Pipeline:
    return Pipeline(stages=[_assembler(columns), model])


def linear(target: str, ridge: float = 0.0, lasso: float = 0.0) -> LinearRegression:
    total = ridge + lasso
    return LinearRegression(labelCol=target, regParam=total, elasticNetParam=lasso / total if total else 0.0)


def forest(target: str, trees: int = 30, depth: int = 8, seed: int = 0) -> RandomForestRegressor:
    return RandomForestRegressor(labelCol=target, numTrees=trees, maxDepth=depth, seed=seed)


def boosted(target: str, rounds: int = 20, depth: int = 4, seed: int = 0) -> GBTRegressor:
    return GBTRegressor(labelCol=target, maxIter=rounds, maxDepth=depth, seed=seed)


def fit(df: DataFrame, columns: Sequence[str], model) -> PipelineModel:
    return _pipeline(columns, model).fit(df)


def _scores(predicted: DataFrame, target: str, names: Sequence[str]) -> list[dict[str, float]]:
    y, asked = F.col(target).cast("double"), []
    for name in names:
        e = y - F.col(name)
        asked += [F.avg(e * e), F.avg(F.abs(e)), F.var_pop(F.when(e.isNotNull(), y))]
    row = predicted.agg(*asked).first()
    told = [row[i : i + 3] for i in range(0, len(row), 3)]
    return [{"r2": 1 - e2 / v if v else math.nan, "rmse": math.sqrt(e2), "mae": e1} if e2 is not None else dict.fromkeys(("r2", "rmse", "mae"), math.nan) for e2, e1, v in told]


def scores(predicted: DataFrame, target: str) -> dict[str, float]:
    """r2, rmse and mae, in one pass."""
    return _scores(predicted, target, ["prediction"])[0]


def _side_by_side(df: DataFrame, models: Sequence[PipelineModel]) -> DataFrame:
    """``df`` with each model's prediction, ``p0__`` and on; the models have the same columns."""
    told = models[0].stages[0].transform(df)
    for i, model in enumerate(models):
        own = model.stages[-1]
        told = own.transform(told, {own.predictionCol: f"p{i}__"})
    return told


def _bags(model) -> list[tuple[int, float, int]]:
    """(seed, rate, tree) of each bootstrap that ``model`` draws of its rows."""
    return [(model.getSeed(), model.getSubsamplingRate(), t) for t in range(model.getNumTrees())] if isinstance(model, RandomForestRegressor) and model.getBootstrap() else []


def _drawn(h: str, rate: float) -> Column:
    """How often a row is drawn, by Poisson's law, from a hash of 64 bits."""
    chance, below, told, k = math.exp(-rate), 0.0, None, 0
    while below + chance < 1 - 1e-15:
        below += chance
        at = F.col(h) < F.lit(int((below - 0.5) * 2.0**64))
        told = F.when(at, k) if told is None else told.when(at, k)
        k += 1
        chance *= rate / k
    return told.otherwise(k)


def _needs_counts(model) -> bool:
    """Whether equal rows bear upon ``model`` by their number, mean and variance alone: least squares, and trees that don't count
    or draw single rows in another way than by bootstraps."""
    if not isinstance(model, (LinearRegression, RandomForestRegressor, GBTRegressor)) or model.isSet("weightCol"):
        return False
    if isinstance(model, LinearRegression):
        return model.getLoss() == "squaredError" and model.getSolver() != "l-bfgs"
    if model.getMinInstancesPerNode() > 1 or model.getMinWeightFractionPerNode() > 0:
        return False
    if isinstance(model, RandomForestRegressor):
        return model.getBootstrap() or model.getSubsamplingRate() == 1
    return model.getLossType() == "squared" and model.getSubsamplingRate() == 1 and not model.isSet("validationIndicatorCol")


class Counted:
    """Rows that agree in ``fold`` and ``columns``, as one with their number, mean and deviation, and for each bootstrap of a
    forest how many of them were drawn and their mean. Made in a pass for every ``BAGS`` bootstraps; fits read these tables,
    (fold, features, target, n__).

    Draws go by a hash of ``ids`` and the row's values, so that reruns draw the same; without ``ids``, by the row's place. What weighs over
    ``heavy`` is dealt to several rows, as trees look for their bounds in a sample of rows."""

    def __init__(self, df: DataFrame, columns: Sequence[str], target: str, models: Iterable, ids: Sequence[str], heavy: float):
        self.assembler, self.target, self.keys = _assembler(columns), target, list(dict.fromkeys(["fold", *columns]))
        bags = list(dict.fromkeys(b for m in models for b in _bags(m)))
        self.bags: dict[tuple[int, float, int], DataFrame] = {}
        for at in range(0, max(1, len(bags)), BAGS):
            own = bags[at : at + BAGS]
            table = written(self._told(df, own, ids, heavy))
            self.bags |= {b: table.where(F.col(f"w{i}__") > 0).select("fold", "features", F.col(f"m{i}__").alias(target), F.col(f"w{i}__").alias("n__")) for i, b in enumerate(own)}
            if not at:
                self.rows = written(self._moments(table))

    def _told(self, df: DataFrame, bags: Sequence[tuple[int, float, int]], ids: Sequence[str], heavy: float) -> DataFrame:
        row = [F.col(c) for c in dict.fromkeys([*ids, *self.keys, self.target])] if ids else [F.monotonically_increasing_id()]
        hashed = df.select(*self.keys, F.col(self.target).cast("double").alias("y__"), *(F.xxhash64(*row, F.lit(seed), F.lit(t)).alias(f"w{i}__") for i, (seed, _, t) in enumerate(bags)))
        drawn = hashed.select(*self.keys, "y__", *(_drawn(f"w{i}__", rate).alias(f"w{i}__") for i, (_, rate, _) in enumerate(bags)))
        weights, known = ["n__", *(f"w{i}__" for i in range(len(bags)))], F.count("y__") == F.count("*")  # a missing value stays one, which models refuse
        means = [F.when(known, F.avg("y__")).alias("mean__"), F.stddev_pop("y__").alias("sd__")]
        means += [F.when(known, F.try_divide(F.sum(F.col(w) * F.col("y__")), F.sum(w))).alias(f"m{w[1:]}") for w in weights[1:]]
        told = drawn.groupBy(*self.keys).agg(F.count("*").cast("double").alias("n__"), *(F.sum(w).cast("double").alias(w) for w in weights[1:]), *means)
        parts = F.ceil(F.col("n__") / F.lit(heavy)).cast("int")
        dealt = told.withColumns({w: F.col(w) / parts for w in weights} | {"part__": F.explode(F.sequence(F.lit(1), parts))})
        return self.assembler.transform(dealt.sortWithinPartitions(*self.keys, "part__")).select("fold", "features", *weights, "mean__", "sd__", *(f"m{w[1:]}" for w in weights[1:]))

    def _moments(self, table: DataFrame) -> DataFrame:
        """Of each kind two rows, or one if all are equal, that have its weight, mean and variance."""
        mean, sd = F.col("mean__"), F.col("sd__")
        told = table.withColumn("values__", F.when(sd > 0, F.array(mean - sd, mean + sd)).otherwise(F.array(mean)))
        return told.select("fold", "features", F.explode("values__").alias(self.target), (F.col("n__") / F.size("values__")).alias("n__"))

    def fit(self, model, fold: int | None = None) -> PipelineModel:
        """``model`` fitted to all rows, or to those of the other folds. A forest's trees are grown each from its bootstrap."""

        def fitted(rows: DataFrame, **settings):
            own = model.copy({model.getParam(p): v for p, v in ({"weightCol": "n__"} | settings).items()})
            return own.fit(rows if fold is None else rows.where(F.col("fold") != fold))

        bags = _bags(model)
        if not bags:
            return PipelineModel([self.assembler, fitted(self.rows)])
        some = model.getFeatureSubsetStrategy()
        some = "onethird" if some == "auto" and len(bags) > 1 else some
        seeds = np.random.default_rng(model.getSeed() % (1 << 64)).integers(1 << 62, size=len(bags)).tolist()

        def grown(bag: tuple[int, float, int], seed: int) -> RandomForestRegressionModel:
            return fitted(self.bags[bag], numTrees=1, bootstrap=False, subsamplingRate=1.0, featureSubsetStrategy=some, seed=seed)

        with ThreadPool(GROWN) as pool:
            trees = pool.starmap(inheritable_thread_target(self.rows.sparkSession)(grown), zip(bags, seeds))
        return PipelineModel([self.assembler, _forest_of(trees, model)])


def _forest_of(forests: Sequence[RandomForestRegressionModel], model: RandomForestRegressor) -> RandomForestRegressionModel:
    """The trees of several forests as one."""
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    own = sc._jvm.org.apache.spark.ml.regression
    trees = [t._java_obj for f in forests for t in f.trees]
    array = sc._gateway.new_array(own.DecisionTreeRegressionModel, len(trees))
    for i, t in enumerate(trees):
        array[i] = t
    told = model._copyValues(RandomForestRegressionModel(own.RandomForestRegressionModel(f"{model.uid}_trees", array, forests[0].numFeatures)))
    told._transfer_params_to_java()
    return told


def _counted(df: DataFrame, columns: Sequence[str], target: str, models: Iterable, ids: Sequence[str]) -> Counted | None:
    """``Counted``, where it is less than the rows by far and some model can do with it."""
    some = [m for m in models if _needs_counts(m)]
    if not some:
        return None
    n, kinds = df.agg(F.count("*"), F.approx_count_distinct(F.xxhash64("fold", *columns))).first()
    return Counted(df, columns, target, some, ids, REPEATS * n / kinds) if n > REPEATS * kinds else None


def cross_validated(df: DataFrame, columns: Sequence[str], models: dict[str, object], target: str, k: int = 5, ids: Sequence[str] = ()) -> list[tuple[str, int, float, float, float]]:
    """(model, fold, r2, rmse, mae) over the column ``fold``; the best model is the one with the highest mean r2.

    Where rows agree in all columns often enough, models are fitted to what ``Counted`` tells of them; scores are taken from the
    rows themselves, of all models at once."""
    counted, assembler, told = _counted(df, columns, target, models.values(), ids), _assembler(columns), {}
    for fold in range(k):
        seen, unseen = df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)
        fitted = [counted.fit(m, fold) if counted and _needs_counts(m) else Pipeline(stages=[assembler, m]).fit(seen) for m in models.values()]
        told |= {(name, fold): s for name, s in zip(models, _scores(_side_by_side(unseen, fitted), target, [f"p{i}__" for i in range(len(fitted))]))}
    return [(name, fold, told[name, fold]["r2"], told[name, fold]["rmse"], told[name, fold]["mae"]) for name in models for fold in range(k)]


def grid_search(df: DataFrame, columns: Sequence[str], model, grid: dict[str, Sequence], target: str, k: int = 5, metric: str = "rmse", ids: Sequence[str] = ()) -> tuple[PipelineModel, list[tuple[dict, float]]]:
    """(the best model fitted to all rows, each setting with its mean over folds). ``grid`` has the model's parameters by name;
    folds are the column ``fold`` (``folds``), so that all settings see the same ones and reruns agree. Fits follow each
    other, so that the rows of one of them are in memory; ``df`` is read for each and should be a table.

    Where rows agree in all columns often enough, fits and means of squares are taken from what ``Counted`` tells of them."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(model.getParam(name), list(values))
    settings = builder.build()
    models, assembler = [model.copy(s) for s in settings], _assembler(columns)
    counted = _counted(df, columns, target, models, ids)
    squares = counted is not None and metric in ("rmse", "mse")
    judge = RegressionEvaluator(labelCol=target, metricName=metric, **({"weightCol": "n__"} if squares else {}))
    judged, told = counted.rows if squares else df, [0.0] * len(settings)
    for fold in range(k):
        seen, unseen = df.where(F.col("fold") != fold), judged.where(F.col("fold") == fold)
        for i, own in enumerate(models):
            fitted = counted.fit(own, fold) if counted and _needs_counts(own) else Pipeline(stages=[assembler, own]).fit(seen)
            told[i] += float(judge.evaluate((fitted.stages[-1] if squares else fitted).transform(unseen))) / k
    best = models[(max if judge.isLargerBetter() else min)(range(len(settings)), key=lambda i: told[i])]
    trees = counted and _needs_counts(best) and not isinstance(best, LinearRegression)  # a line's summary is that of the rows
    return counted.fit(best) if trees else fit(df, columns, best), [({p.name: v for p, v in s.items()}, m) for s, m in zip(settings, told)]


def forest_importance(model: PipelineModel, columns: Sequence[str]) -> list[tuple[str, float]]:
    """(variable, importance) of a fitted forest, how much its splits lower the variance, largest first."""
    return sorted(zip(columns, map(float, model.stages[-1].featureImportances.toArray())), key=lambda r: (-r[1], r[0]))


def observed_and_predicted(model: PipelineModel, df: DataFrame, ids: Sequence[str], target: str) -> DataFrame:
    """(ids..., kind, value), observed and predicted values one below the other."""
    told = model.transform(df).select(*ids, F.col(target).cast("double").alias("observed"), F.col("prediction").alias("predicted"))
    return told.unpivot(list(ids), ["observed", "predicted"], "kind", "value")


def permutation_importance(model: PipelineModel, df: DataFrame, columns: Sequence[str], target: str, ids: Sequence[str]) -> list[tuple[str, float]]:
    """How much the error grows when a column's values are dealt to other rows, by ranks of two hashes inside hash buckets.

    Buckets are 64, or as many as keep them at about ``BUCKET`` rows. All columns are dealt in one pass."""
    rows = written(df.select(*dict.fromkeys([*ids, *columns, target])))
    parts = max(64, -(-rows.count() // BUCKET))
    hashes = {"h__": F.xxhash64(*ids)} | {f"h{i}__": F.xxhash64(*ids, F.lit(c)) for i, c in enumerate(columns)}
    names = [f"dealt{i}__" for i in range(len(columns))]
    kept = list(dict.fromkeys([*columns, target]))
    types = dict(rows.dtypes)

    def deal(own: pa.Table) -> pa.Table:
        own = own.combine_chunks()
        values = tuple(own[c].to_numpy() for c in kept)  # rows that share their ids
        to = np.lexsort((*values, own["h__"].to_numpy()))
        made = []
        for i, c in enumerate(columns):
            taken = np.empty(len(to), np.int64)
            taken[to] = np.lexsort((*values, own[f"h{i}__"].to_numpy()))
            made.append(own[c].take(pa.array(taken)))
        return pa.table([*(own[c] for c in kept), *made], [*kept, *names])

    bucketed = rows.withColumn("b__", F.pmod(F.xxhash64(*ids), F.lit(parts))).select("b__", *kept, *(h.alias(n) for n, h in hashes.items()))
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), *(f"`{n}` {types[c]}" for n, c in zip(names, columns))])
    dealt = written(bucketed.groupBy("b__").applyInArrow(deal, schema))
    base = scores(model.transform(dealt.select(*kept)), target)["rmse"]
    return [(c, scores(model.transform(dealt.select(*kept, n).withColumn(c, F.col(n)).drop(n)), target)["rmse"] - base) for n, c in zip(names, columns)]


def linear_attributions(model: PipelineModel, df: DataFrame, columns: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Shapley values of a linear model, coefficient times distance from the column's mean, per row and column."""
    weights = list(model.stages[-1].coefficients)
    means = df.agg(*(F.avg(c).alias(f"{c}__m") for c in columns))
    told = df.crossJoin(F.broadcast(means)).select(*ids, *((F.lit(float(w)) * (F.col(c) - F.col(f"{c}__m"))).alias(c) for c, w in zip(columns, weights)))  # one row
    return told.unpivot(list(ids), list(columns), "variable", "attribution")


def clusters(df: DataFrame, columns: Sequence[str], by: str, k: int = 3, seed: int = 0) -> DataFrame:
    """``df`` with ``cluster``, numbered in the order of the clusters' mean of ``by``."""
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="raw__"), StandardScaler(inputCol="raw__", outputCol="features__", withMean=True), KMeans(featuresCol="features__", predictionCol="label__", k=k, seed=seed)])
    told = pipeline.fit(df).transform(df)
    means = told.groupBy("label__").agg(F.avg(by).alias("m__"))
    named = means.withColumn("cluster", F.row_number().over(Window.orderBy("m__")) - 1).drop("m__")  # k rows
    return told.join(F.broadcast(named), "label__").drop("label__", "raw__", "features__")


def components(df: DataFrame, columns: Sequence[str], ids: Sequence[str], k: int = 2) -> tuple[DataFrame, list[float], list[list[float]]]:
    """Scores of standardised principal components, the variance each explains, and the loadings."""
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="raw__", handleInvalid="skip"), StandardScaler(inputCol="raw__", outputCol="std__", withMean=True), PCA(inputCol="std__", outputCol="pc__", k=k)])
    model = pipeline.fit(df)
    pca = model.stages[-1]
    pc = vector_to_array("pc__")
    told = model.transform(df).select(*ids, *(pc[i].alias(f"pc{i + 1}") for i in range(k)))
    return told, list(pca.explainedVariance), pca.pc.toArray().tolist()


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
