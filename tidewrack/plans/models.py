"""Model and streaming plans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewrack.lineage import written
from tidewrack.operators import attributions, learning, recipes
from tidewrack.plans.base import OBS, observations, query, rounded, table
from tidewrack.streaming import series as stream


@query(f"""WITH {OBS} SELECT round(regr_slope(biovolume, density), 3) AS slope, round(regr_intercept(biovolume, density), 2) AS intercept, round(regr_r2(biovolume, density), 5) AS r2 FROM obs""")
def linear_model(spark, d):
    """L1: a model of one predictor against its closed form."""
    model = learning.fit(observations(spark, d).select("density", "biovolume"), ["density"], learning.linear("biovolume")).stages[-1]
    return spark.createDataFrame([(round(float(model.coefficients[0]), 3), round(float(model.intercept), 2), round(float(model.summary.r2), 5))], "slope double, intercept double, r2 double")


_X = ["density", "discount", "tax", "size"]


@query()
def cross_validated_models(spark, d):
    """L1, and L2, L4 and L6 at one setting each: folds by hash, several models."""
    data = written(learning.folds(observations(spark, d), ["ord", "line"], 3).select("fold", "ord", "line", "biovolume", *_X))
    rows = learning.cross_validated(data, _X, {"linear": learning.linear("biovolume"), "ridge": learning.linear("biovolume", ridge=1.0), "forest": learning.forest("biovolume", 10, 5), "boosted": learning.boosted("biovolume", 5, 3)}, "biovolume", 3, ["ord", "line"])
    return spark.createDataFrame(rows, "model string, fold int, r2 double, rmse double, mae double")


@query()
def observed_and_predicted(spark, d):
    """L9-L11, B11."""
    data = observations(spark, d).select("ord", "line", "biovolume", *_X)
    model = learning.fit(data.where("ord % 5 != 0"), _X, learning.linear("biovolume"))
    return rounded(learning.observed_and_predicted(model, data.where("ord % 5 = 0"), ["ord", "line"], "biovolume"), 4)


@query()
def variable_importance(spark, d):
    """L3."""
    data = written(observations(spark, d).select("ord", "line", "biovolume", *_X))
    model = learning.fit(data, _X, learning.linear("biovolume"))
    return spark.createDataFrame(learning.permutation_importance(model, data, _X, "biovolume", ["ord", "line"]), "variable string, importance double")


@query()
def linear_attributions(spark, d):
    """Mean absolute Shapley value of each variable."""
    data = observations(spark, d).select("ord", "line", "biovolume", *_X)
    model = learning.fit(data, _X, learning.linear("biovolume"))
    return rounded(learning.linear_attributions(model, data, _X, ["ord", "line"]).groupBy("variable").agg(F.avg(F.abs("attribution")).alias("mean_abs")), 3)


@query()
def tree_attributions(spark, d):
    """Mean size of each variable's Shapley values in a forest and in boosted trees."""
    data, told = written(observations(spark, d).select("ord", "line", "biovolume", *_X)), None
    for name, kind in (("forest", learning.forest("biovolume", 5, 4)), ("boosted", learning.boosted("biovolume", 5, 3))):
        model = learning.fit(data, _X, kind)
        got = attributions.importance(attributions.tree_attributions(model, data, _X, ["ord", "line"]), _X).select(F.lit(name).alias("model"), "variable", F.round("mean_abs", 2).alias("mean_abs"))
        told = got if told is None else told.unionByName(got)
    return told


@query()
def preprocessed_columns(spark, d):
    """Power transform, centred, scaled, components of nine tenths of the variance; their means and deviations."""
    data = observations(spark, d).select("density", "biovolume", "discount", F.col("size").cast("double").alias("size"))
    recipe = recipes.Recipe(["density", "biovolume", "discount", "size"], ["yeo_johnson", "center", "scale", "pca"]).fit(data)
    made = recipe.transform(data)
    return rounded(made.agg(*(f(c).alias(f"{name}_{c}") for c in recipe.columns for name, f in (("mean", F.avg), ("sd", F.stddev)))), 4)


@query()
def independent_components(spark, d):
    """Independent components of whitened columns, each column's weight in them by correlation."""
    data = observations(spark, d).select("density", "discount", "tax", (F.col("density") * 2 + F.col("size")).alias("mix"))
    recipe = recipes.Recipe(["density", "discount", "tax", "mix"], ["center", "scale", "ica"], rounds=60)
    made = recipe.fit(data).transform(data.select("*", *(F.col(c).alias(f"own_{c}") for c in data.columns)))
    told = made.agg(*(F.abs(F.corr(f"own_{c}", i)).alias(f"{c}|{i}") for c in data.columns for i in recipe.columns)).withColumn("__", F.lit(0))
    return rounded(told.unpivot(["__"], [c for c in told.columns if c != "__"], "pair", "r").drop("__"), 2)


@query()
def clusters_by_mean(spark, d):
    """M16, W27, P33."""
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return learning.clusters(part, ["p_size", "p_retailprice"], "p_retailprice").select("p_partkey", "cluster")


@query()
def principal_components(spark, d):
    """M15."""
    told, _, _ = learning.components(observations(spark, d).groupBy("sample").agg(*(F.avg(c).alias(c) for c in _X)), _X, ["sample"])
    return told.select("sample", F.round(F.abs("pc1"), 4).alias("abs_pc1"), F.round(F.abs("pc2"), 4).alias("abs_pc2"))


def _events(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def _folders(spark, name: str) -> tuple[str, str]:
    """A folder for rows and one for state, in the shared folder of the cluster, if it names one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and spark.sparkContext.master.startswith("local"):
        import tempfile

        shared = tempfile.mkdtemp(prefix="spark-stream-")
    if shared is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"{shared}/{name}_{uuid.uuid4().hex}"
    return f"{own}/rows", f"{own}/state"


@query("""SELECT event_type, strftime(time_bucket(INTERVAL 8 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS start, count(*) AS n, round(sum(value), 4) AS sum FROM events GROUP BY 1, 2""")
def streamed_intervals(spark, d):
    """Tumbling 8-day windows over a stream."""
    got = stream.run_once(stream.tumbling(_events(spark, d), ["event_type"], "ts", "value", "8 days", "30 days"), *_folders(spark, "intervals"))
    return got.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("start"), "n", F.round("sum", 4).alias("sum"))


@query("""SELECT event_type, strftime(CAST(CAST(ts AS DATE) + CAST(k AS INTEGER) AS DATE), '%Y-%m-%d') AS end, round(avg(value), 6) AS mean, count(*) AS n FROM events CROSS JOIN generate_series(1, 3) g(k) GROUP BY 1, 2""")
def streamed_trailing_means(spark, d):
    """Means of three days up to each."""
    got = stream.run_once(stream.trailing(_events(spark, d), ["event_type"], "ts", "value", "3 days", "1 day", "30 days"), *_folders(spark, "trailing"))
    return got.select("event_type", F.date_format("end", "yyyy-MM-dd").alias("end"), F.round("mean", 6).alias("mean"), "n")


@query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS end, count(*) AS n
    FROM s GROUP BY user_id, k
""")
def streamed_sessions(spark, d):
    """Begin, end and size of each session."""
    got = stream.run_once(stream.sessions(_events(spark, d), ["user_id"], "ts", "1 day", "30 days"), *_folders(spark, "sessions"))
    day = "yyyy-MM-dd HH:mm:ss"
    return got.select("user_id", F.date_format("start", day).alias("start"), F.date_format("end", day).alias("end"), "n")


@query("""
    SELECT user_id, event_type, max(ts)::DATE::VARCHAR AS day, arg_max(event_id, (ts, event_id)) AS event_id FROM events
    GROUP BY user_id, event_type, ts::DATE
""")
def streamed_last_rows(spark, d):
    """Of a user's events of a kind on one day the last stays."""
    told = _events(spark, d).select("user_id", "event_type", "ts", "event_id")
    got = stream.run_once(stream.last_of_duplicates(told, ["user_id", "event_type"], "ts", "1 day", "30 days"), *_folders(spark, "last"))
    return got.select("user_id", "event_type", F.to_date("ts").cast("string").alias("day"), "event_id")


@query("""WITH RECURSIVE v AS (SELECT event_type AS key, list(value ORDER BY ts, value) AS own FROM events GROUP BY 1),
    walk(key, k, fixed) AS (SELECT key, 1, own[1] FROM v UNION ALL
        SELECT v.key, k + 1, CASE WHEN own[k + 1] <= 1.5 * fixed THEN own[k + 1] ELSE (fixed + coalesce(list_filter(own[k + 2:], lambda x: x <= 1.5 * fixed)[1], fixed)) / 2 END FROM walk JOIN v ON walk.key = v.key WHERE k < len(own))
    SELECT walk.key, CAST(k - 1 AS BIGINT) AS nth, own[k] AS v, fixed AS corrected FROM walk JOIN v ON walk.key = v.key""")
def streamed_corrections(spark, d):
    """Z3: state carried along each type's values; of each place, what is known at the end."""
    rows, state = _folders(spark, "corrections")
    stream.run_to_parquet(stream.corrected(_events(spark, d), "event_type", "ts", "value"), rows, state)
    got = stream.latest(spark.read.schema(stream.CORRECTED).parquet(rows))
    return got.select("key", "nth", "v", "corrected")
