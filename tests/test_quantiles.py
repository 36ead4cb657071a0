import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewrack.operators import windows


@pytest.mark.parametrize("few", [True, False])
def test_quantiles_equal_numpy(spark, monkeypatch, few):
    """Of small keys, of keys with many ties, and of keys over the sketch's bound."""
    if not few:
        monkeypatch.setattr(windows, "SKETCH", 1 / 50)
    rng = np.random.default_rng(1)
    own = {"a": rng.normal(size=5), "b": rng.normal(size=3000), "c": rng.integers(0, 4, 3001).astype(float), None: rng.exponential(size=1500), "one": np.array([7.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in own.items() for v in vs] + [("a", None), ("empty", None)], "k string, v double").repartition(5)
    shares = [0.0, 0.05, 0.25, 0.5, 0.995, 1.0]
    got = {r["k"]: r["q"] for r in windows.quantiles(df, ["k"], "v", shares).collect()}
    assert set(got) == set(own)
    for k, v in own.items():
        assert np.allclose(got[k], np.quantile(v, shares)), k
    whole = windows.quantiles(df, [], "v", [0.5]).first()["q"][0]
    assert np.isclose(whole, np.median(np.concatenate(list(own.values()))))


def test_counts_up_to_a_value(spark):
    df = spark.createDataFrame([("a", x) for x in (3, 1, 1, 2, 3, 3)] + [(None, 5), ("b", 1)], "k string, v int")
    rows = {(r["k"], r["v"]): (r["t"], r["upto"], r["n"]) for r in windows.counted_upto(df, ["k"], "v", 4).collect()}
    assert rows == {("a", 1): (2, 2, 6), ("a", 2): (1, 3, 6), ("a", 3): (3, 6, 6), (None, 5): (1, 1, 1), ("b", 1): (1, 1, 1)}


def test_running_totals(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("a"), F.lit(2).alias("b"))
    rows = windows.running_totals(df, "id", {"a": "sa", "b": "sb"}, 7).orderBy("id").collect()
    assert [r["sa"] for r in rows] == list(np.cumsum(np.arange(100) % 3)) and [r["sb"] for r in rows] == list(range(2, 201, 2))
