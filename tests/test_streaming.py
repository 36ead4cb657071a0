import random
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidewrack.operators.timeseries import NextBelow, correct_sequence
from tidewrack.streaming import series as stream


def _stream(spark, tmp_path, values, parts, **options):
    rows = [(k, f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00", x, i // 7) for k, v in values.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "k string, t string, v double, part int").withColumn("t", F.to_timestamp("t"))
    for part in range(parts):  # a file for each batch
        df.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("k string, t timestamp, v double").parquet(str(tmp_path / "in"))
        stream.run_to_parquet(stream.corrected(source, "k", "t", "v", **options), str(tmp_path / "out"), str(tmp_path / "state"))
    return spark.read.parquet(str(tmp_path / "out"))


def _made(seed, n=40):
    rng = random.Random(seed)
    values = {k: [None if rng.random() < 0.2 else rng.choice([1.0, 1.2, 1.4, 5.0, 9.0]) for _ in range(n)] for k in "ab"}
    for v in values.values():
        v[0] = 1.0
    values["b"][n - 6 :] = [50.0] * 6  # a lasting rise: nothing acceptable follows
    return values


def test_all_rows_are_given_as_the_batch_form_gives_them(spark, tmp_path):
    """Batches may end anywhere: after each, the latest versions are the batch form's answer to the rows so far."""
    values = _made(3)
    given = _stream(spark, tmp_path, values, 6)
    for k, v in values.items():
        rows = stream.latest(given).where(F.col("key") == k).orderBy("nth").collect()
        want = correct_sequence(np.array([np.nan if x is None else x for x in v]))
        assert len(rows) == 40 and np.allclose([r["corrected"] for r in rows], want)
        assert [r["t"].hour for r in rows] == [i % 24 for i in range(40)]
    tail = [r["certain"] for r in stream.latest(given).where("key = 'b'").orderBy("nth").collect()]
    assert not any(tail[-6:]) and all(tail[:20])


def test_impatient_state_is_let_go(spark, tmp_path):
    values = {"a": [1.0, 50.0, 50.0] + [60.0] * 39, "b": [1.0] * 42}
    given = _stream(spark, tmp_path, values, 6, late="1 hour", patience=5 * 3600.0)
    rows = stream.latest(given).where("key = 'a'").orderBy("nth").collect()
    assert len(rows) == 42 and {r["corrected"] for r in rows} == {1.0} and sum(r["certain"] for r in rows) >= 25


def test_the_next_acceptable_value_is_found(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 33, 64):
        v = np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n))
        tree = NextBelow(v)
        for start in range(n + 2):
            for limit in (-1.0, 0.0, 1.0, np.inf, np.nan):
                want = next((i for i in range(start, n) if not np.isnan(v[i]) and v[i] <= limit), None)
                assert tree.find(start, limit) == want


def test_the_last_of_duplicates_stays(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 09:00:00", 2.0), ("a", "2024-01-02 01:00:00", 3.0), ("b", "2024-01-01 01:00:00", None)]
    spark.createDataFrame(rows, "k string, t string, v double").withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k string, t timestamp, v double").parquet(str(tmp_path / "in"))
    got = stream.run_once(stream.last_of_duplicates(source, ["k"], "t", "1 day", "1 day"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted((r["k"], r["t"].hour, r["v"]) for r in got.collect()) == [("a", 1, 3.0), ("a", 9, 2.0), ("b", 1, None)]


def test_query_gives_every_event(spark):
    from tidewrack.operators import timeseries
    from tidewrack.plans import catalog

    sf = "/root/testdata/sf0.01"
    got = catalog.QUERIES["streamed_corrections"](spark, sf).toPandas()
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    want = timeseries.corrected(events, ["event_type"], "ts", "value", "fixed").toPandas()
    got, want = got.sort_values(["key", "nth"]), want.sort_values(["event_type", "ts", "value"])
    assert len(got) == len(want) == events.count() and np.allclose(got["corrected"], want["fixed"], equal_nan=True, atol=1e-6)


def test_a_key_of_many_rows_takes_tens_of_bytes_each():
    """Rows are held as arrays and handed on in pieces."""

    class State:
        exists = False

        def update(self, new):
            self.now = new

    n, state = 200_000, State()
    rng = np.random.default_rng(1)
    t, v = rng.permutation(n) * 1_000_000, rng.uniform(1, 1.4, n)
    frames = [pd.DataFrame({"t": pd.to_datetime(t[a : a + 10_000], unit="us"), "v": v[a : a + 10_000]}) for a in range(0, n, 10_000)]
    tracemalloc.start()
    at, sizes = 0, []
    for part in stream.correcting(1.5, None)(("a",), iter(frames), state):
        assert (part["nth"].to_numpy() == np.arange(at, at + len(part))).all() and part["t"].is_monotonic_increasing
        at += len(part)
        sizes.append(len(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == n and max(sizes) <= stream.GIVEN and peak < 150 * n
    assert state.now[1] == n and state.now[3] == []
