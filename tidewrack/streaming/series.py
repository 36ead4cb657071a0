"""Structured Streaming forms of the series operators, with event time and watermarks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewrack.operators.timeseries import corrections


def tumbling(stream: DataFrame, keys: Sequence[str], time: str, value: str, size: str, late: str, start: str = "0 seconds") -> DataFrame:
    """Count, sum and mean per key and interval; windows begin at ``start`` after the epoch's multiples of ``size``."""
    w = F.window(time, size, size, start)
    got = stream.withWatermark(time, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("sum"), F.avg(value).alias("mean"))
    return got.select(*keys, F.col("w.start").alias("start"), "n", "sum", "mean")


def trailing(stream: DataFrame, keys: Sequence[str], time: str, value: str, size: str, slide: str, late: str) -> DataFrame:
    """Mean per key over a sliding window of time."""
    got = stream.withWatermark(time, late).groupBy(*keys, F.window(time, size, slide).alias("w")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return got.select(*keys, F.col("w.end").alias("end"), "mean", "n")


def sessions(stream: DataFrame, keys: Sequence[str], time: str, gap: str, late: str) -> DataFrame:
    """Runs of rows with no gap longer than ``gap``."""
    got = stream.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return got.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_duplicates(stream: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    """One row per key within the watermark, the first to arrive."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def last_of_duplicates(stream: DataFrame, keys: Sequence[str], time: str, within: str, late: str) -> DataFrame:
    """One row per key and span of time ``within``, the last by time; of rows of one time the one that is last in all columns."""
    span = F.window(time, within).alias("w__")
    others = [c for c in stream.columns if c not in keys]
    latest = F.max(F.struct(F.col(time).alias("at__"), *others)).alias("row__")
    got = stream.withWatermark(time, late).groupBy(*keys, span).agg(latest)
    return got.select(*keys, *(F.col(f"row__.{c}").alias(c) for c in others))


#: Rows that ``corrected`` hands on at once.
GIVEN = 1 << 15

CORRECTED = "key string, nth long, version long, t timestamp, v double, corrected double, certain boolean"


def correcting(threshold: float, patience: float | None):
    """What ``corrected`` does with a key's rows of a batch."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, done, version, times, values = state.get if state.exists else (None, 0, 0, [], [])
        ts, vs = [np.array(times, np.int64)], [np.array([math.nan if x is None else x for x in values], float)]
        for rows in frames:
            ts.append(rows["t"].to_numpy("datetime64[us]").astype(np.int64))
            vs.append(rows["v"].to_numpy(float))
        t, v = np.concatenate(ts), np.concatenate(vs)
        ts, vs = [], []
        order = np.lexsort((v, t))  # missing ones are last of their time
        t, v = t[order], v[order]
        del order
        fixed, certain = corrections(v, threshold, last)
        if patience is not None:
            over = state.getCurrentWatermarkMs() * 1000 - int(patience * 1e6)  # times are whole microseconds
            certain = max(certain, int(np.searchsorted(t, over, "right")))
        if certain:
            last = float(fixed[certain - 1])
        state.update((last, done + certain, version + 1, t[certain:].tolist(), v[certain:].tolist()))
        if patience is not None and certain < len(t):
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (int(t[certain]) + int(patience * 1e6)) // 1000 + 1))
        for a in range(0, max(1, len(t)), GIVEN):
            own = slice(a, a + GIVEN)
            n = len(t[own])
            yield pd.DataFrame({"key": [k[0]] * n, "nth": np.arange(done + a, done + a + n), "version": version, "t": pd.to_datetime(t[own], unit="us"), "v": v[own], "corrected": fixed[own], "certain": np.arange(a, a + n) < certain})

    return step


def corrected(stream: DataFrame, key: str, time: str, value: str, threshold: float = 1.5, late: str = "30 days", patience: float | None = None) -> DataFrame:
    """Each key's values in order of time, one that is missing or above ``threshold`` times the corrected one before it
    replaced by the mean of that one and the next acceptable value.

    A value that waits for a later one is given at once, as if none followed, and again whenever its key gets rows:
    ``nth`` is its place in its key, ``version`` counts a key's batches, and the last version of each place
    (``latest``) is what the batch form gives for all rows so far. A key's rows of a batch are held as two arrays, some tens
    of bytes a row, and handed on in pieces. Rows that wait are held in the state; with
    ``patience`` (seconds) they wait no longer once the watermark is that far beyond them, which bounds the state. Rows
    older than a certain one come too late to change it.
    """

    told = stream.withWatermark(time, late).select(F.col(key).cast("string").alias("key"), F.col(time).alias("t"), F.col(value).cast("double").alias("v"))
    held = "last double, done long, version long, times array<long>, values array<double>"
    wait = GroupStateTimeout.NoTimeout if patience is None else GroupStateTimeout.EventTimeTimeout
    return told.groupBy("key").applyInPandasWithState(correcting(threshold, patience), CORRECTED, held, "append", wait)


def latest(given: DataFrame) -> DataFrame:
    """The last version of each place of what ``corrected`` has given."""
    row = F.max_by(F.struct("t", "v", "corrected", "certain"), "version").alias("row")
    return given.groupBy("key", "nth").agg(row).select("key", "nth", "row.*")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All results over what is there now, written to a folder and read from it; nothing passes through the driver."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that is there now, appended to a folder; for results of any size."""
    stream.writeStream.format("parquet").option("path", path).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
