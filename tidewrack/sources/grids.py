"""Rasters in the ASCII grid format as pixel tables, and back. Binary formats need libraries that aren't here; what they
decode to is the same table (row, col, x, y, value)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, col, x, y, value) of all grids of a folder; nodata cells are null. One file is one task's work."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"]):
                lines = bytes(content).decode("ascii").split("\n")
                head = {k.lower(): float(v) for k, v in (line.split() for line in lines[:6])}
                step, n = head["cellsize"], int(head["nrows"])
                for row, line in enumerate(lines[6 : 6 + n]):
                    cells = pd.Series(line.split(), dtype="float64")
                    yield pd.DataFrame({
                        "file": name.rsplit("/", 1)[-1], "row": row, "col": range(len(cells)),
                        "x": head["xllcorner"] + (pd.Series(range(len(cells))) + 0.5) * step,
                        "y": head["yllcorner"] + (n - row - 0.5) * step,
                        "value": cells.where(cells != head["nodata_value"]),
                    })

    return files.mapInPandas(decode, "file string, row long, col long, x double, y double, value double")


def grid_lines(df: DataFrame, keys: list[str], nodata: float = -9999.0) -> DataFrame:
    """(keys..., row, line): each pixel row as a text line, to be written in the order of rows."""
    cells = df.withColumn("cell", F.coalesce(F.col("value"), F.lit(nodata)).cast("string"))
    rows = cells.groupBy(*keys, "row").agg(F.sort_array(F.collect_list(F.struct("col", "cell"))).alias("cells"))  # as long as a raster is wide
    return rows.select(*keys, "row", F.array_join(F.transform("cells", lambda c: c["cell"]), " ").alias("line"))


def sequence_of(df: DataFrame, keys: list[str], date: str) -> DataFrame:
    """Rasters numbered by date inside each key."""
    dates = df.select(*keys, date).distinct()
    return df.join(dates.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(date))), [*keys, date])
