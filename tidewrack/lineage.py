"""Cuts in long lineages, for what runs in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder where none is set and one machine is all there is."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None and spark.sparkContext.master.startswith("local"):
        named = tempfile.mkdtemp(prefix="spark-shared-")
    if named is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder, so that a lost executor costs no earlier round."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of a file of ``written``. A scan's task takes at most 32 files, so that it never holds more than some four million rows.
FILE = 1 << 17


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once into a compressed table in the shared folder, for what is large and read over and over."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", FILE).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
