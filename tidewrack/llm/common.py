"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder for cut lineages: the session's ``spark.checkpoint.dir``; a new temporary one only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder, so that later reads outlive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Spark's setting that drops a query's shuffle files as soon as the query ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, but as a compressed table in the shared folder, for what is large; its shuffle files go when it is written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def running_sums(df: DataFrame, key: str, order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """``df`` with each of ``values`` replaced by its sum over the key's rows up to this one.

    Rows are dealt to ranges and summed there; ranges go on from the totals before them. So a key of any size is many tasks.
    """
    dealt = df.withColumn("tie__", F.monotonically_increasing_id())
    dealt = stored(dealt.repartitionByRange(key, *order, "tie__").withColumn("run__", F.spark_partition_id()))
    totals = dealt.groupBy(key, "run__").agg(*(F.sum(v).alias(v) for v in values))
    before = Window.partitionBy(key).orderBy("run__").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = totals.select(key, "run__", *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}__") for v in values))
    inside = Window.partitionBy(key, "run__").orderBy(*order, "tie__").rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({v: F.sum(v).over(inside) for v in values}).join(starts, [key, "run__"])
    return summed.select(*(((F.col(c) + F.col(f"{c}__")).alias(c) if c in values else F.col(c)) for c in df.columns))
