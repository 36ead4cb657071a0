"""What all plans share: the tables, the observations they are read as, and the registry.

Ecology inputs aren't at hand, so the star schema stands in for them: a line of an order is an observation, its flag and
status the site, its part's brand the taxon and type the phylum, quantity the density and price the biovolume.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

OBS = """obs AS (
    SELECT l_orderkey AS ord, l_linenumber AS line, l_returnflag || '.' || l_linestatus AS site, p_brand AS taxon, p_type AS phylum,
           l_quantity AS density, l_extendedprice AS biovolume, l_discount AS discount, l_tax AS tax, p_size AS size,
           year(l_shipdate) AS year, month(l_shipdate) AS month, CAST(l_shipdate AS DATE) AS day,
           l_returnflag || '.' || l_linestatus || '.' || CAST(year(l_shipdate) AS VARCHAR) AS sample
    FROM lineitem JOIN part ON l_partkey = p_partkey
)"""
SERIES = """series AS (
    SELECT event_type AS kind, CAST(ts AS DATE) AS day, sum(value) AS value, count(*) AS n FROM events GROUP BY 1, 2
)"""
PIXELS = """pixels AS (
    SELECT l_returnflag AS product, year(l_shipdate) AS date, l_partkey // 50 AS row, l_partkey % 50 AS col, avg(l_extendedprice) AS value
    FROM lineitem GROUP BY 1, 2, 3, 4
)"""


def query(sql: str | None = None, name: str | None = None):
    """Registers a plan under its function's name, with the SQL that gives the same rows if there is one."""

    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per observation; the columns that a plan doesn't use aren't read."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    site = F.concat_ws(".", "l_returnflag", "l_linestatus")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"), site.alias("site"), F.col("p_brand").alias("taxon"), F.col("p_type").alias("phylum"),
        F.col("l_quantity").alias("density"), F.col("l_extendedprice").alias("biovolume"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("p_size").alias("size"),
        F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), F.to_date("l_shipdate").alias("day"),
        F.concat_ws(".", site, F.year("l_shipdate").cast("string")).alias("sample"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, day, value, n): daily sums of events."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind"), F.to_date("ts").alias("day")).agg(F.sum("value").alias("value"), F.count("*").alias("n"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product, date, row, col, value): a raster per flag and year, parts being its pixels."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_returnflag").alias("product"), F.year("l_shipdate").alias("date"), F.expr("l_partkey div 50").alias("row"), (F.col("l_partkey") % 50).alias("col")).agg(F.avg("l_extendedprice").alias("value"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles to so many digits, as the SQL rounds them."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
