"""Connected components of an edge table, with DataFrame operations only.

Alternating large-star and small-star steps: every node points its larger neighbours to the least node it sees, then
its smaller ones and itself likewise, until nothing changes. Each step is a grouped minimum (combined before the
shuffle) and an equi-join that Spark may split where a node is hot; nothing but a count and a checksum of the edges
reaches the driver.

Defined results: loops, repeated edges and edges with a null end are ignored; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that has an edge to another; component is the least node of its group."""
    a, b = F.col(src), F.col(dst)
    now = cut(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    print_before = _print(now)
    while print_before[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(least).distinct())
        print_now = _print(now)
        if print_now == print_before:
            break
        print_before = print_now
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _print(edges: DataFrame) -> tuple[int, int | None]:
    """Number and checksum of the edges; equal for equal tables whatever their order."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
