"""Size classes of fixed width, life forms and the choice between thresholded outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.measures import safe_log

# How many classes there are and how many of them each super-group takes, in order.
CLASSES, SUPER_GROUPS = 16, (2, 3, 3, 3, 3, 2)


def size_classes(df: DataFrame, keys: Sequence[str], taxon: str, size: str, weight: str, base: float = 2.0) -> DataFrame:
    """(keys..., size_class, super_group, total): weight by class of the taxon's mean size, classes one wide on the log
    axis from the floor of the smallest, values beyond the last one in it, missing classes 0."""
    taxa = df.groupBy(*keys, taxon).agg(F.avg(size).alias("size"), F.sum(weight).alias("weight")).withColumn("log", safe_log(F.col("size"), base)).where("log is not null")
    least = taxa.agg(F.floor(F.min("log")).alias("edge"))
    placed = taxa.crossJoin(F.broadcast(least)).withColumn("size_class", F.least(F.greatest(F.floor(F.col("log") - F.col("edge")) + 1, F.lit(1)), F.lit(CLASSES)).cast("int"))  # one row
    summed = placed.groupBy(*keys, "size_class").agg(F.sum("weight").alias("total"))
    grid = taxa.select(*keys).distinct().withColumn("size_class", F.explode(F.sequence(F.lit(1), F.lit(CLASSES))))
    group, upto = F.lit(None).cast("int"), CLASSES
    for k in range(len(SUPER_GROUPS), 0, -1):
        group = F.when(F.col("size_class") <= upto, k).otherwise(group)
        upto -= SUPER_GROUPS[k - 1]
    return grid.join(summed, [*keys, "size_class"], "left").select(*keys, "size_class", group.alias("super_group"), F.coalesce("total", F.lit(0.0)).alias("total"))


def life_form(non_colonial: Column, colonial: Column, both: Column) -> Column:
    """Life form from three 0/1 flags."""
    return (
        F.when((colonial == 1) & (both == 1), "Solitary/Colonial").when(colonial == 1, "Colonial")
        .when((non_colonial == 1) & (F.coalesce(colonial, F.lit(0)) == 0), "Non-colonial").when(both == 1, "Solitary/Colonial").otherwise("Unknown")
    )


def best_threshold(files: DataFrame, name: str, pattern: str = r"(\d+)") -> DataFrame:
    """The file with the highest number in its name."""
    return files.agg(F.max_by(name, F.regexp_extract(name, pattern, 1).try_cast("int")).alias(name))


def flow(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """(source, target, freq): edges between the values of levels that follow each other."""
    parts = [df.groupBy(F.concat(F.lit(f"{a}:"), F.col(a)).alias("source"), F.concat(F.lit(f"{b}:"), F.col(b)).alias("target")).agg(F.count("*").alias("freq")) for a, b in zip(levels, levels[1:])]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
