"""Reading and writing of delimited files whose separator, decimal sign and missing-value texts aren't known.

Files are only ever opened by Spark, so that any store it reads will do: a few lines are peeked at through it, and the
whole is then scanned with what they show.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions.text import MISSING, clean_headers, comma_number, null_tokens, slugify, to_number
from tidewrack.operators.tables import stacked

SEPARATORS = (";", ",", "\t", "|")
ENCODINGS = ("UTF-8", "ISO-8859-1", "UTF-16")


def peek(spark: SparkSession, path: str, n: int = 20) -> list[str]:
    """The first lines of a file or folder."""
    return [r["value"] for r in spark.read.text(path).limit(n).collect()]


def sniff_separator(lines: Sequence[str]) -> str:
    """The separator that parts the lines into the most columns, the same number in each if there is such a one."""
    lines = [line for line in lines if line.strip()]

    def score(sep: str) -> tuple[bool, int]:
        counts = [len(re.sub(r'"[^"]*"', "", line).split(sep)) for line in lines]
        return (len(set(counts)) == 1 and counts[0] > 1, max(counts, default=1))

    return max(SEPARATORS, key=lambda sep: (*score(sep), -SEPARATORS.index(sep)))


def sniff_decimal(lines: Sequence[str], sep: str) -> str:
    """``,`` if cells look like numbers with a decimal comma and none like one with a point."""
    cells = [c.strip().strip('"') for line in lines[1:] for c in line.split(sep)]
    commas, points = (sum(bool(re.fullmatch(rf"-?\d+\{s}\d+", c)) for c in cells) for s in ",.")
    return "," if sep != "," and commas > points else "."


def read_csv(spark: SparkSession, path: str, sep: str | None = None, header: bool = True, schema=None, encoding: str = "UTF-8", missing: Iterable[str] = MISSING, clean: bool = False) -> DataFrame:
    """A CSV file or folder, all columns as text unless a schema is given; missing-value texts become null."""
    reader = spark.read.option("header", header).option("encoding", encoding).option("mode", "PERMISSIVE")
    reader = reader.option("sep", sep or sniff_separator(peek(spark, path)))
    df = (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)
    texts = {c: null_tokens(F.col(c), tuple(missing)).alias(c) for c, t in df.dtypes if t == "string"}
    df = df.withColumns(texts) if texts else df
    return clean_headers(df) if clean else df


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Tries encodings and separators until the file has more than one column."""
    df = None
    for encoding in ENCODINGS:
        df = read_csv(spark, path, encoding=encoding)
        if len(df.columns) > 1 and not any("�" in c or "\x00" in c for c in df.columns):
            return df
    return df


def read_typed(spark: SparkSession, path: str, numbers: Sequence[str]) -> DataFrame:
    """A CSV file with its number columns read leniently, decimal commas if the file has such."""
    lines = peek(spark, path)
    sep = sniff_separator(lines)
    cast = comma_number if sniff_decimal(lines, sep) == "," else (lambda c: to_number(F.trim(c)))
    df = read_csv(spark, path, sep)
    return df.withColumns({c: cast(F.col(c)) for c in numbers if c in df.columns})


def read_folder(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """CSV parts with ragged headers as one table."""
    return stacked(*(read_csv(spark, p) for p in paths))


def with_source(df: DataFrame) -> DataFrame:
    """``df`` with the name of the file that each row came from."""
    return df.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def parsed_name(c, pattern: str, names: Sequence[str]) -> list:
    """Parts of a file name by a pattern's groups, such as product and date."""
    return [F.regexp_extract(c, pattern, i).alias(n) for i, n in enumerate(names, 1)]


def parameters(df: DataFrame, key: str = "action", name: str = "parameter", value: str = "value") -> dict[str, dict[str, str]]:
    """A small config table of action, parameter and value as a dict of dicts."""
    out: dict[str, dict[str, str]] = {}
    for r in df.select(key, name, value).collect():
        out.setdefault(r[0], {})[r[1]] = r[2]
    return out


def roles(spark: SparkSession, path: str, row: int) -> dict[str, str]:
    """A role table without header: line 0 names columns, line ``row`` gives each its role."""
    lines = peek(spark, path, row + 1)
    sep = sniff_separator(lines)
    return {c.strip(): r.strip() for c, r in zip(lines[0].split(sep), lines[row].split(sep)) if r.strip()}


def columns_with_role(table: DataFrame, role: str, skip: Sequence[int] = (), index: str = "row") -> list[str]:
    """Columns that have a role in the first row of a role table, in order of ``index``, that has it at all; rows in ``skip`` are
    not looked at. Case and blanks don't matter."""
    names = [c for c in table.columns if c != index]
    has = [F.upper(F.trim(F.col(c).cast("string"))) == role.upper() for c in names]
    some = F.lit(False)
    for c in has:
        some = some | F.coalesce(c, F.lit(False))
    first = table.where(some & ~F.col(index).isin(list(skip))).orderBy(index).select(*(F.coalesce(c, F.lit(False)).alias(n) for c, n in zip(has, names))).limit(1).collect()
    return [n for n in names if first[0][n]] if first else []


def routed(manifest: DataFrame, route: str, keys: Sequence[str]) -> dict[str, list[str]]:
    """A manifest's rows by route, each row as its keys joined by ``||``."""
    rows = manifest.groupBy(route).agg(F.sort_array(F.collect_list(F.concat_ws("||", *keys))).alias("items"))  # a manifest is small
    return {r[route]: r["items"] for r in rows.collect()}


def write_csv(df: DataFrame, path: str, sep: str = ";", encoding: str = "UTF-8") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("encoding", encoding).csv(path)


def write_split(df: DataFrame, column: str, path: str) -> None:
    """One folder for each value of a column, named by its slug; a value's rows are spread over tasks as they lie."""
    df.withColumn("part", slugify(F.col(column).cast("string"))).write.mode("overwrite").partitionBy("part").option("header", True).csv(path)


def write_kept_and_rejected(df: DataFrame, flag: str, kept: str, rejected: str) -> None:
    """Two outputs by a flag; rows without one are rejected."""
    write_csv(df.where(F.col(flag)).drop(flag), kept)
    write_csv(df.where(~F.coalesce(F.col(flag), F.lit(False))).drop(flag), rejected)


def by_threshold(df: DataFrame, value: str, thresholds: Sequence[float]) -> DataFrame:
    """Each row once for each threshold that its value doesn't pass, to be written by ``threshold``."""
    asked = F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))
    return df.withColumn("threshold", asked).where(F.col(value) <= F.col("threshold") + 1e-12)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report(values: Mapping[str, object], spark: SparkSession) -> DataFrame:
    """A text report as rows of name and value."""
    return spark.createDataFrame([(k, str(v)) for k, v in values.items()], "name string, value string")
