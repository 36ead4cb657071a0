"""Column expressions for headers, names, keys and lenient casts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Text that stands for a missing value in the input files.
MISSING = ("", "NA", "na", "NaN", "nan", "n.a.", "n.c", "n.c.", "None", "null")


def clean_header(name: str, keep_spaces: bool = False, ascii_only: bool = False) -> str:
    """A header without byte-order mark, in NFKC, trimmed and in lower case; inner spaces go or become one."""
    name = unicodedata.normalize("NFKC", name.replace("﻿", "")).strip()
    if ascii_only:
        name = name.encode("ascii", "ignore").decode()
    name = re.sub(r"\s+", " " if keep_spaces else "", name)
    return name if keep_spaces else name.lower()


def clean_headers(df: DataFrame, **how: bool) -> DataFrame:
    return df.toDF(*(clean_header(c, **how) for c in df.columns))


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def clean_text(c: Column, normalise: bool = True, collapse: bool = True) -> Column:
    """Cell text in NFKC without control characters, runs of white space as one blank, trimmed.

    SQL has no NFKC, so only text with characters beyond ASCII takes the way through Python.
    """
    if normalise:
        c = F.when(c.rlike(r"[^\x00-\x7F]"), _nfkc(c)).otherwise(c)
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.trim(F.regexp_replace(c, r"\s+", " ")) if collapse else c


def clean_species(c: Column) -> Column:
    """A species name in lower case with single blanks, without what follows an open-nomenclature mark (sp., spp., cf., aff.)."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\s+", " "), r"\s+(sp\.|spp\.|cf\.|aff\.).*", "")


def repair_name(c: Column, repairs: Mapping[str, str]) -> Column:
    """A name with each wrongly decoded part replaced."""
    for wrong, right in repairs.items():
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return F.trim(c)


def normal_name(c: Column) -> Column:
    """A name as a join key: lower case, no blanks, no dots."""
    return F.lower(F.regexp_replace(c, r"[ .]", ""))


def normal_shape(c: Column) -> Column:
    """A shape name in lower case, trimmed, with single blanks around its signs."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def slugify(c: Column) -> Column:
    """Lower case, each run of other characters than letters and digits an underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def composite_key(columns: Iterable[str], sep: str = ".") -> Column:
    """Values joined to one key; a null value is the text ``nan``, so that keys with nulls stay apart."""
    return F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns))


def split_key(c: Column, names: Iterable[str], sep: str = ".") -> list[Column]:
    """The parts of a composite key as columns."""
    parts = F.split(c, re.escape(sep))
    return [F.get(parts, i).alias(n) for i, n in enumerate(names)]


def to_number(c: Column) -> Column:
    """A number, null where the text isn't one or isn't finite."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def comma_number(c: Column) -> Column:
    """A number written with a decimal comma or point."""
    return to_number(F.replace(F.trim(c), F.lit(","), F.lit(".")))


def decimal_column(df: DataFrame, column: str) -> DataFrame:
    """A text column as numbers; where the column shows decimal commas, points are thousands marks."""
    commas = df.agg(F.bool_or(F.col(column).rlike(r"^\s*-?[\d.]*\d,\d+\s*$"))).first()[0]
    c = F.col(column)
    if commas:
        c = F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return df.withColumn(column, to_number(F.trim(c)))


def null_tokens(c: Column, tokens: Iterable[str] = MISSING) -> Column:
    """Null where the text is one of the tokens."""
    return F.when(~F.trim(c).isin(*tokens), c)


def to_flag(c: Column) -> Column:
    """A boolean from text such as yes, true, 1, x; null stays null."""
    return F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "y", "x", "t")


def mapped(c: Column, table: Mapping[str, object], keep: bool = True) -> Column:
    """A value by a small fixed table, compared without regard to case; others stay, or become null."""
    found = F.lit(None)
    for key, value in table.items():
        found = F.coalesce(F.when(F.lower(F.trim(c)) == key.lower().strip(), F.lit(value)), found)
    return F.coalesce(found, c) if keep else found
