"""From raw documents to token ids, in five stages; each calls one operator of ``tidewrack.llm`` on all rows it gets.

Decisions are made for rows, whatever their ids: of each group of copies one row stays, also where ids repeat or are
null, and the mix counts each row. Rows equal in all columns are interchangeable; of them so many stay as are asked for.
Each stage's output is written before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewrack.llm import bpe, exact, language, mixing, simhash
from tidewrack.llm.common import SPACE, cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: 128 bits of hash of a whole row.
KEY = ["k1", "k2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``KEY``; nulls are hashed as such, since a hash passes over them."""
    whole = [c for name in COLUMNS for c in (F.col(name).isNull(), F.col(name))]
    return docs.select(*COLUMNS, F.xxhash64(*whole).alias("k1"), F.xxhash64(F.lit(1), *whole).alias("k2"))


def _one_of(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth = 1").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those that no language's statistics code better than raw bytes, go."""
    return language.known_language(docs.select(*COLUMNS))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    keys = ["text_sha256", "id", "unnamed"]
    named = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("unnamed")]
    kept = exact.groups(docs).where("kept").select("text_sha256", *named).distinct()
    digest = F.sha2(F.translate(F.coalesce("text", F.lit("")), SPACE, ""), 256).alias("text_sha256")
    best = docs.select(*COLUMNS, digest, *named).join(kept, keys, "left_semi")
    return _one_of(best, keys, F.length("text").desc_nulls_last(), *COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays."""
    keyed = _keyed(docs)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *KEY)).alias("best")
    kept = simhash.rooted(keyed.select("doc_id", "text", *KEY)).groupBy("root").agg(best).select("best.k1", "best.k2")
    return _one_of(keyed.join(kept, KEY, "left_semi"), KEY, "doc_id")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    keyed = _keyed(docs)
    copies = mixing.mix(keyed, also=KEY).groupBy(*KEY).agg(F.sum("copies").alias("copies"), F.count("*").alias("m")).where("copies > 0")
    # equal rows share their copies evenly, so that none has more than the cap
    told = keyed.join(copies, KEY).withColumn("nth", F.row_number().over(Window.partitionBy(*KEY).orderBy("doc_id")))
    own = F.expr("CAST(nth * copies div m - (nth - 1) * copies div m AS INT)")
    return told.withColumn("own", own).where("own > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("own"))).alias("copy")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of each document, their number and digest, and that of their decoding."""
    coded = bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", "source", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids",
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("tokenize", tokenize)]

#: SQL has no way to express the language, fingerprint and mixing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
