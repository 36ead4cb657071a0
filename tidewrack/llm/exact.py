"""Exact dedup against a history that is held as a minimal perfect hash.

The distinct digests of the history are dealt into shards by hash. In each shard a displacement is searched for every
small bucket of digests until all digests of the shard have slots of their own, as many slots as digests. The index is
a table of slots (full digest, the winner's locator, the group's size) and one of bucket displacements. A document
finds its bucket, then its slot, by two equi-joins, and repeats the history only if the slot's digest is its own byte
for byte. Documents that don't are grouped among themselves.

Texts are equal when identical after deleting every blank, tab, line feed, vertical tab, form feed and carriage
return; of equal texts the row with the most code points in the original stays, then the smallest id.

Defined results: a null text counts as empty, and all texts without other characters are equal; a null id loses every
tie and is never a winner unless all of its group lack one; rows that repeat id and text share one answer; an empty
history makes every document a non-member; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import SPACE, cut

#: Digests to a shard and to a bucket, on average; a shard is built by one call in one task.
SHARD_KEYS, BUCKET_KEYS = 4096, 4
#: Displacements tried for a bucket before its digests are left out of the index (they then count as non-members).
TRIES = 1 << 20
#: Slots come from the hash modulo a prime, then the number of slots: an exclusive or alone keeps differences.
PRIME = (1 << 31) - 1


def keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, length): SHA-256 of the normalised text in UTF-8, and the original's code points."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(F.translate(whole, SPACE, ""), 256)).alias("digest"), F.length(whole).cast("long").alias("length"))


def winners(keyed: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size): one row for each distinct digest."""
    best = F.min(F.struct((-F.col("length")).alias("short"), F.col("doc_id").isNull().alias("unnamed"), "doc_id"))
    return keyed.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")).select("digest", F.col("best.doc_id").alias("keep_id"), "group_size")


def _hash(number: int) -> Column:
    return F.xxhash64("digest", F.lit(number))


def _placed(hashes: np.ndarray, buckets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Displacement and slot of each digest of a shard; slot -1 where none was found.

    Full buckets go first. Displacements come from one fixed random sequence, so builds agree.
    """
    draw = np.random.default_rng(20240229)
    moves = draw.integers(-(1 << 62), 1 << 62, 4096)
    move, slot, taken = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
    order = np.argsort(buckets, kind="stable")
    edges = np.flatnonzero(np.diff(buckets[order], prepend=-1, append=-1))
    groups = [order[a:b] for a, b in zip(edges[:-1], edges[1:])]
    for own in sorted(groups, key=len, reverse=True):
        tried, step = 0, 64
        while tried < TRIES:
            if tried + step > len(moves):
                moves = np.concatenate([moves, draw.integers(-(1 << 62), 1 << 62, len(moves))])
            part = moves[tried : tried + step]
            there = (hashes[own][None, :] ^ part[:, None]) % PRIME % n
            good = ~taken[there].any(axis=1)
            if len(own) > 1:
                good &= (np.diff(np.sort(there, axis=1), axis=1) > 0).all(axis=1)
            if good.any():
                k = int(good.argmax())
                move[own], slot[own], taken[there[k]] = part[k], there[k], True
                break
            tried, step = tried + step, min(step * 2, 4096)
    return move, slot


def _dealt(rows: DataFrame, shards: int) -> DataFrame:
    shard, bucket = F.pmod(_hash(1), F.lit(shards)), F.pmod(_hash(2), F.lit(SHARD_KEYS // BUCKET_KEYS))
    return rows.withColumn("shard", shard).withColumn("bucket", bucket).withColumn("hash", _hash(3))


def build_index(history: DataFrame) -> DataFrame:
    """The index of a ``winners`` table: a row for each slot (``leads``: the first of its bucket)."""
    history = cut(history)
    shards = max(1, -(-history.count() // SHARD_KEYS))
    names = ["digest", "keep_id", "group_size", "shard", "bucket"]

    def place(own: pa.Table) -> pa.Table:
        buckets = own["bucket"].to_numpy()
        move, slot = _placed(own["hash"].to_numpy(), buckets, own.num_rows)
        leads = np.zeros(own.num_rows, bool)
        leads[np.unique(buckets, return_index=True)[1]] = True
        found = own.select(names)
        for name, column in (("move", move), ("slot", slot), ("slots", np.full(len(slot), len(slot))), ("shards", np.full(len(slot), shards)), ("leads", leads)):
            found = found.append_column(name, pa.array(column))
        return found.filter(pa.array(slot >= 0))

    schema = "digest binary, keep_id long, group_size long, shard long, bucket long, move long, slot long, slots long, shards long, leads boolean"
    return cut(_dealt(history, shards).groupBy("shard").applyInArrow(place, schema))


def look_up(keyed: DataFrame, index: DataFrame) -> DataFrame:
    """``keyed`` with member, keep_id and group_size (both null for non-members)."""
    first = index.select("shards").first()
    if first is None:
        return keyed.select("*", F.lit(False).alias("member"), F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
    moves = index.where("leads").select("shard", "bucket", "move", "slots")  # no aggregate: Spark may split hot texts in the join
    slots = index.select("shard", "slot", F.col("digest").alias("held"), "keep_id", "group_size")
    asked = _dealt(keyed, first["shards"])
    asked = asked.join(moves, ["shard", "bucket"], "left")
    asked = asked.withColumn("slot", F.pmod(F.pmod(F.col("hash").bitwiseXOR(F.col("move")), F.lit(PRIME)), F.col("slots")))
    found = asked.join(slots, ["shard", "slot"], "left").withColumn("member", F.coalesce(F.col("held") == F.col("digest"), F.lit(False)))
    return found.select(*keyed.columns, "member", *(F.when(F.col("member"), F.col(c)).alias(c) for c in ("keep_id", "group_size")))


def dedup(docs: DataFrame, history: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, digest, member, keep_id, group_size, kept.

    ``history`` is a ``winners`` table of an earlier corpus; its members' repeats go. Without one, the documents' own
    distinct digests are the history, so that each document repeats its group's winner.
    """
    keyed = cut(keys(docs, doc_id, text))
    own = history is None
    found = look_up(keyed, build_index(winners(keyed) if own else history))
    found = cut(found)
    others = found.where(~F.col("member"))
    if not others.isEmpty():
        grouped = others.select("doc_id", "digest", "length", "member").join(winners(others.select("doc_id", "digest", "length")), "digest")
        found = found.where("member").unionByName(grouped)
    kept = F.col("keep_id").eqNullSafe(F.col("doc_id")) & (F.lit(own) | ~F.col("member"))
    return found.select("doc_id", "digest", "member", "keep_id", "group_size", kept.alias("kept"))


def groups(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return dedup(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
