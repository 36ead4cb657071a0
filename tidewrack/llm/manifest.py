"""A Merkle manifest of a table, held as an external node store.

Leaves are digests of whole rows. They are sorted into runs by tree and order, numbered, and written as level 0 of a
store that is partitioned by level. A pass reads one level of the store and writes the next ``STRIDE``: a task folds
aligned blocks of 2**STRIDE neighbours, so that neither a tree nor a task has to hold more than a block, and the number
of passes is the tree's height over ``STRIDE``. The trees' roots are the leaves of one more tree, built the same way.

Proofs are taken from the store by coordinate, from the top down: a block's own levels are merged with the path that
its topmost node has above it, which a pass over 1/2**STRIDE as many nodes has found before.

A digest H is lowercase hexadecimal SHA-256; inputs are concatenated, digests as their hexadecimal text. Every two
consecutive nodes become their H while a tree has more than one; a last node alone becomes the H of itself.

Defined results: a null value is written as ``-`` and can't be mistaken for a text ``-``, which has its length before
it; null order values come first, rows of one order value follow their leaf digest, and rows that repeat altogether are
leaves of their own; a null tree value is a tree of its own, before all others; a tree of one leaf has that leaf as its
root, and one tree's root is the whole root; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.llm.common import shared_folder, stored

#: Levels that one pass adds; a block has 2**STRIDE nodes.
STRIDE = 12
#: The columns that make a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(fields: Sequence[Column]) -> Column:
    """H of named columns: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*told), 256)


def _joined(nodes: Sequence[str]) -> str:
    return hashlib.sha256("".join(nodes).encode("ascii")).hexdigest()


def _height(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    return (leaves - 1).bit_length()


def _heights() -> Column:
    return F.when(F.col("n") == 1, 0).otherwise(F.length(F.bin(F.col("n") - 1)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``at``: a row's place in its own run and tree. Rows come sorted, so one counter is enough."""
    tree, n = None, 0
    for batch in batches:
        places = []
        for own in batch.column("tree").to_pylist():
            n = n + 1 if own == tree else 0
            tree = own
            places.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "at"])


def numbered(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """``leaves`` with idx (place in their tree) and n (leaves of the tree); stored as sorted runs.

    Rows are dealt to ranges, so that a large tree is many runs; a table of runs and trees tells where each run begins.
    """
    told = leaves.withColumn("tie__", F.monotonically_increasing_id())  # rows that repeat altogether can go to several ranges
    by = ["tree", *(F.col(c).asc_nulls_first() for c in order), "tie__"]
    runs = told.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie__")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema) + ", at long"
    runs = stored(runs.mapInArrow(_counted, schema).withColumn("run", F.spark_partition_id()))
    sizes = runs.groupBy("tree", "run").agg(F.count("*").alias("own"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("own").over(whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("tree", "run", before.alias("before"), F.sum("own").over(whole).alias("n"))
    return runs.join(starts, ["tree", "run"]).withColumn("idx", F.col("at") + F.col("before")).drop("at", "run", "before")


def _fold(level: int, step: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def fold(key: tuple, own: pa.Table) -> pa.Table:
        tree, block = key[0].as_py(), key[1].as_py()
        own = own.sort_by("idx")
        nodes, n = own["node"].to_pylist(), own["n"][0].as_py()
        rows: dict[str, list] = {"level": [], "tree": [], "n": [], "idx": [], "node": []}
        first = block << step
        for up in range(level + 1, min(level + step, _height(n)) + 1):
            nodes, first = [_joined(nodes[k : k + 2]) for k in range(0, len(nodes), 2)], first >> 1
            for name, values in (("level", [up] * len(nodes)), ("tree", [tree] * len(nodes)), ("n", [n] * len(nodes)), ("idx", range(first, first + len(nodes))), ("node", nodes)):
                rows[name].extend(values)
        return pa.table(rows, pa.schema([("level", pa.int32()), ("tree", pa.string()), ("n", pa.int64()), ("idx", pa.int64()), ("node", pa.string())]))

    return fold


class Store:
    """The nodes of a forest, one row each: level, tree, n (leaves of its tree), idx, node."""

    SCHEMA = "tree string, n long, idx long, node string, level int"

    def __init__(self, leaves: DataFrame, step: int = STRIDE):
        """``leaves`` has tree, n, idx and node; a pass adds ``step`` levels."""
        self.spark, self.step = leaves.sparkSession, step
        self.path = f"{shared_folder(self.spark)}/manifest-{uuid.uuid4().hex}"
        self._add(leaves.select("tree", "n", "idx", "node", F.lit(0).alias("level")))
        most = self.nodes().where("level = 0").agg(F.max("n")).first()[0] or 0
        self.height = _height(most) if most else 0
        for level in range(0, self.height, step):
            below = self.nodes().where((F.col("level") == level) & (F.col("n") > F.lit(1 << level)))
            blocks = below.groupBy("tree", F.shiftright("idx", step).alias("block"))
            self._add(blocks.applyInArrow(_fold(level, step), "level int, tree string, n long, idx long, node string"))

    def _add(self, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("level").option("compression", "zstd").parquet(self.path)

    def nodes(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def tops(self) -> DataFrame:
        """(tree, node): each tree's root."""
        return self.nodes().where((F.col("idx") == 0) & (F.col("level") == _heights())).select("tree", "node")

    def merged(self, above: DataFrame, leaves: DataFrame, proofs: bool = False) -> DataFrame:
        """``leaves`` (tree, n, idx, leaf and others) with path: sibling digests from the leaf to the root, each preceded
        by ``<`` or ``>`` for its side, ``.`` where a node has none. With ``proofs``, what ``_proved`` makes of it instead.

        ``above`` has (tree, path): what is above each tree's root.
        """
        zero, last = F.lit(0).cast("long").alias("idx"), F.greatest(F.lit(0), F.floor((_heights() - 1) / self.step))
        trees = self.nodes().where("level = 0 AND idx = 0").select("tree", last.alias("stride")).join(above, "tree")
        found = None
        for stride in range(max(0, self.height - 1) // self.step, -1, -1):
            level = stride * self.step
            asked = self.nodes().where((F.col("level") == level) & (F.col("n") > F.lit(1 << level))).select("tree", "n", "idx", F.col("node").alias("leaf")) if stride else leaves
            held = self.nodes().where(F.col("level").between(level, level + self.step - 1)).select("tree", F.call_function("shiftright", "idx", F.lit(level + self.step) - F.col("level")).alias("block"), "level", "idx", "node")
            rest = trees.where(F.col("stride") == stride).select("tree", zero.alias("block"), "path")
            if found is not None:
                rest = rest.unionByName(found.select("tree", F.col("idx").alias("block"), "path"))
            others = held.unionByName(rest.select("tree", "block", F.lit(-1).alias("level"), zero, F.col("path").alias("node")))
            sides = asked.withColumn("block", F.shiftright("idx", self.step)).groupBy("tree", "block").cogroup(others.groupBy("tree", "block"))
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)
            if proofs and not stride:
                return sides.applyInArrow(_merge(level, self.step, asked.columns, True), f"{fields}, subroot string, proof_sha256 string, folded_root string")
            found = stored(sides.applyInArrow(_merge(level, self.step, asked.columns), f"{fields}, path string"))
        return found


def _merge(level: int, step: int, columns: Sequence[str], proofs: bool = False) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def merge(asked: pa.Table, held: pa.Table) -> pa.Table:
        nodes = dict(zip(zip(held["level"].to_pylist(), held["idx"].to_pylist()), held["node"].to_pylist()))
        rest, paths = nodes.get((-1, 0), ""), []
        for idx, n in zip(asked["idx"].to_pylist(), asked["n"].to_pylist()):
            path = []
            for up in range(level, min(level + step, _height(n))):
                at = idx >> (up - level)
                other = nodes.get((up, at ^ 1))
                path.append("." if other is None else ("<" if at & 1 else ">") + other)
            paths.append("".join(path) + rest)
        told = asked.select(list(columns))
        if not proofs:
            return told.append_column("path", pa.array(paths, pa.string()))
        for name, values in _proved(asked, paths).items():
            told = told.append_column(name, pa.array(values, pa.string()))
        return told

    return merge


def _proved(asked: pa.Table, paths: Sequence[str]) -> dict[str, list[str]]:
    """Each leaf's own root, the digest of its siblings, and the root that the row as it was found leads to."""
    heights = [_height(n) for n in asked["n"].to_pylist()]
    return {
        "subroot": [fold_path(a, p, h) for a, p, h in zip(asked["leaf"].to_pylist(), paths, heights)],
        "proof_sha256": [siblings_digest(p) for p in paths],
        "folded_root": [fold_path(a, p) for a, p in zip(asked["seen"].to_pylist(), paths)],
    }


def _steps(path: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(path):
        side = path[at]
        yield side, "" if side == "." else path[at + 1 : at + 65]
        at += 1 if side == "." else 65


def fold_path(leaf: str, path: str, most: int | None = None) -> str:
    """The root that a leaf and its path lead to, or the node after ``most`` steps."""
    for side, other in islice(_steps(path), most):
        leaf = _joined([other, leaf] if side == "<" else [leaf, other])
    return leaf


def siblings_digest(path: str) -> str:
    """H of a path's siblings."""
    return _joined([other for _, other in _steps(path)])


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, tree: str = "lang", order: str = "doc_id", seen: dict[str, Column] | None = None, step: int = STRIDE) -> DataFrame:
    """One row per row: the order column, leaf, subroot, root, proof_sha256, folded_root and verified.

    ``seen`` has expressions for what is found in place of some columns when the rows are verified; without it, every
    row verifies.
    """
    leaf, found = digest([F.col(c) for c in fields]), digest([(seen or {}).get(c, F.col(c)) for c in fields])
    key = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))  # null first, then by bytes
    rows = stored(docs.select(key.alias("tree"), F.col(order).alias("order"), leaf.alias("leaf"), found.alias("seen")))
    leaves = stored(numbered(rows, ["order", "leaf"]))
    forest = Store(leaves.withColumnRenamed("leaf", "node"), step)
    names = stored(numbered(forest.tops().select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("node").alias("leaf")), ["name"]))
    trunk = Store(names.withColumnRenamed("leaf", "node"), step)
    root = trunk.tops().select(F.col("node").alias("root"))
    bare = docs.sparkSession.range(1).select(F.lit("").alias("tree"), F.lit("").alias("path"))
    above = trunk.merged(bare, names).select(F.col("name").alias("tree"), "path")
    told = forest.merged(above, leaves, proofs=True).crossJoin(F.broadcast(root))  # one row
    return told.select(F.col("order").alias(order), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def verified(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``, with one more character claimed where 7 divides the id's CRC-32."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(docs, seen={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
