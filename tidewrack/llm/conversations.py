"""The prefix trie of conversations, merged family first.

A family is the conversations of one base id, a multiple of ``FAMILY``. Conversations and their base are cogrouped;
a task rebuilds each one (its base's first turns, then its own after as many) and builds the family's trie in memory.
Only the tries' nodes are shuffled then, one row for each node of a family however many of its conversations share it,
and merged over families.

A node's name is the sum, in four lanes of 32 bits, of a digest of each of its turns with the turn's place. So a name
can be made from a running sum, and a child's less its own turn is its parent's.

What a family knows of a subtree is final where no other family has the node. Sums over subtrees of shared nodes start
from their unshared children and run up by pointer jumping: in each round a node adds what lies as far below it as it
has summed, so that a depth of d takes log2(d) rounds.

Conversations of more than ``HEAD`` turns are cut: a family's task gets the head, and the rest is numbered and summed
over ranges, so that no key has to fit into a task. A node through which such a rest goes counts as shared.

Defined results: turns are in order of turn (null first), those of one turn number in order of a digest of role and
text; null role or text is empty; rows that repeat are turns of their own; rows without conv_id are no conversation, as
there is no number to rebuild from; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import cut, running_sums, stored

#: Ids of a family; fewer turns than ``SHARED`` are taken from its base.
FAMILY, SHARED = 100, 6
#: Turns of a conversation that a family's task gets; more than a base can give.
HEAD = 5000
#: Families whose ids are put in order together, before a node's are hashed as a stream.
SPAN = 1000
#: Four lanes of 32 bits, each with as many above it to carry into.
LANES = sum(0xFFFFFFFF << (64 * k) for k in range(4))

NODES = "name binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, chars long, family long, ends array<long>, n_children long, n_leaves long, saved long, open boolean"
#: A family's answer: its nodes, and where its long conversations' rests go on (``carried``: the name is the last node's).
FAMILY_ROWS = f"{NODES}, carried boolean"
ROOT = bytes(16)


def _term(digest: bytes, depth: int) -> int:
    """What a turn adds to the name of its node, in lanes."""
    own = hashlib.sha256(digest + str(depth).encode()).digest()
    return sum(int.from_bytes(own[4 * k : 4 * k + 4], "big") << (64 * (3 - k)) for k in range(4))


def _name(lanes: int) -> bytes:
    return b"".join((lanes >> (64 * (3 - k)) & 0xFFFFFFFF).to_bytes(4, "big") for k in range(4))


def shared_turns(conv_id: int) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % SHARED


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, chars) of each row, without its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col("conv_id").isNotNull())
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))


def _base(conv_id: Column) -> Column:
    return conv_id - F.try_mod(conv_id, F.lit(FAMILY).cast("long"))


def _in_order(own: pa.Table) -> dict[int, list[tuple[bytes, int]]]:
    """Each conversation's (digest, characters) in order."""
    conv, turn, digest, chars = (own[c].to_pylist() for c in ("conv_id", "turn", "digest", "chars"))
    found: dict[int, list[tuple[bytes, int]]] = {}
    for c, _, _, d, n in sorted(zip(conv, (t is not None for t in turn), (t or 0 for t in turn), digest, chars)):
        found.setdefault(c, []).append((d, n))
    return found


class Trie:
    """A family's trie; nodes are numbered as they are made, so that parents come before children."""

    def __init__(self):
        self.lanes, self.up, self.depth, self.conv, self.count, self.chars = [0], [-1], [0], [None], [0], [0]
        self.ends: list[list[int]] = [[]]
        self.open = [False]
        self.below: dict[tuple[int, bytes], int] = {}

    def add(self, conv_id: int, path: Sequence[tuple[bytes, int]], goes_on: bool) -> int:
        """Puts in a conversation, ids ascending; the node of its last turn."""
        at = 0
        self._pass(at, conv_id, goes_on)
        for depth, (digest, chars) in enumerate(path, 1):
            child = self.below.get((at, digest))
            if child is None:
                child = self.below[at, digest] = len(self.up)
                self.lanes.append((self.lanes[at] + _term(digest, depth)) & LANES)
                for own, value in ((self.up, at), (self.depth, depth), (self.conv, None), (self.count, 0), (self.chars, chars), (self.ends, []), (self.open, False)):
                    own.append(value)
            at = child
            self._pass(at, conv_id, goes_on)
        if not goes_on:
            self.ends[at].append(conv_id)
        return at

    def _pass(self, at: int, conv_id: int, goes_on: bool) -> None:
        if self.conv[at] is None:
            self.conv[at] = conv_id
        self.count[at] += 1
        self.open[at] |= goes_on

    def table(self, family: int) -> dict[str, list]:
        n = len(self.up)
        kids, leaves, saved = [0] * n, [0] * n, [0] * n
        for k in range(n - 1, -1, -1):
            leaves[k] += kids[k] == 0
            saved[k] += (self.count[k] - 1) * self.chars[k]
            if k:
                kids[self.up[k]] += 1
                leaves[self.up[k]] += leaves[k]
                saved[self.up[k]] += saved[k]
        names = [_name(x) for x in self.lanes]
        return {
            "name": names, "parent": [None if u < 0 else names[u] for u in self.up], "depth": self.depth, "conv_id": self.conv, "parent_conv_id": [None if u < 0 else self.conv[u] for u in self.up], "n_convs": self.count, "chars": self.chars,
            "family": [family] * n, "ends": self.ends, "n_children": kids, "n_leaves": leaves, "saved": saved, "open": self.open, "carried": [False] * n,
        }


def _family(key: tuple, others: pa.Table, base: pa.Table) -> pa.Table:
    """Rebuilds a family's conversations and builds its trie."""
    root = next(iter(_in_order(base).values()), [])
    own = _in_order(others) | _in_order(base)
    long = {c for t in (others, base) for c, more in zip(t["conv_id"].to_pylist(), t["goes_on"].to_pylist()) if more}
    trie, carried = Trie(), []
    for conv in sorted(own):
        taken = shared_turns(conv)
        path = root[:taken] + own[conv][taken:]
        last = trie.add(conv, path, conv in long)
        if conv in long:
            carried.append((conv, last, len(path)))
    rows = trie.table(key[0].as_py())
    for conv, last, depth in carried:
        told = {"name": rows["name"][last], "depth": depth, "conv_id": conv, "carried": True}
        for name, values in rows.items():
            values.append(told.get(name))
    types = {"name": pa.binary(), "parent": pa.binary(), "ends": pa.list_(pa.int64()), "open": pa.bool_(), "carried": pa.bool_()}
    return pa.table(rows, pa.schema([(name, types.get(name, pa.int64())) for name in rows]))


def _lane(name: Column, k: int) -> Column:
    return F.conv(F.hex(F.substring(name, 4 * k + 1, 4)), 16, 10).cast("long")


def _named(lanes: Sequence[Column]) -> Column:
    """A name from its lanes, each modulo 2**32."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.pmod(x, F.lit(1 << 32))), 8, "0") for x in lanes)))


def _rests(numbered: DataFrame, carried: DataFrame, head: int) -> DataFrame:
    """Nodes of what long conversations have after their heads, a row for each conversation and turn."""
    last = numbered.groupBy("conv_id").agg(F.max("at").alias("last"))
    begins = carried.select("conv_id", F.col("depth").alias("depth0"), F.col("name").alias("name0"))
    rest = numbered.where(F.col("at") > head).join(last, "conv_id").join(begins, "conv_id").withColumn("depth", F.col("at") - head + F.col("depth0"))
    term = F.unhex(F.sha2(F.concat("digest", F.col("depth").cast("string").cast("binary")), 256))
    lanes = [f"lane{k}" for k in range(4)]
    rest = rest.withColumn("term", term).select("conv_id", "depth", "chars", "name0", (F.col("at") == F.col("last")).alias("ended"), "term", *(_lane(F.col("term"), k).alias(x) for k, x in enumerate(lanes)))
    rest = running_sums(rest, "conv_id", [F.col("depth")], lanes)
    upto = [F.col(x) + _lane(F.col("name0"), k) for k, x in enumerate(lanes)]
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    return rest.select(
        _named(upto).alias("name"), _named([x - _lane(F.col("term"), k) for k, x in enumerate(upto)]).alias("parent"), "depth", "conv_id", none.alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), "chars",
        _base(F.col("conv_id")).alias("family"), F.when(F.col("ended"), F.array("conv_id")).otherwise(F.array().cast("array<long>")).alias("ends"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved"), F.lit(True).alias("open"),
    )


def family_nodes(conversations: DataFrame, head: int = HEAD) -> DataFrame:
    """The nodes of every family's trie."""
    told = stored(turns(conversations))
    long = told.groupBy("conv_id").count().where(F.col("count") > head).select("conv_id")
    numbered = None
    if long.isEmpty():
        heads = told.withColumn("goes_on", F.lit(False))
    else:
        long = stored(long)
        order = [F.col("turn").asc_nulls_first(), F.col("digest")]
        numbered = stored(running_sums(told.join(long, "conv_id", "left_semi").withColumn("at", F.lit(1).cast("long")), "conv_id", order, ["at"]))
        heads = told.join(long, "conv_id", "left_anti").withColumn("goes_on", F.lit(False))
        heads = heads.unionByName(numbered.where(F.col("at") <= head).drop("at").withColumn("goes_on", F.lit(True)))
    heads = heads.withColumn("family", _base(F.col("conv_id")))
    is_base = F.col("family") == F.col("conv_id")
    bases = heads.where(is_base).select(*(F.col(c).alias(c) for c in heads.columns))  # columns of its own
    sides = heads.where(~is_base).groupBy("family").cogroup(bases.groupBy("family"))
    rows = stored(sides.applyInArrow(_family, FAMILY_ROWS))
    nodes = rows.where(~F.col("carried")).drop("carried")
    return nodes if numbered is None else stored(nodes.unionByName(_rests(numbered, rows.where("carried"), head)))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each name of a sorted run of (name, span, ids); only a digest's state is held."""
    name, state = None, None
    for batch in batches:
        done = []
        for own, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
            text = ",".join(map(str, ids)).encode()
            if own == name:
                state.update(b"," + text)
                continue
            if state is not None:
                done.append((name, state.hexdigest()))
            name, state = own, hashlib.sha256(text)
        yield _digests(done)
    if state is not None:
        yield _digests([(name, state.hexdigest())])


def _digests(rows: Sequence[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["name", "ends_sha256"])


def _endings(nodes: DataFrame) -> DataFrame:
    """(name, ends_sha256) of nodes at which conversations end. Ids of a span of families are put in order first; spans
    follow each other in order of ids."""
    span = F.floor(F.col("family") / (FAMILY * SPAN))
    told = nodes.where(F.size("ends") > 0).groupBy("name", span.alias("span")).agg(F.array_sort(F.flatten(F.collect_list("ends"))).alias("ids"))
    return told.repartition("name").sortWithinPartitions("name", "span").mapInArrow(_hashed, "name binary, ends_sha256 string")


def _summed_up(shared: DataFrame) -> DataFrame:
    """``shared`` (name, jump, n_leaves, saved and others) with n_leaves and saved summed over all below."""
    now = cut(shared)
    while not now.where(F.col("jump").isNotNull()).isEmpty():
        more = now.where(F.col("jump").isNotNull()).groupBy(F.col("jump").alias("name")).agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        # those that are through look themselves up, so that no key is null
        step = now.select(F.col("name").alias("to"), F.col("jump").alias("far"))
        moved = now.withColumn("to", F.coalesce("jump", "name")).join(step, "to").join(more, "name", "left")
        others = [c for c in now.columns if c not in ("jump", "n_leaves", "saved")]
        now = cut(moved.select(*others, F.col("far").alias("jump"), *((F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_leaves", "l"), ("saved", "s")))))
    return now


def prefix_trie(conversations: DataFrame, head: int = HEAD) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``head`` must be ``SHARED`` or more.
    """
    nodes = family_nodes(conversations, head)
    first = [F.first(c).alias(c) for c in ("parent", "depth", "parent_conv_id", "chars", "n_children", "n_leaves", "saved")]
    merged = stored(nodes.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), (F.bool_or("open") | (F.count("*") > 1)).alias("open"), *first))
    top, inner = merged.where("depth = 0"), merged.where("depth > 0")
    final = ~F.col("open")
    kids = inner.where("depth > 1").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("k"), *(F.sum(F.when(final, F.col(c)).otherwise(0)).alias(f"below_{c}") for c in ("n_leaves", "saved")))
    shared = inner.where("open").join(kids, "name", "left").withColumn("n_children", F.coalesce("k", F.lit(0)))
    shared = shared.withColumns({
        "n_leaves": F.coalesce("below_n_leaves", F.lit(0)) + F.when(F.col("n_children") == 0, 1).otherwise(0),
        "saved": F.coalesce("below_saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("chars"),
        "jump": F.when(F.col("depth") > 1, F.col("parent")),
    })
    shared = _summed_up(shared.select("name", "jump", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"))
    rows = inner.where(final).select("name", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved").unionByName(shared.drop("jump"))
    first_turns = rows.where("depth = 1").agg(F.count("*").alias("n_children"), F.greatest(F.lit(1), F.coalesce(F.sum("n_leaves"), F.lit(0))).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))
    root = top.select("name", "depth", "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs").crossJoin(F.broadcast(first_turns))  # one row
    # nodes of depth 1 look up themselves and take the root's, so that the root is no hot key
    told = rows.withColumn("of", F.when(F.col("depth") > 1, F.col("parent")).otherwise(F.col("name")))
    told = told.join(shared.select(F.col("name").alias("of"), F.col("conv_id").alias("shared_conv_id")), "of", "left").crossJoin(F.broadcast(top.select(F.col("conv_id").alias("least"))))  # one row
    known = F.when(F.col("depth") == 1, F.col("least")).otherwise(F.coalesce("shared_conv_id", "parent_conv_id"))
    told = told.withColumn("parent_conv_id", known).select(*root.columns).unionByName(root)
    told = told.join(_endings(nodes), "name", "left")
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
