"""Prefix trie of conversations, finished in sorted shards around a skeleton of splitter paths.

A conversation's path is the row of its turns' digests. Paths are dealt out to shards by ranges
between splitters, sorted within each. A node's members are neighbours in that order, so a node lies
in one shard unless it is a prefix of a splitter. The splitters' own trie, the skeleton, is
broadcast: each shard walks its sorted paths with a stack, finishes every other node by itself and
hands in a partial aggregate for each skeleton node that it touches. These are added up, and the
skeleton's own sums pass up to its nodes' ancestors.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.functions.lineage import cut_lineage

#: Conversations whose first turns stand in for the first turns of their group's others.
GROUP, HEADS = 20, 4
#: Bytes of a turn's digest.
TURN = 16
#: Conversations in a shard, about, and shards at most.
SHARD, SHARDS = 20_000, 32_768
#: Turns of a splitter that count. What agrees in more of them stays in one shard.
SPLITTER_TURNS = 64
#: Paths looked at for each splitter. They steer the shards' sizes only.
SAMPLED = 8
#: Ids in a piece of a skeleton node's list of ends, and finished nodes handed on at a time.
PIECE, ROWS = 4096, 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


# --- paths -----------------------------------------------------------------------------------------


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of a turn; the role's length keeps the two apart."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(whole, 256), 1, 2 * TURN)


def paths(table: DataFrame) -> DataFrame:
    """``conv_id, path, words`` of every rebuilt conversation.

    ``path`` joins the turns' digests, ``words`` counts each turn's words. Texts stay where they are
    read: only digests and counts are shuffled.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = table.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("numbered"),
            F.col("turn").alias("turn"),
            turn_digest(role, text).alias("digest"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
        ).alias("t"),
    )
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    rows = rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))
    heads = rows.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    joined = rows.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")).join(heads, base == F.col("base"), "left")
    none = F.slice("turns", 1, 0)
    rebuilt = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    built = joined.select("conv_id", rebuilt.alias("turns"))
    return built.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("path"), F.col("turns.words").alias("words"))


# --- the skeleton ----------------------------------------------------------------------------------


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their beginnings."""
    n = min(len(a), len(b)) // TURN
    if a[: n * TURN] == b[: n * TURN]:
        return n
    low = 0
    while low < n:  # the first n turns differ somewhere
        middle = (low + n) // 2
        if a[: (middle + 1) * TURN] == b[: (middle + 1) * TURN]:
            low = middle + 1
        else:
            n = middle
    return low


class Skeleton(NamedTuple):
    """Sorted splitters ``(path, conv_id)`` and the numbers of their prefixes' nodes.

    ``nodes[i][d]`` is the node of the first ``d`` turns of splitter ``i``; equal prefixes have one
    number, the root is 0. Shard ``i`` lies between splitters ``i - 1`` and ``i``. At most
    ``SHARDS * SPLITTER_TURNS`` nodes and as many digests.
    """

    splitters: list[tuple[bytes, int]]
    nodes: list[list[int]]

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect.bisect_right(self.splitters, (path, conv_id))

    def lines(self, shard: int) -> list[tuple[bytes, list[int]]]:
        """Paths and nodes of the splitters beside a shard: no other skeleton node has members there."""
        return [(self.splitters[i][0], self.nodes[i]) for i in (shard - 1, shard) if 0 <= i < len(self.splitters)]


def skeleton_of(sample: list[tuple[bytes, int]], shards: int) -> Skeleton:
    """Splitters at even steps of sorted sample paths. A path cut short stands before all that start with it."""
    cut = SPLITTER_TURNS * TURN
    ranked = sorted((p[:cut], c if len(p) <= cut else -(2**63)) for p, c in sample)
    picked = sorted({ranked[len(ranked) * i // shards] for i in range(1, shards)}) if ranked else []
    nodes: list[list[int]] = []
    fresh = 1
    for i, (path, _) in enumerate(picked):
        same = common_turns(picked[i - 1][0], path) if i else 0
        turns = len(path) // TURN
        own = nodes[-1][: same + 1] if i else [0]
        nodes.append([*own, *range(fresh, fresh + turns - same)])
        fresh += turns - same
    return Skeleton(picked, nodes)


def skeleton(rows: DataFrame) -> Skeleton:
    """Splitters for written ``paths`` from a sample by hash; its size is bounded."""
    shards = min(SHARDS, rows.count() // SHARD + 1)
    shards = max(shards, min(SHARDS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cut = SPLITTER_TURNS * TURN
    sample = rows.orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLED * shards).select(F.substring("path", 1, cut + 1), "conv_id")
    return skeleton_of([(bytes(r[0]), r[1]) for r in sample.collect()], shards)


# --- one shard -------------------------------------------------------------------------------------


class Node:
    """A node on the stack: what has been seen of it so far in this shard."""

    __slots__ = ("children", "ends", "first", "key", "leaves", "members", "open", "pieces", "saved", "waiting", "words")

    def __init__(self, key: int, words: int):
        self.key = key  # number in the skeleton, or -1
        self.words = words
        self.first = 2**63 - 1
        self.members = self.children = self.leaves = self.saved = 0
        self.ends = None  # running hash of a finished node's ends
        self.open: list[str] = []  # ends of a skeleton node that are not handed in yet
        self.pieces = 0
        self.waiting: list[int] = []  # finished children that wait for this node's first member


#: Rows of a walk: finished nodes, a shard's part in a skeleton node, and pieces of its list of ends.
SHAPE = (
    "kind tinyint, conv_id bigint, depth bigint, parent_conv_id bigint, parent_node bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string, node bigint, line array<bigint>, words bigint, shard bigint, piece bigint, ends string"
)
NAMES = [c.split()[0] for c in SHAPE.split(", ")]
TYPES = [pa.int8(), *[pa.int64()] * 8, pa.string(), pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * 3, pa.string()]
FINISHED_ROW, PARTIAL_ROW, ENDS_ROW = 0, 1, 2


class Shard:
    """Walks one shard's sorted paths; ``rows`` fills with what can be handed on.

    Held are the nodes of one path and the finished nodes below one that is neither finished nor in
    the skeleton, which has no more members than the shard.
    """

    def __init__(self, number: int, skeleton: Skeleton):
        self.number = number
        self.lines = skeleton.lines(number)
        self.rows: list[tuple] = []
        self.held: dict[int, list] = {}
        self.named = 0
        self.path = b""
        self.stack = [Node(0, 0)]

    def add(self, conv_id: int, path: bytes, words: list[int]) -> None:
        self.leave(common_turns(self.path, path))
        while len(self.stack) <= len(path) // TURN:
            depth = len(self.stack)
            key = next((nodes[depth] for line, nodes in self.lines if len(nodes) > depth and line[: depth * TURN] == path[: depth * TURN]), -1) if self.stack[-1].key >= 0 else -1
            self.stack.append(Node(key, words[depth - 1]))
        self.path = path
        for node in self.stack:
            node.members += 1
            node.first = min(node.first, conv_id)
        last = self.stack[-1]
        if last.key >= 0:
            last.open.append(str(conv_id))
            if len(last.open) == PIECE:
                self.hand_in(last)
        elif last.ends is None:
            last.ends = hashlib.sha256(str(conv_id).encode())
        else:
            last.ends.update(b",%d" % conv_id)

    def hand_in(self, node: Node) -> None:
        if node.open:
            self.rows.append((ENDS_ROW, *[None] * 9, node.key, None, None, self.number, node.pieces, ",".join(node.open)))
            node.open, node.pieces = [], node.pieces + 1

    def leave(self, depth: int) -> None:
        """Take nodes deeper than ``depth`` off the stack."""
        while len(self.stack) > depth + 1:
            self.close(self.stack.pop())

    def finish(self) -> None:
        self.leave(0)
        self.close(self.stack.pop())

    def close(self, node: Node) -> None:
        depth = len(self.stack)
        parent = self.stack[-1] if self.stack else None
        if node.key >= 0:
            self.hand_in(node)
            line = [n.key for n in self.stack] + [node.key]
            self.rows.append((PARTIAL_ROW, node.first, depth, None, None, node.members, node.children, node.leaves, node.saved, None, node.key, line, node.words, self.number, None, None))
            return
        node.leaves = node.leaves or 1
        node.saved += (node.members - 1) * node.words
        parent.children += 1
        parent.leaves += node.leaves
        parent.saved += node.saved
        for name in node.waiting:
            done = self.held.pop(name)
            done[3] = node.first
            self.rows.append((*done, *[None] * 6))
        ends = node.ends.hexdigest() if node.ends is not None else NO_ENDS
        done = [FINISHED_ROW, node.first, depth, None, None, node.members, node.children, node.leaves, node.saved, ends]
        if parent.key >= 0:
            done[4] = parent.key
            self.rows.append((*done, *[None] * 6))
        else:
            self.held[self.named] = done
            parent.waiting.append(self.named)
            self.named += 1


def walked(rows: DataFrame, skeleton: Skeleton) -> DataFrame:
    """Finished nodes, partial aggregates and pieces of ends of all shards, told apart by ``kind``."""
    shared = rows.sparkSession.sparkContext.broadcast(skeleton)

    @F.arrow_udf("bigint")
    def shard(path: pa.Array, conv_id: pa.Array) -> pa.Array:
        place = shared.value.shard
        return pa.array([place(p, c) for p, c in zip(path.to_pylist(), conv_id.to_pylist(), strict=True)], pa.int64())

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else [[]] * len(NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Shard | None = None
        for batch in batches:
            for number, path, conv_id, words in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if own is None or own.number != number:
                    if own is not None:
                        own.finish()
                        yield batch_of(own.rows)
                    own = Shard(number, shared.value)
                own.add(conv_id, path, words)
                if len(own.rows) >= ROWS:
                    yield batch_of(own.rows)
                    own.rows = []
        if own is not None:
            own.finish()
            yield batch_of(own.rows)

    dealt = rows.select(shard("path", "conv_id").alias("shard"), "path", "conv_id", "words")
    dealt = dealt.repartitionByRange(len(skeleton.splitters) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")
    return dealt.mapInArrow(run, SHAPE)


def joined_ends(pieces: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of skeleton nodes that are the end of some conversation.

    A hash takes its input in order, so a node's pieces stream through one task; each stands for up
    to ``PIECE`` ids and none is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, total = None, None
        done: list[tuple[int, str]] = []
        for batch in batches:
            for own, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != node:
                    if total is not None:
                        done.append((node, total.hexdigest()))
                    node, total = own, hashlib.sha256(ends.encode())
                else:
                    total.update(b"," + ends.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int64(), pa.string()))], ["node", "ends_sha256"])
            done = []
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([total.hexdigest()])], ["node", "ends_sha256"])

    rows = pieces.select("node", "ends", "shard", "piece").repartition("node").sortWithinPartitions("node", "shard", "piece")
    return rows.select("node", "ends").mapInArrow(run, "node bigint, ends_sha256 string")


def trie(table: DataFrame) -> DataFrame:
    """All nodes of the trie of rebuilt conversations (``conv_id, turn, role, text``).

    Returns ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``. Turns are ordered by number, null first; those of one number by their digest, so
    repeated rows are turns of their own. Rows without ``conv_id`` belong to no conversation. Null
    roles and texts are empty ones. Turns are told apart by 128 bits of SHA-256. An empty table has
    no members, so no root either. Other columns are not read. A conversation's digests (16 bytes a
    turn) and counts make up one row.
    """
    rows = cut_lineage(paths(table))
    found = cut_lineage(walked(rows, skeleton(rows)))
    parts = found.where(F.col("kind") == PARTIAL_ROW).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("line").alias("line"), F.first("depth").alias("depth"), F.first("words").alias("words"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    # its parent's place in the line is its own depth
    whole = cut_lineage(parts.withColumn("parent", F.when(F.col("depth") > 0, F.element_at("line", F.col("depth").cast("int")))))
    below = whole.groupBy(F.col("parent").alias("above")).agg(F.count("*").alias("inner"))
    counted = whole.join(below, F.col("node") == F.col("above"), "left").withColumn("n_children", F.col("n_children") + F.coalesce("inner", F.lit(0)))
    own_leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    sums = counted.select(
        F.explode("line").alias("at"), (F.col("n_leaves") + own_leaf).alias("l"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("s")
    ).groupBy("at").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    names = whole.select(F.col("node").alias("named"), F.col("conv_id").alias("parent_conv_id"))
    ends = joined_ends(found.where(F.col("kind") == ENDS_ROW))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = (
        counted.drop("n_leaves", "saved_tokens")
        .join(sums, F.col("node") == F.col("at"))
        .join(names, F.col("parent") == F.col("named"), "left")
        .join(ends, "node", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
        .select(columns)
    )
    # skeleton nodes' names: at most SHARDS * SPLITTER_TURNS rows of two numbers
    top = F.broadcast(names.withColumnRenamed("parent_conv_id", "top_conv_id"))
    rest = found.where(F.col("kind") == FINISHED_ROW).join(top, F.col("parent_node") == F.col("named"), "left")
    return rest.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "top_conv_id")).select(columns).unionAll(inner)
