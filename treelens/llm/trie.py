"""The prefix trie of conversations: which turns begin how many of them, and what sharing saves.

A conversation becomes its path, 16 bytes of hash per turn, so that one path
begins another exactly if its conversation does, and sorted paths visit the
trie in depth-first order. Paths are dealt out by splitters chosen from a
bounded sample. A node whose members lie in several shards begins a splitter's
path, so the trie of these paths, the skeleton, is sent to all shards: a shard
finishes every node outside of it while it reads its sorted paths once, with a
stack as deep as the conversation at hand, and adds up what it knows of the
skeleton's nodes. Those are summed over shards, and what is left, one row per
skeleton node, is put together from the bottom up.

Defined results: rows without a conv_id belong to no conversation. Null roles
and texts are empty. Turns of one conversation with the same number, or both
without one, go by the hash of role and text, so repeated rows count as turns
of their own. A conversation without turns of its own after the change is a
member of the root. Other columns are not looked at. An empty table has no
node. Texts are hashed where they are read and not shuffled. The path of a
single conversation, some 40 bytes a turn, must fit into a task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.operators.groups import task_count
from treelens.operators.workspace import written

KEY = 16
NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)
# Rows of a shard: finished nodes below a finished or a skeleton node, shares of skeleton nodes, and their ends.
BELOW_NODE, BELOW_SKELETON, SHARE, ENDS = range(4)
SHARD = (
    "kind int, conv_id long, depth long, parent long, n_convs long, n_children long, n_leaves long, "
    "saved long, size long, ends string"
)
NO_ENDS = sha256().hexdigest()
LOWEST = -(1 << 63)


@dataclass(frozen=True)
class TrieRules:
    """Bytes of paths in a shard, conversations sampled per shard, and nodes of the skeleton.

    The sample decides only where shards begin. More shards than the skeleton's
    limit allows are merged with their neighbours.
    """

    shard_bytes: int = 32 << 20
    sampled: int = 24
    skeleton_nodes: int = 400_000
    ids_per_row: int = 4096


# ---- paths ----


def _turn(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def branched(conversations: DataFrame, every: int = 5, spans: int = 9) -> DataFrame:
    """`conv_id` and its `turns`, rebuilt so that conversations share beginnings.

    Of every `every` consecutive ids, all take the first turns of the first
    one, fewer than `spans` of them by a hash of the id, and go on with their own.
    """
    role, text = _turn("role"), _turn("text")
    key = F.substring(F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * KEY)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("known"),
            F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
            key.alias("key"),
            F.octet_length(text).cast("long").alias("size"),
        ).alias("turn"),
    )
    own = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    first = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, spans - 1).alias("first"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % spans).cast("int")
    based = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("taken", taken)
    start = F.when(F.col("first").isNotNull(), F.slice("first", F.lit(1), F.col("taken")))
    start = F.coalesce(start, F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("taken") + 1, F.size("turns"))
    return based.join(first, "base", "left").select("conv_id", F.concat(start, rest).alias("turns"))


def paths_of(conversations: DataFrame) -> DataFrame:
    """`conv_id`, `path` (one hash after the other) and `sizes` (bytes of the texts)."""
    keys = F.transform("turns", lambda turn: turn["key"])
    return conversations.select(
        "conv_id",
        F.unhex(F.array_join(keys, "")).alias("path"),
        F.transform("turns", lambda turn: turn["size"]).alias("sizes"),
    )


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths begin with alike."""
    most, n = min(len(a), len(b)), 0
    while n < most and a[n : n + KEY] == b[n : n + KEY]:
        n += KEY
    return n // KEY


# ---- skeleton ----


class Skeleton:
    """The trie of the splitters' paths, with a number for every node; 0 is the root."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.child: dict[tuple[int, bytes], int] = {}
        self.parents = [-1]
        for path, _ in splitters:
            node = 0
            for at in range(0, len(path), KEY):
                step = (node, path[at : at + KEY])
                if step not in self.child:
                    self.child[step] = len(self.parents)
                    self.parents.append(node)
                node = self.child[step]


def choose_splitters(sample: list[tuple[bytes, int]], shards: int) -> list[tuple[bytes, int]]:
    """Where shards begin, each no longer than it takes to lie between two sampled paths."""
    weights = [KEY + len(path) for path, _ in sample]
    share, seen, chosen = sum(weights) / shards, 0, []
    for at in range(1, len(sample)):
        seen += weights[at - 1]
        if seen < share * (len(chosen) + 1) or len(chosen) + 1 >= shards:
            continue
        (before, _), (path, conv_id) = sample[at - 1], sample[at]
        shared = KEY * common_turns(before, path)
        # A path that only begins the next one is told apart by its end.
        cut = (path, conv_id) if shared >= len(path) else (path[: shared + KEY], LOWEST)
        if not chosen or chosen[-1] < cut:
            chosen.append(cut)
    return chosen


def build_skeleton(paths: DataFrame, rules: TrieRules) -> Skeleton:
    size = F.coalesce(F.sum(F.octet_length("path") + 8 * F.size("sizes") + KEY), F.lit(0))
    total, count = paths.agg(size, F.count(F.lit(1))).first()
    shards = max(task_count(paths), ceil(total / rules.shard_bytes))
    parts = 1 << 30
    wanted = min(parts, ceil(parts * rules.sampled * shards / max(count, 1)))
    drawn = F.pmod(F.xxhash64("conv_id", F.lit("splitters")), F.lit(parts)) < wanted
    sample = [(bytes(row[0]), row[1]) for row in paths.where(drawn).select("path", "conv_id").collect()]
    splitters = choose_splitters(sorted(sample), shards)
    skeleton = Skeleton(splitters)
    while len(skeleton.parents) > rules.skeleton_nodes and splitters:
        splitters = splitters[1::2]
        skeleton = Skeleton(splitters)
    return skeleton


# ---- shards ----


class Node:
    """A node whose members are still being read; `number` is -1 outside of the skeleton."""

    __slots__ = ("number", "size", "low", "n", "children", "leaves", "saved", "ends", "below")

    def __init__(self, number: int, size: int):
        self.number, self.size = number, size
        self.low, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        # A digest for nodes that end here, the ids of a row for those of the skeleton.
        self.ends = [] if number >= 0 else None
        self.below: list[tuple] = []


class Shard:
    """Reads sorted paths and makes the rows of their nodes."""

    def __init__(self, skeleton: Skeleton, ids_per_row: int):
        self.child, self.ids_per_row = skeleton.child, ids_per_row
        self.stack: list[Node] = []
        self.path = b""
        self.rows: list[tuple] = []

    def add(self, conv_id: int, path: bytes, sizes: list[int]) -> None:
        if not self.stack:
            self.stack.append(Node(0, 0))
        depth = common_turns(self.path, path)
        while len(self.stack) > depth + 1:
            self.close()
        for at in range(depth, len(sizes)):
            above = self.stack[-1].number
            number = self.child.get((above, path[KEY * at : KEY * (at + 1)]), -1) if above >= 0 else -1
            self.stack.append(Node(number, sizes[at]))
        self.path = path
        top = self.stack[-1]
        top.n += 1
        top.low = conv_id if top.low is None else min(top.low, conv_id)
        if top.number >= 0:
            top.ends.append(conv_id)
            if len(top.ends) == self.ids_per_row:
                self.give_ends(top)
        elif top.ends is None:
            top.ends = sha256(str(conv_id).encode())
        else:
            top.ends.update(b",%d" % conv_id)

    def give_ends(self, node: Node) -> None:
        ids = ",".join(map(str, node.ends))
        self.rows.append((ENDS, node.ends[0], None, node.number, len(node.ends), *[None] * 4, ids))
        node.ends = []

    def close(self) -> None:
        node, depth = self.stack.pop(), len(self.stack)
        above = self.stack[-1] if self.stack else None
        if above is not None:
            above.n += node.n
            above.low = node.low if above.low is None else min(above.low, node.low)
        if node.number >= 0:
            if node.ends:
                self.give_ends(node)
            figures = (node.n, node.children, node.leaves, node.saved, node.size)
            self.rows.append((SHARE, node.low, depth, node.number, *figures, None))
            return
        node.saved += (node.n - 1) * node.size
        node.leaves = node.leaves or 1
        above.children += 1
        above.leaves += node.leaves
        above.saved += node.saved
        for row in node.below:
            self.rows.append((BELOW_NODE, *row[:2], node.low, *row[2:]))
        ends = NO_ENDS if node.ends is None else node.ends.hexdigest()
        row = (node.low, depth, node.n, node.children, node.leaves, node.saved, None, ends)
        if above.number >= 0:
            self.rows.append((BELOW_SKELETON, *row[:2], above.number, *row[2:]))
        else:
            above.below.append(row)

    def taken(self) -> pa.RecordBatch:
        names = [part.split()[0] for part in SHARD.split(", ")]
        kinds = [pa.int32(), *[pa.int64()] * 8, pa.string()]
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[] for _ in names]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def sharded(paths: DataFrame, skeleton: Skeleton, rules: TrieRules) -> DataFrame:
    """Rows of all shards: finished nodes, and what each adds to the skeleton."""
    handed = paths.sparkSession.sparkContext.broadcast(skeleton)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = handed.value.splitters
        for batch in batches:
            conv_ids, keys = batch.column("conv_id").to_pylist(), batch.column("path").to_pylist()
            shard = [bisect_right(splitters, row) for row in zip(keys, conv_ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32())], [*batch.schema.names, "shard"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(handed.value, rules.ids_per_row)
        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("conv_id", "path", "sizes"))
            for row in zip(*columns):
                shard.add(*row)
            yield shard.taken()
        while shard.stack:
            shard.close()
        yield shard.taken()

    dealt = paths.mapInArrow(deal, "conv_id long, path binary, sizes array<long>, shard int")
    shards = dealt.repartitionById(len(skeleton.splitters) + 1, F.col("shard"))
    ordered = shards.sortWithinPartitions("path", "conv_id").select("conv_id", "path", "sizes")
    return ordered.mapInArrow(read, SHARD)


# ---- putting together ----


def ends_digests(rows: DataFrame) -> DataFrame:
    """SHA-256 over the ids that end at each skeleton node; rows of ids are read in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, number, digest = ["parent", "ends"], None, None
        for batch in batches:
            done = []
            for parent, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if parent == number:
                    digest.update(b"," + ids.encode())
                    continue
                if number is not None:
                    done.append((number, digest.hexdigest()))
                number, digest = parent, sha256(ids.encode())
            columns = [[row[k] for row in done] for k in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())], names)
        if number is not None:
            last = [pa.array([number], pa.int64()), pa.array([digest.hexdigest()], pa.string())]
            yield pa.RecordBatch.from_arrays(last, names)

    ends = rows.where(F.col("kind") == ENDS).select("parent", "conv_id", "ends")
    together = ends.repartition(task_count(rows), "parent").sortWithinPartitions("parent", "conv_id")
    return together.select("parent", "ends").mapInArrow(run, "parent long, ends string")


def skeleton_nodes(rows: DataFrame, skeleton: Skeleton) -> list[tuple]:
    """Finished skeleton nodes with their numbers, from their summed shares."""
    shares = rows.where(F.col("kind") == SHARE).groupBy("parent").agg(
        F.min("conv_id").alias("low"),
        F.max("depth").alias("depth"),
        *(F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "saved")),
        F.max("size").alias("size"),
    )
    found = {row["parent"]: row.asDict() for row in shares.collect()}
    ends = dict(ends_digests(rows).collect())
    done = []
    # A node's number is higher than that of the node above it.
    for number in sorted(found, reverse=True):
        node, above = found[number], found.get(skeleton.parents[number])
        node["saved"] += (node["n_convs"] - 1) * node["size"]
        node["n_leaves"] = node["n_leaves"] or 1
        if above is not None:
            above["n_children"] += 1
            above["n_leaves"] += node["n_leaves"]
            above["saved"] += node["saved"]
        parent = None if above is None else above["low"]
        figures = (node["n_convs"], node["n_children"], node["n_leaves"], node["saved"])
        done.append((number, node["low"], node["depth"], parent, *figures, ends.get(number, NO_ENDS)))
    return done


def prefix_trie(paths: DataFrame, rules: TrieRules | None = None) -> DataFrame:
    """Every node of the trie over `conv_id`, `path` and `sizes`; see `paths_of`."""
    rules = rules or TrieRules()
    spark = paths.sparkSession
    paths = written(paths, "paths")
    skeleton = build_skeleton(paths, rules)
    rows = written(sharded(paths, skeleton, rules), "shards")
    # At most `skeleton_nodes` rows.
    top = spark.createDataFrame(skeleton_nodes(rows, skeleton), "number long, " + NODES)
    figures = ["n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    inner = rows.where(F.col("kind") == BELOW_NODE)
    inner = inner.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), *figures)
    above = F.broadcast(top.select(F.col("number").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    edge = rows.where(F.col("kind") == BELOW_SKELETON).join(above, "parent")
    edge = edge.select("conv_id", "depth", "parent_conv_id", *figures)
    return top.drop("number").unionByName(inner).unionByName(edge)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie(paths_of(branched(conversations)))
