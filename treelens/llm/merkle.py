"""A Merkle manifest of a dataset: one root, and for every row the proof that it belongs to it.

A row's leaf is the SHA-256 of its fields. The leaves of a source, by doc_id,
are the lowest level of a tree in which every few consecutive nodes have one
parent; the sources' tops are the lowest level of the tree above. A superblock
is a full run of leaves that meet in one node some levels up. Superblocks are
reduced to those nodes, these are nodes of a smaller tree that is treated the
same, until one is left per source. On the way back, the leaves of a superblock
and the outer nodes its proofs need are cogrouped, and one function reduces the
block again, joins inner and outer proofs, and folds every leaf up to the root.
So no task holds more than a superblock, however many rows a source has.

Defined results: null fields count as `-`; a null source is a source of its
own and comes first. Rows with a null doc_id come first in their source and
are never tampered with. Rows with one doc_id in a source go by their leaf;
equal rows have equal leaves and differ in their proofs only. Texts of any
length are hashed where they are read and never shuffled. Columns besides the
five are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from math import ceil

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.operators.groups import task_count
from treelens.operators.workspace import written

NODE = "key string, pos long, node string"
OUTER = "key string, pos long, path array<string>, subroot string"
PROOFS = (
    "doc string, leaf string, changed string, subroot string, proof array<string>, proof_sha256 string, "
    "folded_root string"
)


@dataclass(frozen=True)
class MerkleRules:
    """Nodes of a parent, levels inside of a superblock, and rows of a sorted range."""

    arity: int = 3
    levels: int = 8
    rows_per_range: int = 1_000_000

    @property
    def width(self) -> int:
        return self.arity**self.levels


def field(value: Column) -> Column:
    """A value with its size in bytes before it; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


# ---- places ----


def numbered(rows: DataFrame, order: list[str], rules: MerkleRules) -> DataFrame:
    """Add `pos`: the place of each row among those of its `key`, in `order`, from 0.

    Rows are sorted over all tasks, so that a key may span many of them; a task
    counts within itself. Only the first key of a task can have begun in an
    earlier one, so one row per task tells where each of them goes on.
    """
    columns = rows.columns
    ranges = max(task_count(rows), ceil(rows.count() / rules.rows_per_range))
    ranged = rows.repartitionByRange(ranges, "key", *order).sortWithinPartitions("key", *order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for key in batch.column("key").to_pylist():
                n = n + 1 if key == last else 0
                last = key
                places.append(n)
            added = [pa.array([task] * len(places), pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*columns, "task", "place"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    counted = written(ranged.mapInArrow(count, f"{kinds}, task int, place long"), "places")
    sizes = counted.groupBy("task", "key").agg(F.count(F.lit(1)).alias("n"))
    ends = sizes.groupBy("task").agg(
        F.min("key").alias("first"), F.max(F.struct("key", "n")).alias("last")
    )
    before, open_key, open_rows = [], None, 0
    for row in ends.orderBy("task").collect():
        goes_on = open_rows if row["first"] == open_key else 0
        before.append((row["task"], row["first"], goes_on))
        open_key, n = row["last"]
        open_rows = n + (goes_on if open_key == row["first"] else 0)
    # One row per range.
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "task int, key string, earlier long"))
    pos = F.col("place") + F.coalesce("earlier", F.lit(0))
    return counted.join(offsets, ["task", "key"], "left").select(*columns, pos.alias("pos"))


# ---- superblocks ----


def block_levels(nodes: list[str], block: int, rules: MerkleRules) -> list[list[str]]:
    """All levels of a superblock from the lowest one up to its single top.

    Where a tree has several superblocks, each climbs the same levels; one that
    is alone climbs until one node is left. Only a first block can be alone,
    and if it is full, both are the same.
    """
    levels, n = [nodes], rules.arity
    alone = block == 0 and len(nodes) < rules.width
    while len(levels[-1]) > 1 if alone else len(levels) <= rules.levels:
        low = levels[-1]
        levels.append([digest(*low[at : at + n]) for at in range(0, len(low), n)])
    return levels


def blocks_of(nodes: DataFrame, rules: MerkleRules) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {rules.width}"))


def reduced(nodes: DataFrame, rules: MerkleRules) -> DataFrame:
    """The top of every superblock, at the superblock's place."""

    def reduce(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        nodes = frame.sort_values("pos")["node"].tolist()
        top = block_levels(nodes, key[1], rules)[-1][0]
        return pd.DataFrame([(key[0], key[1], top)], columns=["key", "pos", "node"])

    narrow = blocks_of(nodes.select("key", "pos", "node"), rules)
    return narrow.groupBy("key", "block").applyInPandas(reduce, NODE)


def tiers(nodes: DataFrame, rules: MerkleRules) -> list[DataFrame]:
    """Nodes, the tops of their superblocks, the tops of those, up to one node per key."""
    found = [nodes]
    while True:
        found.append(written(reduced(found[-1], rules), "tier"))
        # A key's first superblock is its only one if no other has a higher place.
        if not found[-1].agg(F.max("pos")).first()[0]:
            return found


def siblings(levels: list[list[str]], rules: MerkleRules) -> Iterator[list[str]]:
    """For every lowest node its siblings, left and right ones by turns, up to the top."""
    n = rules.arity
    for place in range(len(levels[0])):
        path, at = [], place
        for level in levels[:-1]:
            first = at - at % n
            path += ["".join(level[first:at]), "".join(level[at + 1 : first + n])]
            at //= n
        yield path


def joined(nodes: DataFrame, outer: DataFrame, finish, schema: str, rules: MerkleRules) -> DataFrame:
    """Cogroup superblocks with their tops' proofs; `finish` makes the rows of a block."""

    def run(key: tuple, frame: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos", ignore_index=True)
        levels = block_levels(frame["node"].tolist(), key[1], rules)
        path, subroot = list(above["path"].iloc[0]), above["subroot"].iloc[0]
        return finish(frame, siblings(levels, rules), path, subroot)

    inside = blocks_of(nodes, rules).groupBy("key", "block")
    outside = outer.withColumnRenamed("pos", "block").groupBy("key", "block")
    return inside.cogroup(outside).applyInPandas(run, schema)


def _with_path(frame: pd.DataFrame, inner: Iterator[list[str]], outer: list[str], subroot) -> pd.DataFrame:
    paths = [own + outer for own in inner]
    return pd.DataFrame({"key": frame["key"], "pos": frame["pos"], "path": paths, "subroot": subroot})


def _with_source(frame: pd.DataFrame, inner: Iterator[list[str]], outer: list[str], subroot) -> pd.DataFrame:
    paths = [own + outer for own in inner]
    return pd.DataFrame({"key": frame["source_key"], "pos": 0, "path": paths, "subroot": frame["node"]})


def _folded(frame: pd.DataFrame, inner: Iterator[list[str]], outer: list[str], subroot) -> pd.DataFrame:
    rows = []
    columns = (frame[name] for name in ("doc", "node", "changed"))
    for doc, leaf, changed, own in zip(*columns, inner, strict=True):
        path = own + outer
        node = changed if isinstance(changed, str) else leaf
        for left, right in zip(path[::2], path[1::2], strict=True):
            node = digest(left, node, right)
        rows.append((doc, leaf, changed, subroot, path, digest(*path), node))
    return pd.DataFrame(rows, columns=[part.split()[0] for part in PROOFS.split(", ")])


def downwards(levels: list[DataFrame], outer: DataFrame, rules: MerkleRules) -> DataFrame:
    """Proofs of the superblocks of the lowest tier, from the proofs of the single tops."""
    for tier in reversed(levels[1:-1]):
        outer = joined(tier, outer, _with_path, OUTER, rules)
    return outer


def merkle_manifest(documents: DataFrame, rules: MerkleRules | None = None) -> DataFrame:
    """`doc_id`, `leaf`, `subroot`, `root`, `proof` (left and right siblings by turns,
    empty where there are none), `proof_sha256`, `changed` (the tampered leaf, or null) and
    `folded_root`, of every document."""
    rules = rules or MerkleRules()
    spark = documents.sparkSession
    names = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
    doc_id, source, lang, n_chars, text = (F.col(name).cast(kind) for name, kind in names.items())
    tampered = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    cut = F.translate(text, "\n", "")
    leaves = documents.select(
        # Order of sources: null first, then by bytes.
        F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("key"),
        doc_id.alias("doc_id"),
        leaf_hash(doc_id, source, lang, n_chars, text).alias("node"),
        F.when(tampered, leaf_hash(doc_id, source, lang, n_chars, cut)).alias("changed"),
    )
    leaves = numbered(written(leaves, "leaves"), ["doc_id", "node", "changed"], rules)
    # Places come from a written table, so this one is written only for its many readers.
    leaves = written(leaves.withColumn("doc", F.col("doc_id").cast("string")).drop("doc_id"), "numbered")

    sources = tiers(leaves, rules)
    subroots = sources[-1].select(F.lit("").alias("key"), F.col("key").alias("source_key"), "node")
    subroots = written(numbered(subroots, ["source_key"], rules), "subroots")
    above = tiers(subroots, rules)
    top = above[-1].select("node").first()
    root = None if top is None else top["node"]

    empty, nothing = F.array().cast("array<string>"), F.lit(None).cast("string")
    peak = above[-1].select("key", "pos", empty.alias("path"), nothing.alias("subroot"))
    outer = downwards(above, peak, rules)
    outer = joined(subroots, outer, _with_source, OUTER, rules)
    outer = downwards(sources, outer, rules)
    proofs = joined(leaves, outer, _folded, PROOFS, rules)
    return proofs.select(
        F.col("doc").cast("long").alias("doc_id"),
        "leaf",
        "subroot",
        F.lit(root).cast("string").alias("root"),
        "proof",
        "proof_sha256",
        "changed",
        "folded_root",
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = merkle_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return manifest.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
