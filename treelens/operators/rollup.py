"""Files rolled up to their directories."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelens.operators.groups import Cut, Limits, Split, in_pieces, split_by_size
from treelens.operators.symbols import ordered_union, symbols
from treelens.operators.workspace import written

DIRECTORY = ["root", "dir"]
LISTS = ["all_functions", "all_classes", "all_imports", "subdirectories"]
# How many leading entries prompts and summaries look at.
LEADING = {"all_functions": 10, "all_classes": 10, "subdirectories": 20}

_FILE = [
    "name",
    "size_bytes",
    "content_hash",
    "module_docstring",
    "functions",
    "classes",
    "imports",
]
_DIGESTS_PER_ROW = 256


def _in_name_order(*fields: str) -> Column:
    """Members of a directory as an array in name order; rows without a name add nothing."""
    member = F.when(F.col("name").isNotNull(), F.struct(*fields))
    return F.array_sort(F.collect_list(member))


def combined_hash(digests: Column) -> Column:
    """sha256 over member hashes joined with '|'; no members give the hash of nothing."""
    return F.sha2(F.concat_ws("|", digests), 256)


def with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Add a nameless row per root, which keeps roots without files in a roll-up.

    Rows of `roots` that name a `dir` keep that directory instead.
    """
    directory = F.col("dir") if "dir" in roots.columns else F.lit("").alias("dir")
    marks = roots.select("root", directory, F.lit(True).alias("marked"))
    return members.unionByName(marks, allowMissingColumns=True)


def _totals() -> list[Column]:
    return [
        F.count("name").alias("file_count"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"),
    ]


def _kept() -> list[Column]:
    """Directories with files stay, and so do marked ones."""
    return [((F.count("name") > 0) | F.coalesce(F.bool_or("marked"), F.lit(False))).alias("kept")]


def directory_hashes(
    files: DataFrame,
    limits: Limits = Limits(),
    save: Callable[[DataFrame, str], DataFrame] = written,
) -> DataFrame:
    """File count, total size and combined hash per directory.

    Takes rows with `root`, `dir`, `name`, `size_bytes` and `content_hash`. If
    directories are beyond the limits, these rows are kept with `save`, hashes
    as 32 bytes, and all the rest reads them there.
    """
    files = files.select(*DIRECTORY, "name", "size_bytes", "content_hash")
    split = split_by_size(files, DIRECTORY, limits)
    if split.oversized is not None:
        packed = save(files.withColumn("content_hash", F.unhex("content_hash")), "digests")
        files = packed.withColumn("content_hash", F.lower(F.hex("content_hash")))
        split = split_by_size(files, DIRECTORY, limits)
    gathered = (
        split.bounded.groupBy(*DIRECTORY)
        .agg(*_totals(), _in_name_order("name", "content_hash").alias("files"))
        .withColumn("content_hash", combined_hash(F.col("files.content_hash")))
        .drop("files")
    )
    if split.oversized is None:
        return gathered
    totals = split.oversized.groupBy(*DIRECTORY).agg(*_totals())
    return gathered.unionByName(totals.join(_streamed_hashes(split), DIRECTORY))


def _streamed_hashes(split: Split) -> DataFrame:
    """Combined hash of directories too large to gather.

    sha256 is defined over one sequence, so the last step reads a directory in
    order, in constant memory. Sorting happens before that, over all tasks, and
    what reaches the last step is 32 bytes per member in packed rows.
    """
    named = split.oversized.where(F.col("name").isNotNull())
    pieces = in_pieces(named, [*DIRECTORY, "name"], split.cut)
    gathered = pieces.groupBy(*DIRECTORY, "piece").agg(
        _in_name_order("name", "content_hash").alias("files")
    )
    starts = F.sequence(F.lit(1), F.size("files"), F.lit(_DIGESTS_PER_ROW))
    packed = gathered.select(
        *DIRECTORY,
        "piece",
        F.posexplode(
            F.transform(
                starts,
                lambda at: F.unhex(
                    F.array_join(
                        F.slice(F.col("files.content_hash"), at, F.lit(_DIGESTS_PER_ROW)), ""
                    )
                ),
            )
        ).alias("at", "digests"),
    )
    in_order = packed.repartition(*DIRECTORY).sortWithinPartitions(*DIRECTORY, "piece", "at")
    return in_order.select(*DIRECTORY, "digests").mapInPandas(
        _hash_in_order, "root string, dir string, content_hash string"
    )


def _hash_in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current, digest = None, None
    for batch in batches:
        done = []
        for key, packed in zip(zip(batch["root"], batch["dir"]), batch["digests"]):
            if key != current:
                if current is not None:
                    done.append((*current, digest.hexdigest()))
                current, digest = key, hashlib.sha256()
            else:
                digest.update(b"|")
            digest.update(bytes(packed).hex("|", 32).encode())
        yield pd.DataFrame(done, columns=["root", "dir", "content_hash"])
    if current is not None:
        last = [(*current, digest.hexdigest())]
        yield pd.DataFrame(last, columns=["root", "dir", "content_hash"])


@dataclass(frozen=True)
class Directories:
    """All directory records of a corpus.

    `records` has one row with nested members per directory within the limits. A
    directory beyond them is not gathered: it has a row in `heads` with its totals and
    leading entries, its members are the rows of `files`, and its unions are
    the rows of `lists` (`list`, `item`, `at_file`, `at`, sorted by the last two).
    """

    records: DataFrame
    heads: DataFrame | None = None
    files: DataFrame | None = None
    lists: DataFrame | None = None
    cut: Cut | None = None

    def each(self, step: Callable[[DataFrame], DataFrame]) -> Directories:
        """Apply a row-wise step to the records and the heads."""
        heads = None if self.heads is None else step(self.heads)
        return replace(self, records=step(self.records), heads=heads)

    def rows(self, *columns: str) -> DataFrame:
        """One row per directory of any size, with columns that need no nested members."""
        found = self.records.select(*columns)
        return found if self.heads is None else found.unionByName(self.heads.select(*columns))


def directory_records(
    files: DataFrame,
    children: DataFrame,
    roots: DataFrame,
    limits: Limits = Limits(),
    sizes: DataFrame | None = None,
    save: Callable[[DataFrame, str], DataFrame] = written,
) -> Directories:
    """One record per directory that holds files, and per root.

    `files` are file records, `children` the listed child directories. Members
    of both kinds share one shuffle. `sizes` may name a cheaper frame of
    members (`root`, `dir`, `size_bytes`) to measure the directories on. What
    is derived for directories beyond the limits is used many times, so it is
    kept with `save`; nothing is saved if there are none.
    """
    members = with_roots(
        files.select(*DIRECTORY, *_FILE).unionByName(
            children.select(*DIRECTORY, F.col("name").alias("child")), allowMissingColumns=True
        ),
        roots,
    )
    measured = (sizes if sizes is not None else files).select(*DIRECTORY, "size_bytes")
    measured = measured.unionByName(children.select(*DIRECTORY), allowMissingColumns=True)
    split = split_by_size(members, DIRECTORY, limits, F.col("size_bytes"), measured)
    gathered = split.bounded.groupBy(*DIRECTORY).agg(
        *_totals(),
        *_kept(),
        _in_name_order(*_FILE).alias("files"),
        F.array_sort(F.collect_set("child")).alias("subdirectories"),
    )
    records = _with_counts(
        gathered.where("kept")
        .drop("kept")
        .withColumns(
            {
                "content_hash": combined_hash(F.col("files.content_hash")),
                "all_functions": F.array_distinct(F.flatten(F.col("files.functions"))),
                "all_classes": F.array_distinct(F.flatten(F.col("files.classes"))),
                "all_imports": F.array_distinct(F.flatten(F.col("files.imports"))),
            }
        )
    )
    if split.oversized is None:
        return Directories(records)
    return _large_directories(records, replace(split, oversized=save(split.oversized, "large")), save)


def _with_counts(records: DataFrame) -> DataFrame:
    counts = {f"{name}_count": F.size(name) for name in LISTS}
    leading = {f"leading_{name}": F.slice(name, 1, n) for name, n in LEADING.items()}
    return records.withColumns(counts | leading)


def _large_directories(
    records: DataFrame, split: Split, save: Callable[[DataFrame, str], DataFrame]
) -> Directories:
    members = split.oversized
    files = members.where(F.col("name").isNotNull()).drop("child")
    names = symbols(files.withColumn("path", F.col("name")))
    list_of = F.create_map(
        F.lit("function"), F.lit("all_functions"),
        F.lit("class"), F.lit("all_classes"),
        F.lit("import"), F.lit("all_imports"),
    )
    unions = ordered_union(names).select(
        *DIRECTORY,
        list_of[F.col("kind")].alias("list"),
        F.col("symbol").alias("item"),
        F.col("first_file").alias("at_file"),
        F.col("first_ordinal").alias("at"),
    )
    children = (
        members.where(F.col("child").isNotNull())
        .select(
            *DIRECTORY,
            F.lit("subdirectories").alias("list"),
            F.col("child").alias("item"),
            F.col("child").alias("at_file"),
            F.lit(0).alias("at"),
        )
        .distinct()
    )
    lists = save(unions.unionByName(children), "lists")

    totals = members.groupBy(*DIRECTORY).agg(*_totals(), *_kept())
    digests = _streamed_hashes(split)
    # Spark keeps only the leading rows of each task before it shuffles for the rank.
    rank = F.row_number().over(Window.partitionBy(*DIRECTORY, "list").orderBy("at_file", "at"))
    ranked = lists.withColumn("rank", rank).where(F.col("rank") <= max(LEADING.values()))
    leading = ranked.groupBy(*DIRECTORY).agg(
        *(
            F.array_sort(
                F.collect_list(
                    F.when(
                        (F.col("list") == name) & (F.col("rank") <= LEADING.get(name, 1)),
                        F.struct("rank", "item"),
                    )
                )
            )["item"].alias(f"leading_{name}")
            for name in LISTS
        )
    )
    counts = lists.groupBy(*DIRECTORY).agg(
        *(F.count_if(F.col("list") == name).cast("int").alias(f"{name}_count") for name in LISTS)
    )
    heads = (
        totals.where("kept")
        .drop("kept")
        .join(digests, DIRECTORY, "left")
        .join(leading, DIRECTORY, "left")
        .join(counts, DIRECTORY, "left")
    )
    filled = {f"{name}_count": F.coalesce(f"{name}_count", F.lit(0)) for name in LISTS} | {
        f"leading_{name}": F.coalesce(f"leading_{name}", F.array().cast("array<string>"))
        for name in LISTS
    }
    digest = F.coalesce("content_hash", combined_hash(F.array().cast("array<string>")))
    heads = save(heads.withColumns(filled | {"content_hash": digest}), "heads")
    return Directories(records, heads, files, lists, split.cut)
