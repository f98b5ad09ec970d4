"""A corpus: a listing, its directories, and bytes for the files that are wanted."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.functions.ignore import IgnoreRules
from treelens.functions.text import content_hash, content_size
from treelens.operators.listing import directories_of, with_path_parts
from treelens.operators.symbols import file_records
from treelens.operators.workspace import written
from treelens.sources.tree import list_trees, read_contents, read_hashes, read_records

# A set of directories up to this size is sent to every task as a filter.
MAX_BROADCAST_DIRECTORIES = 500_000
REJECTS = "root string, path string, read_error string"
MEMBER = ["root", "path", "dir", "name"]


def corpus_from_table(
    table: DataFrame, path: Column | str, content: Column | str, root: Column | str
) -> DataFrame:
    """Any table as a corpus: `root`, `path`, `content`; see `TableCorpus.doubled` for repeated paths."""
    columns = {"root": root, "path": path, "content": content}
    return table.select(
        *(
            (F.col(value) if isinstance(value, str) else value).alias(name)
            for name, value in columns.items()
        )
    )


@dataclass(frozen=True)
class TableCorpus:
    """Files whose bytes are already in a table of `root`, `path`, `content`."""

    files: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    @cached_property
    def listing(self) -> DataFrame:
        return with_path_parts(self.files.select("root", "path"))

    @cached_property
    def directories(self) -> DataFrame:
        return directories_of(self.listing)

    @cached_property
    def roots(self) -> DataFrame:
        return self.listing.select("root").distinct()

    @cached_property
    def doubled(self) -> DataFrame | None:
        """Paths (`root`, `path`, `rows`) that occur more than once, if there are any.

        Paths are counted by a hash, so 8 bytes a row move; the few whose hash
        occurs twice are then counted themselves.
        """
        paths = self.files.select("root", "path", F.xxhash64("root", "path").alias("hash"))
        seen = paths.groupBy("hash").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
        if not seen.count():
            return None
        seen = written(seen.select("hash"), "repeated", lasting=True)
        counted = paths.join(seen, "hash", "left_semi").groupBy("root", "path").agg(
            F.count(F.lit(1)).alias("rows")
        )
        found = written(counted.where(F.col("rows") > 1), "doubled", lasting=True)
        return None if found.isEmpty() else found

    @property
    def rejects(self) -> DataFrame:
        """Paths that occur more than once, of which one row counts."""
        if self.doubled is None:
            return self.spark.createDataFrame([], REJECTS)
        error = F.format_string("path occurs %d times", "rows")
        return self.doubled.select("root", "path", error.alias("read_error"))

    def _once(self, members: DataFrame) -> DataFrame:
        """Members without the repeated rows of a path; of different contents the least hash stays."""
        if self.doubled is None:
            return members
        own, rest = self.doubled.select("root", "path"), [c for c in members.columns if c not in ("root", "path")]
        repeated = members.join(own, ["root", "path"], "left_semi").groupBy("root", "path")
        rest.sort(key=lambda name: name != "content_hash")
        least = repeated.agg(F.min(F.struct(*rest)).alias("row")).select("root", "path", "row.*")
        return members.join(own, ["root", "path"], "left_anti").unionByName(least)

    def contents(
        self, keep: list[Column], directories: DataFrame | None = None, count: int = 0
    ) -> DataFrame:
        """Rows with bytes that pass `keep`, narrowed to `directories` if that is cheap.

        Bytes are not shuffled for the sake of the filter: a set of directories
        too large to broadcast is left to the caller to apply to the parsed rows.
        """
        rows = with_path_parts(self.files).withColumn("read_error", F.lit(None).cast("string"))
        for condition in keep:
            rows = rows.where(condition)
        if directories is not None and count <= MAX_BROADCAST_DIRECTORIES:
            rows = rows.join(F.broadcast(directories), ["root", "dir"], "left_semi")
        return rows

    def hashes(self, keep: list[Column]) -> DataFrame:
        """Size and hash of the files that pass `keep`, from one scan that drops the bytes."""
        members = self.contents(keep).select(
            *MEMBER,
            content_size(F.col("content")).alias("size_bytes"),
            content_hash(F.col("content")).alias("content_hash"),
            "read_error",
        )
        return members if self.doubled is None else self._once(written(members, "members"))

    def records(
        self, keep: list[Column], directories: DataFrame | None = None, count: int = 0
    ) -> DataFrame:
        """`hashes` with the symbols of each file, from the same scan."""
        records = file_records(self.contents(keep, directories, count))
        records = records.withColumn("read_error", F.lit(None).cast("string"))
        return records if self.doubled is None else self._once(written(records, "members"))

    def one_directory(
        self, root: str, directory: str, wanted: Column
    ) -> tuple[DataFrame, DataFrame]:
        """Records of the wanted files of one directory, and (`root`, `dir`) of those right below.

        The directory is a range of paths, which reaches the scan as a filter. It
        is scanned once; bytes of files further down are not kept.
        """
        rows = self.files.where(F.col("root") == root)
        if directory:
            # "0" is the character after "/".
            rows = rows.where((F.col("path") >= f"{directory}/") & (F.col("path") < f"{directory}0"))
        here = F.col("dir") == directory
        content = F.when(here & wanted, F.col("content")).cast("binary").alias("content")
        rows = written(with_path_parts(rows).select(*MEMBER, content), "directory")
        records = file_records(rows.where(here & F.col("content").isNotNull()))
        below = F.substring(F.col("path"), len(directory) + 2 if directory else 1, 1 << 30)
        child = F.concat(F.lit(f"{directory}/" if directory else ""), F.substring_index(below, "/", 1))
        return records, rows.where(~here).select("root", child.alias("dir")).distinct()


@dataclass(frozen=True)
class TreeCorpus:
    """Files below directories of a file system that all executors can reach."""

    spark: SparkSession
    paths: tuple[str, ...]
    rules: IgnoreRules = IgnoreRules()
    max_depth: int | None = None
    max_file_bytes: int | None = None

    @cached_property
    def entries(self) -> DataFrame:
        return list_trees(self.spark, list(self.paths), self.rules, self.max_depth)

    @cached_property
    def listing(self) -> DataFrame:
        files = self.entries.where(F.col("kind") == "file")
        return with_path_parts(files.select("root", "path", "length"))

    @cached_property
    def directories(self) -> DataFrame:
        found = self.entries.where(F.col("kind").isin("dir", "linked_dir"))
        return found.select("root", F.col("path").alias("dir"))

    @cached_property
    def roots(self) -> DataFrame:
        return self.directories.where(F.col("dir") == "").select("root")

    @property
    def rejects(self) -> DataFrame:
        """What could not be listed."""
        return self.entries.where(F.col("kind") == "error").select("root", "path", "read_error")

    def _wanted(self, keep: list[Column], directories: DataFrame | None = None) -> DataFrame:
        wanted = self.listing
        for condition in keep:
            wanted = wanted.where(condition)
        if directories is not None:
            wanted = wanted.join(directories, ["root", "dir"], "left_semi")
        return wanted

    def contents(
        self, keep: list[Column], directories: DataFrame | None = None, count: int = 0
    ) -> DataFrame:
        """Rows with bytes that pass `keep`; only paths move before the files are read."""
        return with_path_parts(read_contents(self._wanted(keep, directories), self.max_file_bytes))

    def hashes(self, keep: list[Column]) -> DataFrame:
        """Size and hash of the files that pass `keep`, of any size; no bytes leave the readers."""
        return with_path_parts(read_hashes(self._wanted(keep), self.max_file_bytes))

    def records(
        self, keep: list[Column], directories: DataFrame | None = None, count: int = 0
    ) -> DataFrame:
        """`hashes` with the symbols of each file, which is read once and parsed where it is read."""
        return with_path_parts(read_records(self._wanted(keep, directories), self.max_file_bytes))

    def one_directory(
        self, root: str, directory: str, wanted: Column
    ) -> tuple[DataFrame, DataFrame]:
        """Records of the wanted files of one directory, and (`root`, `dir`) of those right below.

        Only this directory is listed.
        """
        roots = [root] if root in map(os.path.abspath, self.paths) else []
        depth = directory.count("/") + 1 if directory else 0
        entries = list_trees(self.spark, roots, self.rules, depth, directory)
        files = with_path_parts(entries.where(F.col("kind") == "file")).where(wanted)
        records = with_path_parts(read_records(files, self.max_file_bytes))
        below = entries.where(F.col("kind").isin("dir", "linked_dir") & (F.col("path") != directory))
        return records, below.select("root", F.col("path").alias("dir"))
