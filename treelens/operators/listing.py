"""Which files and directories of a corpus take part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelens.functions.ignore import IgnoreRules
from treelens.functions.paths import (
    SOURCE_SUFFIX,
    depth_of,
    dir_of,
    has_suffix,
    name_of,
    path_order,
    prefixes,
    within_depth,
)
from treelens.operators.workspace import written


def with_path_parts(df: DataFrame) -> DataFrame:
    """Add `dir`, `name` and `depth` to rows that have a `path`."""
    path = F.col("path")
    return df.withColumns({"dir": dir_of(path), "name": name_of(path), "depth": depth_of(path)})


def reached(rules: IgnoreRules, max_depth: int | None = None) -> Column:
    """True where a walk reaches `dir`: not pruned, and not too deep."""
    directory = F.col("dir")
    return within_depth(directory, max_depth) & ~rules.prunes(directory)


def in_walk(
    rules: IgnoreRules, max_depth: int | None = None, suffix: str = SOURCE_SUFFIX
) -> Column:
    """Source files of a walk, with the patterns applied to the whole path."""
    wanted = has_suffix(F.col("name"), suffix) & ~rules.matches(F.col("path"))
    return wanted & reached(rules, max_depth)


def is_member(rules: IgnoreRules, suffix: str = SOURCE_SUFFIX) -> Column:
    """Source files as members of a directory, with the patterns applied to the bare name."""
    return has_suffix(F.col("name"), suffix) & ~rules.matches(F.col("name"))


def directories_of(files: DataFrame) -> DataFrame:
    """Every directory (`root`, `dir`) that the paths imply, the roots included."""
    holding = files.select("root", "dir").distinct()
    above = F.concat(F.array(F.lit("")), prefixes(F.col("dir")))
    return holding.select("root", F.explode(above).alias("dir")).distinct()


def child_directories(directories: DataFrame, rules: IgnoreRules) -> DataFrame:
    """One row (`root`, `dir`, `name`) per child directory that `dir` lists.

    Patterns see the child's bare name only. Whether a walk reaches the child
    does not matter, so links to it may lead nowhere.
    """
    children = directories.where(F.col("dir") != "").select(
        "root", dir_of(F.col("dir")).alias("dir"), name_of(F.col("dir")).alias("name")
    )
    return children.where(~rules.matches(F.concat("name", F.lit("/"))))


def sorted_listing(files: DataFrame, ranges: int | None = None) -> DataFrame:
    """Paths numbered from 1 in component order across all roots.

    The sort is by range partition; the numbers come from the ordered row ids
    plus the number of rows in the partitions before, so no task sees all rows.
    """
    order = [F.col("root"), path_order(F.col("path"))]
    listing = files.select("root", "path")
    ordered = (
        listing.repartitionByRange(*([ranges] if ranges else []), *order)
        .sortWithinPartitions(*order)
        .withColumn("id", F.monotonically_increasing_id())
    )
    # Both passes below must see the same ranges.
    ordered = written(ordered, "listing")
    numbered = ordered.withColumn("partition", F.shiftright("id", 33))
    # One row per partition of the sort, however many files there are.
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("partition")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("partition", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    place = F.col("id") - F.shiftleft("partition", 33)
    return numbered.join(F.broadcast(offsets), "partition").select(
        "root", "path", (place + F.col("offset") + F.lit(1)).alias("position")
    )
