"""Path columns.

A path is posix, relative to its root, without a leading slash. The root
directory itself is the empty string, at depth 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE_SUFFIX = ".py"


def name_of(path: Column) -> Column:
    """Last component of a path."""
    return F.substring_index(path, "/", -1)


def dir_of(path: Column) -> Column:
    """Everything before the last component, '' at the top."""
    tail = F.char_length(name_of(path)) + F.lit(1)
    return F.left(path, F.greatest(F.char_length(path) - tail, F.lit(0)))


def depth_of(path: Column) -> Column:
    """Depth of the directory that holds `path`; files in the root are at 0."""
    return F.size(F.split(path, "/")) - F.lit(1)


def dir_depth(directory: Column) -> Column:
    """Depth of a directory; the root is at 0."""
    return F.when(directory == "", F.lit(0)).otherwise(F.size(F.split(directory, "/")))


def prefixes(directory: Column) -> Column:
    """The directory and all directories above it except the root, top first."""
    parts = F.split(directory, "/")
    steps = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    return F.when(directory == "", F.array().cast("array<string>")).otherwise(steps)


def path_order(path: Column) -> Column:
    """Sort key that compares paths component by component."""
    return F.split(path, "/")


def has_suffix(name: Column, suffix: str = SOURCE_SUFFIX) -> Column:
    """True for `x.py` in any letter case; a bare `.py` has no suffix."""
    return F.lower(name).endswith(suffix.lower()) & (
        F.char_length(name) > F.lit(len(suffix))
    )


def within_depth(directory: Column, max_depth: int | None) -> Column:
    """True for directories at most `max_depth` below the root; None is no limit."""
    if max_depth is None:
        return F.lit(True)
    return dir_depth(directory) <= F.lit(max_depth)


def display_path(root: Column, directory: Column) -> Column:
    """The path shown to readers: the root, then the directory below it."""
    return F.when(directory == "", root).otherwise(F.concat_ws("/", root, directory))


def display_name(root: Column, directory: Column) -> Column:
    """The directory's own name; a root goes by the last part of its path."""
    return name_of(display_path(root, directory))
