"""Groups too large to be gathered into one row.

One directory may hold a third of all files. Gathering a group into an array is
therefore only done for groups proven to be within `Limits`; the rows of the
others are sorted over all tasks by Spark's range partitioning and cut into
consecutive pieces, and each piece is gathered on its own. Nothing is left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# At most this many large groups are named in a broadcast filter.
MAX_LISTED = 50_000
# Rows and bytes that a task sorts before they are cut, however small the pieces are.
ROWS_PER_TASK = 1_600_000
BYTES_PER_TASK = 1 << 30


@dataclass(frozen=True)
class Limits:
    """Largest group that may become one row."""

    rows: int = 100_000
    bytes: int = 64 << 20


@dataclass(frozen=True)
class Cut:
    """How to cut large groups: rows per piece, and range partitions to sort in."""

    rows: int
    ranges: int


@dataclass(frozen=True)
class Split:
    """Rows of the groups within the limits, and rows of the others."""

    bounded: DataFrame
    oversized: DataFrame | None
    cut: Cut | None = None


def split_by_size(
    df: DataFrame,
    keys: Sequence[str],
    limits: Limits,
    weight: Column | None = None,
    sizes: DataFrame | None = None,
) -> Split:
    """Set the groups of `df` that exceed `limits` apart.

    `sizes` is a cheaper frame with the same groups to count, such as the plain
    listing of a corpus that is parsed lazily. The count shuffles one row per
    group and task.
    """
    counted = df if sizes is None else sizes
    totals = counted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(weight if weight is not None else F.lit(0)), F.lit(0)).alias("w"),
    )
    large = totals.where((F.col("n") > limits.rows) | (F.col("w") > limits.bytes))
    found = large.limit(MAX_LISTED + 1).collect()
    if not found:
        return Split(df, None)
    if len(found) <= MAX_LISTED:
        # Few enough to list: the filter runs before any shuffle.
        rows, weights = sum(r.n for r in found), sum(r.w for r in found)
        named = df.sparkSession.createDataFrame(found, large.schema).select(*keys)
        names = F.broadcast(named)
    else:
        rows, weights = large.agg(F.sum("n"), F.sum("w")).first()
        names = large.select(*keys)
    pieces = ceil(max(rows / limits.rows, weights / limits.bytes))
    tasks = ceil(max(rows / ROWS_PER_TASK, weights / BYTES_PER_TASK))
    ranges = min(pieces, max(task_count(df), tasks))
    return Split(
        df.join(names, list(keys), "left_anti"),
        df.join(names, list(keys), "left_semi"),
        Cut(ceil(rows / pieces), ranges),
    )


def in_pieces(df: DataFrame, order: Sequence[str], cut: Cut) -> DataFrame:
    """Add `piece`: consecutive rows in `order` share one, at most `cut.rows` of them.

    Pieces sort like their rows. Range partitioning spreads a group over tasks
    by a sample; the row's place in its sorted partition gives the exact cut.
    """
    spread = df.repartitionByRange(cut.ranges, *order).sortWithinPartitions(*order)
    row = spread.withColumn("_row", F.monotonically_increasing_id())
    # The lower 33 bits count the rows of a partition.
    place = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return row.withColumn("piece", F.col("_row") - place % cut.rows).drop("_row")


def spread_if_small(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores when the input is too small to give each one a split.

    Parsing takes far longer than reading, and a small table is often one split.
    Inputs that make at least one split per core are left where they are.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if size < cores * split else df


def task_count(df: DataFrame) -> int:
    """Tasks of a shuffle, for stages whose cost is not in the bytes they shuffle.

    Given as a number it also keeps Spark from merging small partitions.
    """
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
