"""Rows dealt out to tasks by what they weigh, not by how many they are."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelens.operators.workspace import written

MAX_BUNDLES = 100_000


def in_bundles(df: DataFrame, weight: Column, size: int, least: int = 1) -> DataFrame:
    """Deal the rows of `df` out so that each task gets about `size`, one bundle per task.

    A running sum over all rows cuts them into bundles, so no bundle is above
    `size` by more than its last row. Each task adds up its own rows; one sum per
    task is then enough to go on from the tasks before. Inputs that would make
    fewer than `least` bundles are cut finer, very large ones coarser.
    """
    columns = df.columns

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            before = list(accumulate(batch.column("weight").to_pylist(), initial=total))
            total = before.pop()
            added = [pa.array([task] * len(before), pa.int32()), pa.array(before, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "task", "before"])

    kinds = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in df.schema.fields)
    weighed = df.withColumn("weight", F.coalesce(weight, F.lit(0)).cast("bigint"))
    summed = written(
        weighed.mapInArrow(running, f"{kinds}, weight bigint, task int, before bigint"), "weights"
    )
    # One row per task of the input.
    sums = summed.groupBy("task").agg(F.sum("weight").alias("weight")).orderBy("task").collect()
    starts = dict(zip((row.task for row in sums), accumulate((row.weight for row in sums), initial=0)))
    total = sum(row.weight for row in sums)
    share = max(min(size, -(-total // least)), -(-total // MAX_BUNDLES), 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tasks, before = batch.column("task").to_pylist(), batch.column("before").to_pylist()
            bundle = [(starts[task] + own) // share for task, own in zip(tasks, before)]
            kept = [batch.column(name) for name in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bundle, pa.int32())], [*columns, "bundle"])

    placed = summed.mapInArrow(place, f"{kinds}, bundle int")
    return placed.repartitionById(total // share + 1, F.col("bundle")).drop("bundle")
