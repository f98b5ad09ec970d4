"""Intermediate tables in the cluster's shared folder.

A written table is what survives the loss of an executor, and it is read back
with column pruning, which a checkpointed frame is not.
"""

from __future__ import annotations

import tempfile
import time
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from treelens.operators.folders import entries, remove

SETTING = "spark.checkpoint.dir"
_scratch: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; a local one only for local sessions that name none."""
    folder = spark.conf.get(SETTING, None)
    master = spark.conf.get("spark.master", "")
    local = master.startswith("local") and not master.startswith("local-cluster")
    if folder and folder.startswith("file:") and not master.startswith("local"):
        raise ValueError(f"{SETTING} is {folder}, which other machines of the cluster do not see")
    if folder:
        return folder.rstrip("/")
    if not local:
        raise ValueError(f"set {SETTING} to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="treelens-")
    spark.conf.set(SETTING, folder)
    return folder


class Scratch:
    """The folders of the tables that a run has written on its way."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders, self.kept = spark, [], False

    def keep(self) -> None:
        """Leave the tables until `discard` is called: a result still reads them."""
        self.kept = True

    def discard(self) -> None:
        while self.folders:
            remove(self.spark, self.folders.pop())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Remove the tables written inside of the block at its end, however it ends."""
    own = Scratch(spark)
    outer = _scratch.set(own)
    try:
        yield own
    except BaseException:
        own.discard()
        raise
    finally:
        _scratch.reset(outer)
        if not own.kept:
            own.discard()


def new_folder(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A path nobody else uses, under the shared folder.

    A `lasting` one is not removed with the other tables of its run.
    """
    own, folder = _scratch.get(), f"{shared_folder(spark)}/treelens/{uuid4().hex}"
    if own is not None and not lasting:
        own.folders.append(folder)
    return f"{folder}/{name}"


def remove_old(spark: SparkSession, seconds: float) -> int:
    """Remove tables that runs which died, or lazy results, left behind; returns how many.

    Only those whose folder was last changed more than `seconds` ago, so that
    nothing goes that a run still reads: give more than the longest run takes.
    """
    base, now = f"{shared_folder(spark)}/treelens", time.time()
    old = [name for name, changed in entries(spark, base).items() if now - changed >= seconds]
    for name in old:
        remove(spark, f"{base}/{name}")
    return len(old)


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write `df` once and go on from the copy, which is `lasting` if it outlives its run."""
    spark = df.sparkSession
    path = new_folder(spark, name, lasting)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
