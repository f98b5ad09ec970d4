"""Which directories changed since the last run."""

from __future__ import annotations

from datetime import datetime
from platform import python_version

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelens.functions.paths import path_order
from treelens.functions.text import decode_source, stored_hash

MANIFEST = (
    "root string, dir string, content_hash string, generated_at timestamp, deleted boolean, "
    "summary_status string, python_version string, run_id string"
)
DIRECTORY = ["root", "dir"]


def newest_rows(manifest: DataFrame) -> DataFrame:
    """The newest row of every directory; a removed one is marked deleted."""
    rest = [name for name in manifest.columns if name not in (*DIRECTORY, "generated_at", "deleted")]
    state = F.struct("generated_at", "deleted", *rest)
    latest = manifest.groupBy(*DIRECTORY).agg(F.max(state).alias("state"))
    return latest.select(*DIRECTORY, "state.*").select(*manifest.columns)


def current_manifest(manifest: DataFrame) -> DataFrame:
    """Latest state of every directory that still has a document."""
    kept = [*DIRECTORY, "generated_at", "content_hash", "summary_status", "run_id"]
    return newest_rows(manifest).where(~F.col("deleted")).select(*kept)


def change_status(
    hashes: DataFrame, current: DataFrame, force: bool = False, retry_failed: bool = False
) -> DataFrame:
    """Add `changed` to directory hashes: no stored hash, another one, or `force`.

    With `retry_failed`, a directory whose last summary failed counts as changed.
    """
    stored = current.select(
        *DIRECTORY,
        F.col("content_hash").alias("stored_hash"),
        F.col("summary_status").alias("stored_status"),
    )
    same = F.col("stored_hash").isNotNull() & (F.col("stored_hash") == F.col("content_hash"))
    if retry_failed:
        same = same & ~F.coalesce(F.col("stored_status") == "failed", F.lit(False))
    changed = F.lit(True) if force else ~same
    joined = hashes.join(stored, DIRECTORY, "left").withColumn("changed", changed)
    return joined.drop("stored_hash", "stored_status")


def manifest_rows(
    documents: DataFrame, run_id: str, at: datetime, deleted: bool = False
) -> DataFrame:
    """Manifest rows for directories that were written, or removed."""
    return documents.select(
        *DIRECTORY,
        "content_hash",
        F.lit(at).alias("generated_at"),
        F.lit(deleted).alias("deleted"),
        "summary_status",
        # Which sources parse depends on the grammar of the workers' Python.
        F.lit(python_version()).alias("python_version"),
        F.lit(run_id).alias("run_id"),
    )


def manifest_of_documents(
    files: DataFrame, run_id: str, at: datetime, label: str = "content-hash"
) -> DataFrame:
    """Manifest rows for documents that exist as files, from the hash in their first line.

    Takes rows with `root`, `dir` and `content`; files without a hash are left out.
    """
    digest = stored_hash(decode_source(F.col("content")), label)
    found = files.select(*DIRECTORY, digest.alias("content_hash"))
    found = found.where(F.col("content_hash").isNotNull())
    return manifest_rows(found.withColumn("summary_status", F.lit("imported")), run_id, at)


def with_documents(children: DataFrame, current: DataFrame) -> DataFrame:
    """Add `has_document` to child directories (`root`, `dir`, `name`): whether a link to it leads somewhere.

    `current` is the manifest of the directories that have a document.
    """
    child = F.concat_ws("/", F.nullif("dir", F.lit("")), "name")
    stored = current.select("root", F.col("dir").alias("child"), F.lit(True).alias("stored"))
    joined = children.withColumn("child", child).join(stored, ["root", "child"], "left")
    return joined.select("root", "dir", "name", F.coalesce("stored", F.lit(False)).alias("has_document"))


def purge_listing(current: DataFrame, root: str | None = None, below: str = "") -> DataFrame:
    """Directories whose documents a purge removes, in path order."""
    listed = current
    if root is not None:
        listed = listed.where(F.col("root") == root)
    if below:
        directory = F.col("dir")
        listed = listed.where((directory == below) | directory.startswith(below + "/"))
    return listed.orderBy("root", path_order(F.col("dir")))


def run_summary(statuses: DataFrame, dry_run: bool = False) -> DataFrame:
    """Counts of a run from rows of `changed` and `errors`; a dry run writes nothing."""
    written = F.lit(0).cast("bigint") if dry_run else F.count_if("changed")
    skipped = F.count(F.lit(1)) if dry_run else F.count_if(~F.col("changed"))
    return statuses.agg(
        written.alias("written"),
        skipped.alias("skipped"),
        F.coalesce(F.sum("errors"), F.lit(0)).cast("bigint").alias("errors"),
    )
