"""Whole runs: generate, preview, adopt, purge."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.functions.ignore import DEFAULT_IGNORE, DOCUMENT_NAME, IgnoreRules
from treelens.functions.markdown import document_layout
from treelens.functions.paths import SOURCE_SUFFIX
from treelens.functions.sections import Layout
from treelens.operators.changes import (
    change_status,
    current_manifest,
    manifest_of_documents,
    manifest_rows,
    purge_listing,
    run_summary,
)
from treelens.operators.groups import Limits
from treelens.operators.listing import child_directories, is_member, reached
from treelens.operators.render import render, shortened, utc_stamp
from treelens.operators.rollup import directory_hashes, directory_records, with_roots
from treelens.operators.sinks import remove_exported
from treelens.operators.store import Store
from treelens.operators.summaries import SummarizerFactory, summarize
from treelens.operators.workspace import Scratch, scratch, written
from treelens.sources.corpus import MAX_BROADCAST_DIRECTORIES, TableCorpus, TreeCorpus

DIRECTORY = ["root", "dir"]
Corpus = TableCorpus | TreeCorpus


@dataclass(frozen=True)
class Run:
    """What a run did: its documents, files it could not read, and its counts.

    A dry run stores nothing, so its results still read tables that it wrote on
    its way; `discard` removes them. Other runs have removed theirs.
    """

    run_id: str
    documents: DataFrame
    rejects: DataFrame
    counts: DataFrame
    left: Scratch | None = None

    def discard(self) -> None:
        if self.left is not None:
            self.left.discard()


def _started(at: datetime | None) -> tuple[datetime, str]:
    """Time and id of a run."""
    at = at or datetime.now(timezone.utc)
    return at, at.strftime("%Y%m%dT%H%M%S%f") + "-" + uuid4().hex[:8]


def generate(
    corpus: Corpus,
    store: Store,
    *,
    ignore: Iterable[str] = DEFAULT_IGNORE,
    max_depth: int | None = None,
    suffix: str = SOURCE_SUFFIX,
    summarizer: str | SummarizerFactory = "extractive",
    layout: Layout = document_layout,
    force: bool = False,
    dry_run: bool = False,
    retry_failed: bool = False,
    limits: Limits = Limits(),
    at: datetime | None = None,
    **asking,
) -> Run:
    """Write the documents of all directories that changed since the last run.

    Where everything has to be written, a first run or a forced one, files are
    hashed and parsed in one scan. Else they are hashed first, and only what lies
    in changed directories is read again and parsed. A dry run renders every
    directory with the extractive summary, shortened, and writes nothing to the
    store.
    """
    spark, rules = corpus.spark, IgnoreRules.of(ignore)
    at, run_id = _started(at)
    conditions = [is_member(rules, suffix), reached(rules, max_depth)]
    with scratch(spark) as own:
        known = current_manifest(store.manifest(spark))
        every = force or dry_run or known.isEmpty()
        read = corpus.records(conditions) if every else corpus.hashes(conditions)
        read = written(read, "records" if every else "hashes")
        readable = read.where(F.col("read_error").isNull())
        unread = read.where(F.col("read_error").isNotNull()).select("root", "path", "read_error")
        rejects = corpus.rejects.unionByName(unread)
        hashes = directory_hashes(with_roots(readable, corpus.roots), limits)
        status = written(change_status(hashes, known, force or dry_run, retry_failed), "status")

        changed = status.where("changed").select(*DIRECTORY)
        n_changed, n = status.agg(F.count_if("changed"), F.count(F.lit(1))).first()
        if n_changed == 0:
            counts = _kept(run_summary(status.withColumn("errors", F.lit(0))))
            store.append(rejects, "rejects", run_id)
            store.commit(spark, run_id)
            return _finished(spark, store, run_id, counts)
        some_unchanged = n_changed < n
        if every:
            records = readable
        else:
            records = corpus.records(conditions, changed if some_unchanged else None, n_changed)
            records = records.where(F.col("read_error").isNull())
            if some_unchanged and n_changed > MAX_BROADCAST_DIRECTORIES:
                records = records.join(changed, DIRECTORY, "left_semi")
            records = written(records, "records")
        children = child_directories(corpus.directories, rules).where(reached(rules, max_depth))
        if some_unchanged:
            children = children.join(changed, DIRECTORY, "left_semi")

        roots = changed.where(F.col("dir") == "").select("root")
        directories = directory_records(records, children, roots, limits)
        how = "extractive" if dry_run else summarizer
        directories = summarize(directories, how, written, **asking)
        documents = render(directories, utc_stamp(at), layout, carry=["summary_status", "error"])

        if dry_run:
            own.keep()
            documents = documents.withColumn("markdown", shortened(F.col("markdown")))
            counts = run_summary(status.withColumn("errors", F.lit(0)), dry_run=True)
            return Run(run_id, documents, rejects, counts, own)

        store.append(documents, "documents", run_id)
        store.append(rejects, "rejects", run_id)
        # A document in several rows has the same hash and status in each.
        made = store.written_by(spark, run_id).groupBy(*DIRECTORY).agg(
            F.first("content_hash").alias("content_hash"),
            F.first("summary_status").alias("summary_status"),
            F.first("error").alias("error"),
        )
        failed = made.select(*DIRECTORY, F.col("error").isNotNull().cast("int").alias("errors"))
        counts = _kept(run_summary(status.join(failed, DIRECTORY, "left")))
        store.commit(spark, run_id, manifest_rows(made, run_id, at))
        return _finished(spark, store, run_id, counts)


def _kept(counts: DataFrame) -> DataFrame:
    """One row of counts that no longer hangs on the tables it was counted from."""
    return counts.sparkSession.createDataFrame([counts.first()], counts.schema)


def _finished(spark: SparkSession, store: Store, run_id: str, counts: DataFrame) -> Run:
    rejects = store.written_by(spark, run_id, "rejects").drop("run_id")
    return Run(run_id, store.written_by(spark, run_id), rejects, counts)


def preview(
    corpus: Corpus,
    root: str,
    directory: str,
    *,
    ignore: Iterable[str] = DEFAULT_IGNORE,
    suffix: str = SOURCE_SUFFIX,
    summarizer: str | SummarizerFactory = "extractive",
    layout: Layout = document_layout,
    limits: Limits = Limits(),
    at: datetime | None = None,
    **asking,
) -> DataFrame:
    """The document of one directory, from its own files alone; nothing is stored.

    Only this directory is listed or, in a table, only its range of paths is read.
    """
    rules = IgnoreRules.of(ignore)
    records, below = corpus.one_directory(root, directory, is_member(rules, suffix))
    records = written(records, "records")
    if "read_error" in records.columns:
        records = records.where(F.col("read_error").isNull())
    one = corpus.spark.range(1).select(F.lit(root).alias("root"), F.lit(directory).alias("dir"))
    directories = directory_records(records, child_directories(below, rules), one, limits)
    directories = summarize(directories, summarizer, written, **asking)
    return render(directories, utc_stamp(at), layout)


def adopt(
    corpus: Corpus,
    store: Store,
    *,
    label: str = "content-hash",
    file_name: str = DOCUMENT_NAME,
    at: datetime | None = None,
) -> DataFrame:
    """Take over documents that lie in the corpus as files, so that they count as written.

    Looks everywhere, whatever the patterns of later runs. Their texts stay
    where they are; returns the manifest rows.
    """
    spark = corpus.spark
    at, run_id = _started(at)
    files = corpus.contents([F.col("name") == file_name]).where(F.col("read_error").isNull())
    store.commit(spark, run_id, manifest_of_documents(files, run_id, at, label))
    return store.manifest(spark).where(F.col("run_id") == run_id)


def purge(
    store: Store,
    spark: SparkSession,
    root: str | None = None,
    below: str = "",
    folder: str | None = None,
    at: datetime | None = None,
) -> DataFrame:
    """Remove the documents below a directory; returns `root`, `dir` and an `error`, if any.

    They are marked deleted first, so that none counts any more whatever
    happens later. With `folder`, the files that were exported to it go then; a
    purge that is repeated finds no documents, and `remove_exported` removes the
    files of its list again.
    """
    at, run_id = _started(at)
    listed = written(purge_listing(current_manifest(store.manifest(spark)), root, below), "purge")
    store.commit(spark, run_id, manifest_rows(listed, run_id, at, deleted=True))
    if folder is None:
        return listed.select("root", "dir", F.lit(None).cast("string").alias("error"))
    return written(remove_exported(listed, folder), "purged")
