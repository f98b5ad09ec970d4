"""Documents as text files, one per directory."""

from __future__ import annotations

import os
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelens.functions.ignore import DOCUMENT_NAME
from treelens.operators.groups import task_count


def mounted(folder: str) -> str:
    """The path of a folder that is mounted on all executors; other file systems are refused."""
    path = folder.removeprefix("file://").removeprefix("file:")
    if ":/" in path.split("/", 1)[0] + "/" or not path.startswith("/"):
        raise ValueError(f"not an absolute path of a mounted folder: {folder}")
    return path


def export_documents(
    documents: DataFrame, folder: str, file_name: str = DOCUMENT_NAME
) -> DataFrame:
    """Write every document to a file of its directory; see `export_files`."""
    path = F.concat_ws("/", F.nullif("dir", F.lit("")), F.lit(file_name))
    return export_files(
        documents.select("root", path.alias("path"), "section", "start", "markdown"), folder
    )


def remove_exported(
    listed: DataFrame, folder: str, file_name: str = DOCUMENT_NAME
) -> DataFrame:
    """Delete the exported documents of listed directories (`root`, `dir`).

    Returns one row per directory with the error, if any; running it deletes. A
    file that is already gone is no error, so a repeated task is harmless.
    """
    base = mounted(folder)

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = []
            for root, directory in zip(batch["root"], batch["dir"]):
                try:
                    os.unlink(os.path.join(base, root.strip("/"), directory, file_name))
                    errors.append(None)
                except FileNotFoundError:
                    errors.append(None)
                except OSError as failure:
                    errors.append(str(failure))
            yield batch.assign(error=pd.Series(errors, dtype=object))

    return listed.select("root", "dir").mapInPandas(remove, "root string, dir string, error string")


def export_files(texts: DataFrame, folder: str) -> DataFrame:
    """Write texts (`root`, `path`, `section`, `start`, `markdown`) as UTF-8 files.

    Returns one row per file with its size or error; running it writes. The
    folder must be a path that all executors can reach. Each file appears by
    rename, so a repeated task leaves the same result.
    """
    base = mounted(folder)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["root", "path", "bytes", "error"]
        file = None
        for batch in batches:
            done = []
            for root, path, text in zip(batch["root"], batch["path"], batch["markdown"]):
                if file is None or file.key != (root, path):
                    if file is not None:
                        done.append(file.finish())
                    file = _OutputFile(base, root, path)
                file.add(text)
            yield pd.DataFrame(done, columns=columns)
        if file is not None:
            yield pd.DataFrame([file.finish()], columns=columns)

    # The parts of one file meet in one task, which streams them.
    together = texts.repartition(task_count(texts), "root", "path")
    ordered = together.sortWithinPartitions("root", "path", "section", "start")
    return ordered.select("root", "path", "markdown").mapInPandas(
        write, "root string, path string, bytes bigint, error string"
    )


class _OutputFile:
    """One file being written under a task's own name until it is complete."""

    def __init__(self, folder: str, root: str, path: str):
        self.key = (root, path)
        self.target = os.path.join(folder, root.strip("/"), path)
        self.part = f"{self.target}.{uuid4().hex}.part"
        self.size, self.error, self.stream = 0, None, None
        try:
            os.makedirs(os.path.dirname(self.target), exist_ok=True)
            self.stream = open(self.part, "wb")
        except OSError as failure:
            self.error = str(failure)

    def add(self, text: str) -> None:
        if self.error is None:
            try:
                self.size += self.stream.write(text.encode())
            except OSError as failure:
                self.error = str(failure)

    def finish(self) -> tuple:
        try:
            if self.stream is not None:
                self.stream.close()
            if self.error is None:
                os.replace(self.part, self.target)
        except OSError as failure:
            self.error = str(failure)
        return (*self.key, self.size if self.error is None else None, self.error)
