"""File trees as a source.

Spark's own file sources leave out empty files and everything whose name starts
with `_` or `.`, `__init__.py` among them. This source lists all of it. Listing
and reading are separate: a listing is small and is dealt out to tasks by size
before any bytes are read, so one huge directory does not become one huge task.

A tree is listed in rounds. The directories that wait are dealt out to tasks;
each walks down from its own until it has listed enough, and hands back what it
has not entered, for the next round to deal out again. The driver knows the
roots only, and it does not matter at which depth a tree branches.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.functions.ignore import IgnoreRules
from treelens.operators.bundles import in_bundles
from treelens.operators.symbols import ARROW_METADATA, METADATA, Parser, module_metadata, source_text
from treelens.operators.workspace import new_folder

LISTING = "kind string, root string, path string, length bigint, read_error string"
CONTENTS = "root string, path string, length bigint, content binary, read_error string"
HASHES = "root string, path string, size_bytes bigint, content_hash string, read_error string"
# What a task hands back for the next round.
WAITING = "waiting"
TASKS_PER_CORE = 4
TASK_BYTES = 256 << 20
# Opening a file costs about as much as reading this many bytes of one.
OPEN_BYTES = 64 << 10
CHUNK_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
BATCH_ROWS = 1024
# A column's value may not be longer.
MAX_VALUE_BYTES = (1 << 31) - (1 << 20)
# The syntax tree of a source takes many times its size.
DEFAULT_MAX_PARSED = 1 << 30
TOO_LONG_TO_PARSE = "SourceTooLarge"


@dataclass(frozen=True)
class Patience:
    """How much a task lists before it hands the rest back."""

    directories: int = 2_000
    entries: int = 500_000
    # With fewer directories than tasks, it is enough to have found so many more.
    found: int = 8


class Walker:
    """Lists directories; `rules` and `max_depth` tell which ones are entered."""

    def __init__(self, rules: IgnoreRules, max_depth: int | None):
        self.rules, self.max_depth = rules, max_depth

    def round(self, patience: Patience, scarce: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """The work of one task: rows of what is there, and of directories left for later."""

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            stack = [
                start
                for batch in batches
                for start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            ]
            rows, directories, entries = [], 0, 0
            while stack:
                enough = directories >= patience.directories or entries >= patience.entries
                if directories and (enough or scarce and len(stack) >= patience.found):
                    break
                root, directory = stack.pop()
                if directory == "":
                    rows.append(("dir", root, "", None, None))
                for row in self._entries(root, directory):
                    rows.append(row)
                    entries += 1
                    if row[0] == "dir" and self._enters(row[2]):
                        stack.append((root, row[2]))
                    if len(rows) >= BATCH_ROWS:
                        yield _batch(rows, _LISTING)
                        rows = []
                directories += 1
            rows += [(WAITING, root, directory, None, None) for root, directory in stack]
            for at in range(0, len(rows), BATCH_ROWS):
                yield _batch(rows[at : at + BATCH_ROWS], _LISTING)

        return walk

    def _enters(self, directory: str) -> bool:
        """Whether a walk goes into this directory: not ignored, and not too deep."""
        deep = self.max_depth is not None and directory.count("/") + 1 > self.max_depth
        return not deep and not self.rules.matches_text(directory + "/")

    def _entries(self, root: str, directory: str) -> Iterator[tuple]:
        """Rows for the entries of one directory. Linked directories are named, never entered."""
        at = os.path.join(root, directory)
        try:
            with os.scandir(at) as entries:
                for entry in entries:
                    path = f"{directory}/{entry.name}" if directory else entry.name
                    yield self._entry(entry, root, path)
        except OSError as error:
            yield ("error", root, directory, None, str(error))

    @staticmethod
    def _entry(entry: os.DirEntry, root: str, path: str) -> tuple:
        try:
            path.encode()
        except UnicodeEncodeError:
            shown = path.encode(errors="backslashreplace").decode()
            return ("error", root, shown, None, "name is not valid UTF-8")
        try:
            if entry.is_dir(follow_symlinks=False):
                return ("dir", root, path, None, None)
            mode = entry.stat()
        except OSError as error:
            return ("error", root, path, None, str(error))
        if stat.S_ISDIR(mode.st_mode):
            return ("linked_dir", root, path, None, None)
        if not stat.S_ISREG(mode.st_mode):
            return ("other", root, path, None, None)
        return ("file", root, path, mode.st_size, None)


_KEYS = [("root", pa.string()), ("path", pa.string())]
_ERROR = ("read_error", pa.string())
_LISTING = pa.schema([("kind", pa.string()), *_KEYS, ("length", pa.int64()), _ERROR])
_CONTENTS = pa.schema([*_KEYS, ("length", pa.int64()), ("content", pa.binary()), _ERROR])
_HASHES = pa.schema([*_KEYS, ("size_bytes", pa.int64()), ("content_hash", pa.string()), _ERROR])
_RECORDS = pa.schema([*_HASHES, *ARROW_METADATA])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(values, field.type) for values, field in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def list_trees(
    spark: SparkSession,
    roots: list[str],
    ignore: IgnoreRules = IgnoreRules(),
    max_depth: int | None = None,
    below: str = "",
    patience: Patience = Patience(),
) -> DataFrame:
    """Files and directories below the roots, which all executors must be able to reach.

    `below` starts at a directory of each root instead of its top. The listing is
    done when this returns, and kept as a table: one part per round, so a lost
    executor costs its directories of that round.
    """
    walker, folder, number = Walker(ignore, max_depth), new_folder(spark, "entries", lasting=True), 0
    starts = list(dict.fromkeys((os.path.abspath(root), below) for root in roots))
    waiting = spark.createDataFrame(starts, "root string, path string")
    count, tasks = len(starts), TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    while count or number == 0:
        dealt = waiting.repartition(max(min(count, tasks), ceil(count / patience.directories), 1))
        part = f"{folder}/round={number}"
        dealt.mapInArrow(walker.round(patience, count < tasks), LISTING).write.parquet(part)
        left = spark.read.schema(LISTING).parquet(part).where(F.col("kind") == WAITING)
        waiting, number = left.select("root", "path"), number + 1
        count = waiting.count()
    entries = spark.read.schema(LISTING).parquet(folder)
    return entries.where(F.col("kind") != WAITING).drop("round")


# ---- reading ----


def _dealt_out(files: DataFrame, partitions: int | None) -> DataFrame:
    """Listed files in bundles of about `TASK_BYTES`, or in `partitions` of like size."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    weight = F.coalesce("length", F.lit(0)) + F.lit(OPEN_BYTES)
    size = TASK_BYTES if partitions is None else 1 << 62
    return in_bundles(files.select("root", "path", "length"), weight, size, partitions or cores)


def _read_rows(
    files: DataFrame,
    row_of: Callable[[dict], tuple[tuple, int]],
    failed: Callable[[dict, str], tuple],
    kinds: str,
    schema: pa.Schema,
    partitions: int | None,
) -> DataFrame:
    """One row per file: `row_of` gives it with the bytes it holds, `failed` that of an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for listed in batch.to_pylist():
                try:
                    row, size = row_of(listed)
                except OSError as failure:
                    row, size = failed(listed, str(failure)), 0
                rows.append(row)
                held += size
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield _batch(rows, schema)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, schema)

    return _dealt_out(files, partitions).mapInArrow(read, kinds)


def _place(listed: dict, most: int | None) -> str:
    if most is not None and listed["length"] > most:
        raise OSError(f"larger than {most} bytes")
    return os.path.join(listed["root"], listed["path"])


def read_contents(
    files: DataFrame, max_file_bytes: int | None = None, partitions: int | None = None
) -> DataFrame:
    """Bytes of listed files; what cannot be read has a `read_error` and no content.

    A file that no column's value can hold is such an error; `read_hashes` and
    `read_records` take files of any size.
    """
    most = MAX_VALUE_BYTES if max_file_bytes is None else min(max_file_bytes, MAX_VALUE_BYTES)

    def row_of(listed: dict) -> tuple[tuple, int]:
        with open(_place(listed, most), "rb") as stream:
            content = stream.read()
        return (listed["root"], listed["path"], listed["length"], content, None), len(content)

    def failed(listed: dict, error: str) -> tuple:
        return (listed["root"], listed["path"], listed["length"], None, error)

    return _read_rows(files, row_of, failed, CONTENTS, _CONTENTS, partitions)


def digest_file(path: str, keep: int = -1) -> tuple[int, str, bytes | None]:
    """Size, sha256 and, up to `keep` bytes, the content of a file, read in chunks."""
    digest, size, kept = sha256(), 0, []
    with open(path, "rb") as stream:
        while chunk := stream.read(CHUNK_BYTES):
            digest.update(chunk)
            size += len(chunk)
            if size <= keep:
                kept.append(chunk)
            else:
                kept.clear()
    return size, digest.hexdigest(), b"".join(kept) if size <= keep else None


def read_hashes(
    files: DataFrame, max_file_bytes: int | None = None, partitions: int | None = None
) -> DataFrame:
    """Size and sha256 of listed files of any size, in constant memory; no bytes leave the worker."""

    def row_of(listed: dict) -> tuple[tuple, int]:
        size, digest, _ = digest_file(_place(listed, max_file_bytes))
        return (listed["root"], listed["path"], size, digest, None), 0

    def failed(listed: dict, error: str) -> tuple:
        return (listed["root"], listed["path"], None, None, error)

    return _read_rows(files, row_of, failed, HASHES, _HASHES, partitions)


def read_records(
    files: DataFrame,
    max_file_bytes: int | None = None,
    partitions: int | None = None,
    max_parsed_bytes: int = DEFAULT_MAX_PARSED,
) -> DataFrame:
    """`read_hashes` and the symbols of each file from one read, parsed where it is read.

    A source beyond `max_parsed_bytes` has its hash and size, and a parse error
    instead of symbols, as any other that the parser cannot take.
    """
    nothing, parser = module_metadata(None), Parser()

    def row_of(listed: dict) -> tuple[tuple, int]:
        size, digest, content = digest_file(_place(listed, max_file_bytes), max_parsed_bytes)
        if content is None:
            found = nothing | {"parse_error": TOO_LONG_TO_PARSE}
        else:
            found = parser.found(digest, lambda: source_text(content))
        return (listed["root"], listed["path"], size, digest, None, *found.values()), 0

    def failed(listed: dict, error: str) -> tuple:
        return (listed["root"], listed["path"], None, None, error, *nothing.values())

    return _read_rows(files, row_of, failed, f"{HASHES}, {METADATA}", _RECORDS, partitions)
