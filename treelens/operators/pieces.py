"""Texts of directories that may be too large for one row of members."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelens.functions.sections import Section, whole_text
from treelens.operators.groups import in_pieces, task_count
from treelens.operators.rollup import DIRECTORY, Directories
from treelens.operators.workspace import written

# A text of more characters may not fit into one value, which holds 2 GiB.
MAX_CHARACTERS = 1 << 28


def section_rows(
    directories: Directories,
    sections: Sequence[Section],
    carry: Sequence[str] = (),
    save: Callable[[DataFrame, str], DataFrame] = written,
) -> DataFrame:
    """Sections of the directories beyond the limits as rows (`section`, `start`, `text`).

    The text of a directory is theirs in order of `section` and `start`. A list
    is sorted and cut once, however many sections run along it.
    """
    cut = {over: save(_pieces(directories, over), "pieces") for over in _lists_of(sections)}
    found = None
    for number, section in enumerate(sections):
        along = section.over is not None
        pieces = _with_heads(cut[section.over], directories, section.over) if along else directories.heads
        part = pieces.select(
            *DIRECTORY,
            *carry,
            F.lit(number).alias("section"),
            (F.col("start") if along else F.lit("")).alias("start"),
            section.text.alias("text"),
        )
        found = part if found is None else found.unionByName(part)
    return found


def whole_texts(
    directories: Directories,
    sections: Sequence[Section],
    carry: Sequence[str] = (),
    save: Callable[[DataFrame, str], DataFrame] = written,
) -> DataFrame:
    """One row per directory of any size: `root`, `dir`, `carry` and its `text`.

    For texts that are one value by definition, such as a request. One that no
    value can hold is null.
    """
    gathered = directories.records.withColumn("is_first", F.lit(True)).select(
        *DIRECTORY, *carry, whole_text(sections).alias("text")
    )
    if directories.heads is None:
        return gathered
    rows = save(section_rows(directories, sections, save=save), "sections")
    fitting = rows.groupBy(*DIRECTORY).agg(F.sum(F.char_length("text")).alias("characters"))
    fitting = fitting.where(F.col("characters") <= MAX_CHARACTERS).select(*DIRECTORY)
    parts = F.array_sort(F.collect_list(F.struct("section", "start", "text")))
    texts = rows.join(fitting, DIRECTORY).groupBy(*DIRECTORY).agg(
        F.array_join(parts["text"], "").alias("text")
    )
    heads = directories.heads.select(*DIRECTORY, *carry).join(texts, DIRECTORY, "left")
    return gathered.unionByName(heads)


def text_digests(rows: DataFrame) -> DataFrame:
    """sha256 and length of texts that come in several rows (`section`, `start`, `markdown`).

    Each text is read in order by one task that keeps none of it.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running, characters = None, None, 0
        names = ["root", "dir", "text_hash", "characters"]
        for batch in batches:
            done = []
            for root, directory, text in zip(*(column.to_pylist() for column in batch.columns)):
                if (root, directory) != key:
                    if key is not None:
                        done.append((*key, running.hexdigest(), characters))
                    key, running, characters = (root, directory), sha256(), 0
                running.update(text.encode())
                characters += len(text)
            yield _digest_batch(done, names)
        if key is not None:
            yield _digest_batch([(*key, running.hexdigest(), characters)], names)

    together = rows.repartition(task_count(rows), *DIRECTORY)
    ordered = together.sortWithinPartitions(*DIRECTORY, "section", "start")
    schema = "root string, dir string, text_hash string, characters bigint"
    return ordered.select(*DIRECTORY, "markdown").mapInArrow(digest, schema)


def _digest_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = [[row[at] for row in rows] for at in range(len(names))]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _lists_of(sections: Sequence[Section]) -> list[str]:
    return list(dict.fromkeys(section.over for section in sections if section.over is not None))


def _pieces(directories: Directories, over: str) -> DataFrame:
    """A long list, cut into consecutive pieces; they sort by where they `start`."""
    if over == "files":
        order = ["name"]
        member = F.struct("name", *(c for c in directories.files.columns if c not in (*order, *DIRECTORY)))
        rows, gathered = directories.files, F.array_sort(F.collect_list(member)).alias("files")
        start = F.min("name")
    else:
        order = ["at_file", "at"]
        rows = directories.lists.where(F.col("list") == over)
        in_order = F.array_sort(F.collect_list(F.struct("at_file", "at", "item")))
        gathered = in_order["item"].alias(over)
        # The start sorts as text: file name first, then the place within the file.
        start = F.min(F.concat("at_file", F.lit("\x00"), F.lpad(F.col("at").cast("string"), 10, "0")))
    pieces = in_pieces(rows, [*DIRECTORY, *order], directories.cut)
    return pieces.groupBy(*DIRECTORY, "piece").agg(start.alias("start"), gathered)


def _with_heads(pieces: DataFrame, directories: Directories, over: str) -> DataFrame:
    """Pieces with the variables of their directories, as a section sees them."""
    is_first = F.lit(True)
    if over != "files":
        is_first = F.element_at(over, 1) == F.element_at(F.col(f"leading_{over}"), 1)
    return pieces.join(directories.heads, DIRECTORY).withColumn("is_first", is_first)
