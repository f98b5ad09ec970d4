"""Documents from directory records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelens.functions.markdown import document_layout
from treelens.functions.responses import has_content
from treelens.functions.sections import Layout, sections_of, whole_text
from treelens.functions.text import hash_line
from treelens.operators.pieces import section_rows
from treelens.operators.rollup import Directories
from treelens.operators.summaries import named

DIRECTORY = ["root", "dir"]
PREVIEW_CHARACTERS = 800
PREVIEW_MARK = "\n…[truncated]"


def utc_stamp(at: datetime | None = None) -> str:
    """Time of a run, one value for all of its documents."""
    at = at or datetime.now(timezone.utc)
    return at.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def render_variables(records: DataFrame, generated_at: str) -> DataFrame:
    """Add the columns a layout may use, each with a safe default."""
    summary = F.col("summary")
    return named(records).withColumns(
        {
            "overview": summary["overview"],
            "key_symbols": summary["key_symbols"],
            "patterns": summary["patterns"],
            "tribal_knowledge": summary["tribal_knowledge"],
            "has_summary": has_content(summary),
            "generated_at": F.lit(generated_at),
            "hash_line": hash_line(F.col("content_hash")),
        }
    )


def render(
    directories: Directories,
    generated_at: str,
    layout: Layout = document_layout,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Documents as rows (`root`, `dir`, `content_hash`, `section`, `start`, `markdown`).

    A directory within the limits is one row. A larger one is several; its
    document is their text in order of `section` and `start`. `carry` names
    further columns of the records to keep.
    """
    sections = sections_of(layout)
    variables = render_variables(directories.records, generated_at)
    documents = variables.withColumn("is_first", F.lit(True)).select(
        *DIRECTORY,
        "content_hash",
        *carry,
        F.lit(0).alias("section"),
        F.lit("").alias("start"),
        whole_text(sections).alias("markdown"),
    )
    if directories.heads is None:
        return documents
    heads = replace(directories, heads=render_variables(directories.heads, generated_at))
    rows = section_rows(heads, sections, ["content_hash", *carry])
    return documents.unionByName(rows.withColumnRenamed("text", "markdown"))


def render_column(
    records: DataFrame, generated_at: str, layout: Layout = document_layout
) -> DataFrame:
    """Add `markdown` to gathered directory records."""
    variables = render_variables(records, generated_at).withColumn("is_first", F.lit(True))
    return variables.withColumn("markdown", whole_text(sections_of(layout)))


def shortened(markdown: Column, limit: int = PREVIEW_CHARACTERS) -> Column:
    """The beginning of a document, marked when something was cut off."""
    cut = F.concat(F.left(markdown, F.lit(limit)), F.lit(PREVIEW_MARK))
    return F.when(F.char_length(markdown) > limit, cut).otherwise(markdown)

