"""Records as JSON and back, and their derived flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelens.functions.responses import LIST_FIELDS, SUMMARY, has_content, no_items
from treelens.functions.sections import Section, for_each

FILE = (
    "path string, relative_path string, size_bytes bigint, content_hash string, source string, "
    "module_docstring string, functions array<string>, classes array<string>, "
    "imports array<string>"
)
DIRECTORY = (
    f"path string, files array<struct<{FILE}>>, subdirectories array<string>, "
    f"content_hash string, summary {SUMMARY}"
)


def file_struct(source: Column | None = None) -> Column:
    """A file record, from the columns of `file_records`, in its exchange shape."""
    return F.struct(
        F.concat_ws("/", "root", "path").alias("path"),
        F.col("name").alias("relative_path"),
        "size_bytes",
        "content_hash",
        (F.lit(None).cast("string") if source is None else source).alias("source"),
        "module_docstring",
        "functions",
        "classes",
        "imports",
    )


def _exchanged_file(f: Column) -> Column:
    """A member of a directory record in its exchange shape."""
    return F.struct(
        F.concat_ws("/", "path", f["name"]).alias("path"),
        f["name"].alias("relative_path"),
        f["size_bytes"].alias("size_bytes"),
        f["content_hash"].alias("content_hash"),
        F.lit(None).cast("string").alias("source"),
        f["module_docstring"].alias("module_docstring"),
        *(f[name].alias(name) for name in ("functions", "classes", "imports")),
    )


def directory_struct() -> Column:
    """A directory record that carries `path`, in its exchange shape."""
    files = F.transform("files", _exchanged_file)
    return F.struct("path", files.alias("files"), "subdirectories", "content_hash")


def record_layout() -> list[Section]:
    """The JSON of a directory record as sections; `closed_record` completes their text.

    Items end with a comma and lists with a character that JSON text never holds.
    """

    def inside(json: Column) -> Column:
        return F.substr(json, F.lit(2), F.length(json) - 2)

    return [
        Section(F.concat(F.lit("{"), inside(as_json(F.struct("path"))), F.lit(',"files":['))),
        Section(for_each("files", lambda f: F.concat(as_json(_exchanged_file(f)), F.lit(","))), "files"),
        Section(F.lit('\x00],"subdirectories":[')),
        Section(
            for_each("subdirectories", lambda d: F.concat(inside(F.to_json(F.array(d))), F.lit(","))),
            "subdirectories",
        ),
        Section(F.concat(F.lit("\x00],"), inside(as_json(F.struct("content_hash"))), F.lit("}"))),
    ]


def closed_record(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(",\x00"), F.lit("")), F.lit("\x00"), F.lit(""))


def as_json(record: Column) -> Column:
    """Every field is written, nulls included."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def _required(record: Column, field: str) -> Column:
    message = F.lit(f"record without '{field}'")
    return F.coalesce(record[field], F.raise_error(message).cast("string"))


def _file_defaults(record: Column) -> Column:
    return F.struct(
        _required(record, "path").alias("path"),
        record["relative_path"].alias("relative_path"),
        F.coalesce(record["size_bytes"], F.lit(0)).alias("size_bytes"),
        F.coalesce(record["content_hash"], F.lit("")).alias("content_hash"),
        record["source"].alias("source"),
        record["module_docstring"].alias("module_docstring"),
        *(
            F.coalesce(record[name], no_items()).alias(name)
            for name in ("functions", "classes", "imports")
        ),
    )


def _summary_defaults(summary: Column) -> Column:
    lists = (
        F.filter(F.coalesce(summary[field], no_items()), lambda item: item.isNotNull())
        for field in LIST_FIELDS
    )
    return F.struct(
        F.coalesce(summary["overview"], F.lit("")).alias("overview"),
        *(items.alias(field) for items, field in zip(lists, LIST_FIELDS)),
    )


def file_from_json(text: Column) -> Column:
    """Missing keys get defaults, unknown keys are ignored, a missing path is an error."""
    return _file_defaults(F.from_json(text, FILE))


def summary_from_json(text: Column) -> Column:
    return _summary_defaults(F.from_json(text, SUMMARY))


def directory_from_json(text: Column) -> Column:
    record = F.from_json(text, DIRECTORY)
    files = F.coalesce(record["files"], F.array().cast(f"array<struct<{FILE}>>"))
    return F.struct(
        _required(record, "path").alias("path"),
        F.transform(files, _file_defaults).alias("files"),
        F.coalesce(record["subdirectories"], no_items()).alias("subdirectories"),
        F.coalesce(record["content_hash"], F.lit("")).alias("content_hash"),
        F.when(record["summary"].isNotNull(), _summary_defaults(record["summary"])).alias(
            "summary"
        ),
    )


def empty_file(path: Column, relative_path: Column | None = None) -> Column:
    """A blank record that stands in for a file that could not be analysed."""
    nothing = F.lit(None).cast("string")
    return F.struct(
        path.alias("path"),
        (nothing if relative_path is None else relative_path).alias("relative_path"),
        F.lit(0).cast("bigint").alias("size_bytes"),
        F.lit("").alias("content_hash"),
        nothing.alias("source"),
        nothing.alias("module_docstring"),
        *(no_items().alias(name) for name in ("functions", "classes", "imports")),
    )


def empty_directory(path: Column) -> Column:
    """A blank record of a directory without files and without a summary."""
    return F.struct(
        path.alias("path"),
        F.array().cast(f"array<struct<{FILE}>>").alias("files"),
        no_items().alias("subdirectories"),
        F.sha2(F.lit(""), 256).alias("content_hash"),
        F.lit(None).cast(SUMMARY).alias("summary"),
    )


def file_flags(records: DataFrame) -> DataFrame:
    """Add `is_empty` and `symbol_count` to file records."""
    nothing = F.col("module_docstring").isNull()
    symbols = F.size("functions") + F.size("classes")
    return records.withColumns({"symbol_count": symbols, "is_empty": nothing & (symbols == 0)})


def directory_flags(records: DataFrame) -> DataFrame:
    """Add `is_empty` and `has_content` to directory records that carry a summary."""
    return records.withColumns(
        {"is_empty": F.col("file_count") == 0, "has_content": has_content(F.col("summary"))}
    )
