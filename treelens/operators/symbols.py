"""Symbols of Python sources.

Parsing is a map over the rows: bytes are hashed and decoded in the JVM, the
text goes to the workers in Arrow batches, and only the small result comes
back. Bytes are never shuffled. A task parses a content it meets again only
once, so a content with very many copies costs one parse per task.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from treelens.functions.text import content_hash, content_size, decode_source, valid_text
from treelens.operators.groups import spread_if_small

METADATA = (
    "module_docstring string, functions array<string>, classes array<string>, "
    "imports array<string>, parse_error string"
)
ARROW_METADATA = pa.schema(
    [
        ("module_docstring", pa.string()),
        ("functions", pa.list_(pa.string())),
        ("classes", pa.list_(pa.string())),
        ("imports", pa.list_(pa.string())),
        ("parse_error", pa.string()),
    ]
)
_ARROW = pa.struct(list(ARROW_METADATA))
# Remembered results per task: enough for vendored copies, small in memory.
_MEMORY = 4096
_LONG_TEXT = 1 << 20


def source_text(content: bytes) -> str:
    """Bytes as UTF-8, else latin-1, with newlines; the same as `decode_source`."""
    try:
        text = content.decode()
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def module_metadata(source: str | None) -> dict:
    """Docstring, top-level names and imported modules of one source text."""
    found = {"module_docstring": None, "functions": [], "classes": [], "imports": []}
    if source is None:
        return found | {"parse_error": None}
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except Exception as error:
        return found | {"parse_error": type(error).__name__}

    def named(*kinds: type) -> list[str]:
        return list(dict.fromkeys(n.name for n in tree.body if isinstance(n, kinds)))

    modules: dict[str, None] = {}
    for node in ast.walk(tree):
        match node:
            case ast.Import(names=aliases):
                modules.update((alias.name, None) for alias in aliases)
            case ast.ImportFrom(module=str(module)):
                modules[module] = None
    docstring = ast.get_docstring(tree)
    return {
        "module_docstring": None if docstring is None else valid_text(docstring),
        "functions": [valid_text(name) for name in named(ast.FunctionDef, ast.AsyncFunctionDef)],
        "classes": [valid_text(name) for name in named(ast.ClassDef)],
        "imports": [valid_text(name) for name in modules],
        "parse_error": None,
    }


class Parser:
    """Parses contents, each one once as long as it is remembered by its hash."""

    def __init__(self):
        self.known: dict[str | None, dict] = {}

    def found(self, digest: str | None, source: Callable[[], str | None]) -> dict:
        row = self.known.get(digest)
        if row is None:
            text = source()
            row = module_metadata(text)
            if len(self.known) >= _MEMORY:
                self.known.clear()
            if text is None or len(text) < _LONG_TEXT:
                self.known[digest] = row
        return row


def _metadata(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    parser = Parser()
    for hashes, sources in batches:
        rows = [parser.found(key.as_py(), text.as_py) for key, text in zip(hashes, sources)]
        yield pa.array(rows, _ARROW)


def parse(digest: Column, source: Column) -> Column:
    """Struct of docstring, functions, classes, imports and parse error.

    It counts as non-deterministic, or a filter on its fields, such as the one
    Spark adds below an explode, would be pushed down as a second parse.
    """
    return arrow_udf(_metadata, METADATA).asNondeterministic()(digest, source)


def file_records(files: DataFrame, keep_source: bool = False, spread: bool = True) -> DataFrame:
    """One record per file that has `root`, `path`, `dir`, `name` and `content`.

    Select and filter the files first: nothing is pushed below the parser. Files
    of a tree are dealt out before they are read; `spread` is for tables only.
    """
    hashed = (spread_if_small(files) if spread else files).select(
        "root",
        "path",
        "dir",
        "name",
        content_size(F.col("content")).alias("size_bytes"),
        content_hash(F.col("content")).alias("content_hash"),
        decode_source(F.col("content")).alias("source"),
    )
    parsed = hashed.withColumn("found", parse(F.col("content_hash"), F.col("source")))
    kept = ["root", "path", "dir", "name", "size_bytes", "content_hash"]
    return parsed.select(*kept, *(["source"] if keep_source else []), "found.*")


def symbols(records: DataFrame) -> DataFrame:
    """Long form: one row per name a file defines or imports, in file order."""

    def rows(kind: str, column: str) -> Column:
        return F.transform(
            column,
            lambda name, at: F.struct(
                F.lit(kind).alias("kind"), name.alias("symbol"), at.alias("ordinal")
            ),
        )

    every = F.concat(
        rows("function", "functions"), rows("class", "classes"), rows("import", "imports")
    )
    return records.select(
        "root", "path", "dir", "name", "content_hash", F.inline(every)
    )


def ordered_union(names: DataFrame) -> DataFrame:
    """Distinct symbols per directory and kind with the place of their first occurrence.

    Ordering by (`first_file`, `first_ordinal`) gives first-occurrence order. The
    minimum is taken before the shuffle, so a name used everywhere stays small.
    """
    first = F.min(F.struct(F.col("name").alias("file"), F.col("ordinal"))).alias("first")
    return (
        names.groupBy("root", "dir", "kind", "symbol")
        .agg(first)
        .select(
            "root",
            "dir",
            "kind",
            "symbol",
            F.col("first.file").alias("first_file"),
            F.col("first.ordinal").alias("first_ordinal"),
        )
    )


def import_rows(records: DataFrame) -> DataFrame:
    """Every module a file imports, with its place among the file's imports."""
    return records.select("root", "dir", "path", F.posexplode("imports").alias("ordinal", "module"))


def import_edges(records: DataFrame) -> DataFrame:
    """Distinct edges from a directory to the modules its files import."""
    return records.select("root", "dir", F.explode("imports").alias("module")).distinct()


def parse_failures(records: DataFrame) -> DataFrame:
    """Files per kind of parse error."""
    failed = records.where(F.col("parse_error").isNotNull())
    return failed.groupBy("root", "parse_error").agg(F.count(F.lit(1)).alias("files"))
