"""The default layout of a directory's document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treelens.functions.ignore import DOCUMENT_NAME
from treelens.functions.sections import Section, for_each, joined_or, text_if

# Headings of the document format, and what stands in for empty parts.
OVERVIEW = "## Overview"
SOURCE_FILES = "## Source Files"
FILE_TABLE = "| File | Size | Functions | Classes |\n|------|------|-----------|---------|\n"
FILE_DETAILS = "### File Details"
KEY_SYMBOLS = "## Key Symbols"
DEPENDENCIES = "## Dependencies"
PATTERNS = "## Non-Obvious Patterns"
TRIBAL_KNOWLEDGE = "## Tribal Knowledge"
SUBDIRECTORIES = "## Subdirectories"
NO_OVERVIEW = "*No summary available for this directory.*"
NO_FILES = "*No source files directly in this directory.*"
NO_DOCSTRING = "*No module docstring.*"
NO_SYMBOLS = "*No symbols found.*"
ALL_SYMBOLS = "*No key symbols summarised; all extracted symbols:*"
NO_IMPORTS = "*No imports detected.*"
NO_PATTERNS = "*No patterns identified.*"
NO_TRIBAL_KNOWLEDGE = "*No tribal knowledge recorded.*"
NO_SUBDIRECTORIES = "*No subdirectories.*"
NO_NAMES = "—"

RULE = "\n---\n\n"


def _ticked(names: Column | str) -> Column:
    return F.array_join(
        F.transform(names, lambda n: F.concat(F.lit("`"), n, F.lit("`"))), ", "
    )


def _line_of(label: str, names: Column) -> Column:
    return text_if(F.size(names) > 0, F.concat(F.lit(f"\n**{label}:** "), _ticked(names), F.lit("\n")))


def _file_row(file: Column) -> Column:
    return F.concat(
        F.lit("| `"), file["name"], F.lit("` | "), file["size_bytes"].cast("string"), F.lit(" B | "),
        joined_or(file["functions"], ", ", NO_NAMES), F.lit(" | "),
        joined_or(file["classes"], ", ", NO_NAMES), F.lit(" |\n"),
    )


def _file_details(file: Column) -> Column:
    docstring = F.coalesce(
        F.nullif(file["module_docstring"], F.lit("")), F.lit(NO_DOCSTRING)
    )
    return F.concat(
        F.lit("\n#### `"), file["name"], F.lit("`\n\n"), docstring, F.lit("\n"),
        _line_of("Functions", file["functions"]),
        _line_of("Classes", file["classes"]),
        _line_of("Imports", file["imports"]),
    )


def _bullets_or(items: str, otherwise: str) -> Column:
    return F.when(
        F.size(items) > 0, for_each(items, lambda i: F.concat(F.lit("- "), i, F.lit("\n")))
    ).otherwise(F.lit(f"{otherwise}\n"))


def document_layout() -> list[Section]:
    """Header, overview, files, symbols, dependencies, patterns, hints, children, footer."""
    col = F.col
    has_files = col("file_count") > 0
    show_all = F.size("key_symbols") == 0
    functions = show_all & (col("all_functions_count") > 0)
    classes = show_all & (col("all_classes_count") > 0)
    comma = text_if(~col("is_first"), ", ")
    overview = F.coalesce(F.nullif(col("overview"), F.lit("")), F.lit(NO_OVERVIEW))
    header = F.concat(
        col("hash_line"), F.lit("\n# Context: "), col("dir_name"),
        F.lit("\n\n> Generated on "), col("generated_at"),
        F.lit("  \n> Directory: `"), col("path"), F.lit("`\n"),
        F.lit(f"{RULE}{OVERVIEW}\n\n"), overview, F.lit("\n"),
        F.lit(f"{RULE}{SOURCE_FILES}\n\n"),
        F.when(has_files, F.lit(FILE_TABLE)).otherwise(F.lit(f"{NO_FILES}\n")),
    )
    key_symbols = (
        F.when(
            ~show_all,
            for_each("key_symbols", lambda s: F.concat(F.lit("- `"), s, F.lit("`\n"))),
        )
        .when(functions | classes, F.lit(f"{ALL_SYMBOLS}\n"))
        .otherwise(F.lit(f"{NO_SYMBOLS}\n"))
    )
    closing = F.concat(
        F.lit(f"{RULE}{PATTERNS}\n\n"),
        _bullets_or("patterns", NO_PATTERNS),
        F.lit(f"{RULE}{TRIBAL_KNOWLEDGE}\n\n"),
        _bullets_or("tribal_knowledge", NO_TRIBAL_KNOWLEDGE),
        F.lit(f"{RULE}{SUBDIRECTORIES}\n\n"),
        text_if(col("subdirectories_count") == 0, f"{NO_SUBDIRECTORIES}\n"),
    )

    def link(child: Column) -> Column:
        return F.concat(F.lit("- [`"), child, F.lit("/`]("), child, F.lit(f"/{DOCUMENT_NAME})\n"))

    return [
        Section(header),
        Section(for_each("files", _file_row), over="files"),
        Section(text_if(has_files, f"\n{FILE_DETAILS}\n")),
        Section(for_each("files", _file_details), over="files"),
        Section(
            F.concat(
                F.lit(f"{RULE}{KEY_SYMBOLS}\n\n"), key_symbols,
                text_if(functions, "\n**Functions:** "),
            )
        ),
        Section(
            text_if(functions, F.concat(comma, _ticked("all_functions"))), over="all_functions"
        ),
        Section(F.concat(text_if(functions, "\n"), text_if(classes, "\n**Classes:** "))),
        Section(text_if(classes, F.concat(comma, _ticked("all_classes"))), over="all_classes"),
        Section(
            F.concat(
                text_if(classes, "\n"),
                F.lit(f"{RULE}{DEPENDENCIES}\n\n"),
                text_if(col("all_imports_count") == 0, f"{NO_IMPORTS}\n"),
            )
        ),
        Section(
            for_each("all_imports", lambda m: F.concat(F.lit("- `"), m, F.lit("`\n"))),
            over="all_imports",
        ),
        Section(closing),
        Section(for_each("subdirectories", link), over="subdirectories"),
        Section(F.concat(F.lit(RULE + "*Content hash: `"), col("content_hash"), F.lit("`*\n"))),
    ]
