"""The request a summariser gets for a directory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treelens.functions.sections import Section, for_each, joined_or, text_if
from treelens.functions.text import strip

SYSTEM_MESSAGE = (
    "You write short reference notes about source directories for engineers and coding "
    "agents who have not seen them before.\n"
    "Answer with one JSON object and nothing else. Use plain text in all values. Keep the "
    "overview to four sentences, name ten symbols at most, mention only patterns that are "
    "not obvious, and use the hints to say why things are the way they are."
)

INSTRUCTION = (
    "\nAnswer with a JSON object that has exactly these keys:\n"
    '  "overview": string, what the directory is for, in two to four sentences\n'
    '  "key_symbols": array of strings, up to ten functions or classes to know first\n'
    '  "patterns": array of strings, design choices and pitfalls that names do not show\n'
    '  "tribal_knowledge": array of strings, background and reasons for newcomers\n'
    'Where there is nothing to say, use "" or [].'
)

# How many names of a file a prompt lists.
MAX_FUNCTIONS = 15
MAX_CLASSES = 10
MAX_IMPORTS = 15


def _file_block(file: Column) -> Column:
    docstring = F.coalesce(
        F.nullif(strip(file["module_docstring"]), F.lit("")), F.lit("(no docstring)")
    )
    return F.concat(
        F.lit("- "), file["name"], F.lit(" ("), file["size_bytes"].cast("string"), F.lit(" bytes)\n"),
        F.lit("  docstring: "), docstring, F.lit("\n"),
        F.lit("  functions: "), joined_or(F.slice(file["functions"], 1, MAX_FUNCTIONS), ", ", "none"),
        F.lit("\n  classes: "), joined_or(F.slice(file["classes"], 1, MAX_CLASSES), ", ", "none"),
        F.lit("\n  imports: "), joined_or(F.slice(file["imports"], 1, MAX_IMPORTS), ", ", "none"),
        F.lit("\n"),
    )


def prompt_layout() -> list[Section]:
    """Path, children, one block per file, and the instruction."""
    head = F.concat(
        F.lit("Describe this source directory.\n\nDirectory: "), F.col("path"),
        F.lit("\nSubdirectories: "), joined_or(F.col("leading_subdirectories"), ", ", "(none)"),
        F.lit("\n\nSource files:\n"),
        text_if(F.col("file_count") == 0, "(no source files in this directory)\n"),
    )
    return [
        Section(head),
        Section(for_each("files", _file_block), over="files"),
        Section(F.lit(INSTRUCTION)),
    ]


def messages(prompt: Column) -> Column:
    """System and user message."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", F.lit(SYSTEM_MESSAGE)), message("user", prompt))
