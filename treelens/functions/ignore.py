"""gitignore-style patterns as native predicates.

Patterns are turned into regular expressions once, on the driver, and become a
`CASE` over `RLIKE`: no Python runs per row. The expressions use only syntax
that Java, Python and RE2 read alike, so the tree source can apply the same
rules while it lists.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from treelens.functions.paths import prefixes

DOCUMENT_NAME = "CONTEXT.md"

# The directories and files left out unless the caller says otherwise.
DEFAULT_IGNORE = (
    ".git",
    ".hg",
    ".svn",
    "__pycache__",
    "*.pyc",
    "*.pyo",
    ".mypy_cache",
    ".pytest_cache",
    ".ruff_cache",
    "node_modules",
    ".venv",
    "venv",
    "env",
    ".env",
    "dist",
    "build",
    "*.egg-info",
    DOCUMENT_NAME,
)

_SPECIAL = frozenset(r"\.^$|?*+()[]{}&~#- ")


def _literal(char: str) -> str:
    return "\\" + char if char in _SPECIAL else char


def _bracket(segment: str, start: int) -> tuple[str, int]:
    """Character class opening at `start`, and the position after it."""
    first = start + 1
    negated = segment[first : first + 1] in ("!", "^")
    first += negated
    # A closing bracket in first place stands for itself.
    close = segment.find("]", first + 1)
    if close < 0:
        return "\\[", start + 1
    body = "".join(c if c == "-" else _literal(c) for c in segment[first:close])
    return f"[{'^' if negated else ''}{body}]", close + 1


def _segment(segment: str) -> str:
    """Regex for one path component."""
    if segment == "*":
        return "[^/]+"
    out, at = [], 0
    while at < len(segment):
        char = segment[at]
        if char == "*":
            out.append("[^/]*")
        elif char == "?":
            out.append("[^/]")
        elif char == "[":
            piece, at = _bracket(segment, at)
            out.append(piece)
            continue
        elif char == "\\" and at + 1 < len(segment):
            at += 1
            out.append(_literal(segment[at]))
        else:
            out.append(_literal(char))
        at += 1
    return "".join(out)


def compile_pattern(line: str) -> tuple[str, bool] | None:
    """One pattern line as (regex for the whole path, verdict); None if it has no effect."""
    line = line.lstrip() if line.endswith("\\ ") else line.strip()
    if not line or line.startswith("#") or line == "/":
        return None
    verdict = not line.startswith("!")
    if not verdict:
        line = line[1:]
    only_dirs = line.endswith("/")
    anchored = "/" in line.rstrip("/") or line.startswith("/")
    parts = [part for part in line.split("/") if part]
    if not parts:
        return None
    if not anchored and parts[0] != "**":
        parts.insert(0, "**")

    # `**` swallows any number of whole components, including none.
    regex = ""
    needs_slash = False
    for position, part in enumerate(parts):
        first, last = position == 0, position == len(parts) - 1
        if part != "**":
            regex += ("/" if needs_slash else "") + _segment(part)
            needs_slash = True
        elif first and last:
            regex += "[^/]+" if only_dirs else "[^/]+(?:/.*)?"
            needs_slash = True
        elif first:
            regex += "(?:.+/)?"
        elif last:
            return regex + "/.*", verdict
        elif parts[position - 1] != "**":
            regex += "(?:/.+)?"
    if only_dirs:
        regex += "/.*"
    elif parts[-1] != "**":
        regex += "(?:/.*)?"
    return regex, verdict


@dataclass(frozen=True)
class IgnoreRules:
    """An ordered list of patterns; the last one that matches decides."""

    patterns: tuple[str, ...] = ()

    @classmethod
    def of(cls, patterns: Iterable[str] | IgnoreRules | None) -> IgnoreRules:
        if isinstance(patterns, IgnoreRules):
            return patterns
        return cls(tuple(patterns or ()))

    @cached_property
    def steps(self) -> list[tuple[str, bool]]:
        """(regex, verdict) in order of precedence, equal neighbours merged into one."""
        compiled = [c for c in map(compile_pattern, self.patterns) if c is not None]
        return [
            ("|".join(regex for regex, _ in run), verdict)
            for verdict, run in groupby(reversed(compiled), key=lambda c: c[1])
        ]

    def matches(self, path: Column) -> Column:
        """True where the path is ignored; directories are given with a trailing slash."""
        verdict = None
        for regex, value in self.steps:
            hit = path.rlike(rf"(?s)\A(?:{regex})\z")
            verdict = F.when(hit, F.lit(value)) if verdict is None else verdict.when(
                hit, F.lit(value)
            )
        return F.lit(False) if verdict is None else verdict.otherwise(F.lit(False))

    def prunes(self, directory: Column) -> Column:
        """True where the directory or one above it is ignored, files below included.

        A later negation cannot bring back anything inside a pruned directory.
        """
        if not self.steps:
            return F.lit(False)
        return F.exists(
            prefixes(directory), lambda d: self.matches(F.concat(d, F.lit("/")))
        )

    def matches_text(self, path: str) -> bool:
        """The same verdict for one Python string, used while listing a file system."""
        for regex, verdict in self.steps:
            if re.fullmatch(regex, path, re.DOTALL):
                return verdict
        return False
