"""Text put together from sections.

A section is a text Column that may run along one of a directory's long lists
(`over`). Along a list, the text of two pieces in a row must equal the text of
the whole, so a list too long for one row can be written piece by piece. Inside
such a section `is_first` tells the first piece.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Section:
    text: Column
    over: str | None = None


# Called when a plan is built; either sections, or one Column for the whole text.
Layout = Callable[[], Sequence[Section] | Column]


def sections_of(layout: Layout) -> list[Section]:
    made = layout()
    return [Section(made)] if isinstance(made, Column) else list(made)


def whole_text(sections: Sequence[Section]) -> Column:
    return F.concat(*(section.text for section in sections))


def for_each(items: Column | str, text: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(items, text), "")


def joined_or(items: Column, separator: str, otherwise: str) -> Column:
    """Items joined, or a word for none."""
    return F.coalesce(F.nullif(F.array_join(items, separator), F.lit("")), F.lit(otherwise))


def text_if(condition: Column, text: Column | str) -> Column:
    return F.when(condition, text if isinstance(text, Column) else F.lit(text)).otherwise(
        F.lit("")
    )
