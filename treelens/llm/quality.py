"""Quality rules, line first.

Each line is judged on its own: how it ends, whether it is a row of links,
whether it is boilerplate. Lines that fail are taken out, and a document that
loses too many of its words with them is rejected. Counts of the whole text
give the base rules: too few words, or too many in repeated windows.

Defined results: a null or empty text has no words and fails; repeated rows are
judged alike, each on its own; an empty table gives an empty result. Only
`doc_id` and `text` are read, whatever the other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelens.llm.arrays import SPACE, Slice, Spans, byte_class, shingles, texts_in

SYMBOLS = byte_class(b"#*$%&|<>")

# How a sentence may end: as last byte, or as the last three bytes of a closing mark.
SENTENCE_END = byte_class(b".!?:;\"')]")
CLOSING_MARKS = ("…", "”", "’", "»", "。", "！", "？")
SEPARATORS = byte_class(b"|>")
# Small letters; those beyond ASCII begin with one of the lead bytes of Latin, Greek and Cyrillic letters.
SMALL = byte_class(bytes([*range(97, 123), *range(0xC3, 0xD2)]))

BOILERPLATE = (
    "accept cookies",
    "all rights reserved",
    "back to top",
    "click here",
    "cookie policy",
    "enable javascript",
    "forgot your password",
    "log in",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "share this",
    "sign in",
    "sign up",
    "subscribe to",
    "terms of service",
    "terms of use",
    "use of cookies",
)


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules; shares are of words."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_lost_share: float = 0.5
    separators_per_line: int = 3
    max_marked_share: float = 0.5
    short_line: int = 30
    wrapped_words: int = 4
    boilerplate: tuple[str, ...] = BOILERPLATE


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words")
SCHEMA = (
    "doc_id long, "
    + ", ".join(f"{name} long" for name in COUNTS)
    + ", base_failed boolean, kept boolean"
)


def quality(documents: DataFrame, rules: QualityRules | None = None, with_text: bool = False) -> DataFrame:
    """Counts and verdict of every document; with `with_text` also what its good lines leave.

    One pass over the scan, without a shuffle.
    """
    rules = rules or QualityRules()
    schema = SCHEMA + (", cleaned string" if with_text else "")
    narrow = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, last, part in texts_in(batch.column(1)):
                columns = judge_slice(part, rules, with_text)
                arrays = [ids.slice(first, last - first), *map(pa.array, columns.values())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *columns])

    return narrow.mapInArrow(judge, schema)


def judge_slice(part: Slice, rules: QualityRules, with_text: bool) -> dict[str, object]:
    space = SPACE[part.data]
    words, lines = part.words(), part.lines()
    hashes = part.hashes(words)
    n_words = np.bincount(words.text, minlength=part.count)
    whole_chars = (part.data & 0xC0) != 0x80
    line_of_word = np.searchsorted(lines.start, words.start, "right") - 1
    words_in_line = np.bincount(line_of_word, minlength=len(lines.start))
    bad = failing(part, words, lines, line_of_word, words_in_line, rules)
    lost = np.bincount(lines.text, weights=words_in_line * bad, minlength=part.count)
    repeated = repeated_words(hashes, words.text, part.count)
    base_failed = (n_words < rules.min_words) | (100 * repeated > rules.max_repeat_percent * n_words)
    out: dict[str, object] = {
        "n_words": n_words,
        "word_chars": part.per_text(whole_chars & ~space),
        "n_symbols": part.per_text(SYMBOLS[part.data]),
        "n_dup_lines": repeated_lines(part, lines, words_in_line),
        "n_repeat_words": repeated,
        "lost_words": lost.astype(np.int64),
        "base_failed": base_failed,
        "kept": ~base_failed & (lost <= rules.max_lost_share * n_words),
    }
    if with_text:
        out["cleaned"] = without_lines(part, lines, bad)
    return out


def failing(
    part: Slice,
    words: Spans,
    lines: Spans,
    line_of_word: np.ndarray,
    words_in_line: np.ndarray,
    rules: QualityRules,
) -> np.ndarray:
    """Lines with words that fail a rule."""
    n = len(lines.start)
    if not len(words.start):
        return np.zeros(n, dtype=bool)
    filled = words_in_line > 0
    # The last word of each line that has one.
    last = np.flatnonzero(np.append(line_of_word[1:] != line_of_word[:-1], True))
    ends = ends_sentence(part, words.end[last])
    closed = np.zeros(n, dtype=bool)
    closed[line_of_word[last]] = ends
    marks = np.concatenate([[0], np.cumsum(SEPARATORS[part.data], dtype=np.int64)])
    links = marks[lines.end] - marks[lines.start]
    # Words followed by doubled marks, such as shouting or debris of markup.
    tail = part.data[words.end - 1]
    before = part.data[np.maximum(words.end - 2, words.start)]
    doubled = (tail == before) & MARKS[tail] & (words.end - words.start > 1)
    marked = np.bincount(line_of_word, weights=doubled, minlength=n)
    navigation = links >= rules.separators_per_line
    # A sentence may go on in the next line, which then begins with a small letter.
    first = np.flatnonzero(np.insert(line_of_word[1:] != line_of_word[:-1], 0, True))
    small = np.zeros(n + 1, dtype=bool)
    small[line_of_word[first]] = SMALL[part.data[words.start[first]]]
    follows = np.append(lines.text[1:] == lines.text[:-1], False)
    goes_on = follows & small[1:] & (words_in_line >= rules.wrapped_words)
    open_end = ~closed & ~goes_on & (words_in_line < rules.short_line)
    bad = navigation | open_end | (marked > rules.max_marked_share * words_in_line)
    lowered = part.raw.lower()
    for phrase in rules.boilerplate:
        found = places(lowered, phrase.encode())
        if found:
            at = np.searchsorted(lines.start, np.array(found), "right") - 1
            # A phrase inside a long sentence is no boilerplate line.
            bad[at[words_in_line[at] <= rules.short_line]] = True
    return bad & filled


MARKS = byte_class(b"!#$%&*?<>|=~^_")


def places(text: bytes, phrase: bytes) -> list[int]:
    found, at = [], text.find(phrase)
    while at >= 0:
        found.append(at)
        at = text.find(phrase, at + 1)
    return found


def ends_sentence(part: Slice, ends: np.ndarray) -> np.ndarray:
    """Whether the byte ranges that stop at `ends` stop like a sentence."""
    good = SENTENCE_END[part.data[ends - 1]]
    for mark in CLOSING_MARKS:
        code = mark.encode()
        same = ends >= len(code)
        for k, byte in enumerate(reversed(code)):
            same = same & (part.data[np.maximum(ends - 1 - k, 0)] == byte)
        good = good | same
    return good


def repeated_lines(part: Slice, lines: Spans, words_in_line: np.ndarray) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier one."""
    filled = np.flatnonzero(words_in_line > 0)
    text = lines.text[filled]
    value = part.hashes(Spans(lines.start[filled], lines.end[filled], text))
    order = np.lexsort((value, text))
    again = (np.diff(text[order]) == 0) & (value[order][1:] == value[order][:-1])
    return np.bincount(text[order][1:][again], minlength=part.count)


def repeated_words(hashes: np.ndarray, text: np.ndarray, count: int) -> np.ndarray:
    """Per text, the words in three-word windows that the text has twice or more."""
    value, place = shingles(hashes, text, 3)
    if not len(value):
        return np.zeros(count, dtype=np.int64)
    owner = text[place]
    order = np.lexsort((value, owner))
    same = (np.diff(owner[order]) == 0) & (value[order][1:] == value[order][:-1])
    twice = np.append(same, False) | np.insert(same, 0, False)
    covered = np.zeros(len(hashes), dtype=bool)
    for k in range(3):
        covered[place[order[twice]] + k] = True
    return np.bincount(text[covered], minlength=count)


def without_lines(part: Slice, lines: Spans, bad: np.ndarray) -> list[str]:
    """The texts without their bad lines."""
    any_bad = np.bincount(lines.text, weights=bad, minlength=part.count) > 0
    bounds = np.searchsorted(lines.text, np.arange(part.count + 1))
    out = []
    for k in range(part.count):
        if not any_bad[k]:
            piece = part.raw[part.starts[k] : part.starts[k + 1]]
        else:
            own = range(bounds[k], bounds[k + 1])
            piece = b"\n".join(part.raw[lines.start[i] : lines.end[i]] for i in own if not bad[i])
        out.append(piece.decode("utf-8", "replace"))
    return out


def quality_stage(documents: DataFrame, rules: QualityRules | None = None) -> DataFrame:
    """The documents that are kept, without their bad lines; same columns.

    A document is judged by its row: rows are matched through the pass itself,
    so repeated ids are no trouble, and nothing is shuffled.
    """
    rules = rules or QualityRules()
    names = documents.columns
    text = names.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, part in texts_in(batch.column(text)):
                verdict = judge_slice(part, rules, True)
                rows = batch.slice(first, last - first)
                arrays = rows.columns
                cleaned = pa.array(verdict["cleaned"], pa.string())
                arrays[text] = cleaned.cast(batch.schema.field(text).type)
                if "n_chars" in names:
                    at = names.index("n_chars")
                    lengths = pa.compute.utf8_length(cleaned)
                    arrays[at] = lengths.cast(batch.schema.field(at).type)
                kept = pa.array(verdict["kept"])
                yield pa.RecordBatch.from_arrays(arrays, batch.schema.names).filter(kept)

    return documents.mapInArrow(clean, documents.schema)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
