"""Words and hashes of many texts at once, as numpy arrays.

A task sees an Arrow batch of texts as one byte buffer with offsets. Words,
lines and their hashes are found with whole-array operations over slices of
about a megabyte, so memory follows the longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

# Odd multipliers of the rolling hash and of the mixing step.
BASE = 0x9E3779B97F4A7C15
STEPS = np.array(
    [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)

# The white space between words, and A-Z with its lower case.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_TABLE = bytes.maketrans(UPPER, UPPER.lower())


def byte_class(members: bytes) -> np.ndarray:
    """A lookup table that is true for the bytes of `members`."""
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


SPACE = byte_class(SPACES)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each one starts (one more for the end). Null is empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    starts = starts[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(starts):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def slices(starts: np.ndarray, target: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `target` bytes; one text is never cut."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = int(np.searchsorted(starts, starts[first] + target, "left"))
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * STEPS[0]
    x = x ^ (x >> np.uint64(29))
    x = x * STEPS[1]
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(size, BASE, dtype=np.uint64))
        down = np.cumprod(np.full(size, inverse, dtype=np.uint64))
    return up, down


@dataclass
class Spans:
    """Byte ranges [start, end) with the number of the text each one lies in."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray


class Slice:
    """Some texts in one buffer, in lower case (A-Z only) if asked for."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lower: bool = False):
        raw = data.tobytes()
        self.raw = raw.translate(LOWER_TABLE) if lower else raw
        self.data = np.frombuffer(self.raw, dtype=np.uint8)
        self.starts = starts - starts[0]
        self.count = len(starts) - 1
        self._sums: np.ndarray | None = None

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each text has."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def runs(self, inside: np.ndarray) -> Spans:
        """Maximal runs of flagged bytes that do not cross from one text to the next."""
        n = len(inside)
        if not n:
            none = np.zeros(0, dtype=np.int64)
            return Spans(none, none, none)
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.starts] = True
        begins = inside & (np.concatenate([[True], ~inside[:-1]]) | cut[:-1])
        ends = inside & (np.concatenate([~inside[1:], [True]]) | cut[1:])
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return Spans(start, end, self.text_of(start))

    def words(self, space: np.ndarray = SPACE) -> Spans:
        return self.runs(~space[self.data])

    def lines(self) -> Spans:
        """Lines without their line feed; every text has at least one, perhaps empty."""
        feeds = np.flatnonzero(self.data == 10)
        start = np.concatenate([self.starts[:-1], feeds + 1])
        end = np.concatenate([self.starts[1:], feeds])
        text = np.concatenate([np.arange(self.count), self.text_of(feeds)])
        # Empty texts share a start, so sort by text first; ends pair up in the same order.
        return Spans(start[np.lexsort((start, text))], end[np.lexsort((end, text))], np.sort(text))

    def text_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, "right") - 1

    def hashes(self, spans: Spans) -> np.ndarray:
        """64-bit hashes of the bytes of each span; equal bytes hash alike anywhere."""
        size = 1 << max(12, int(len(self.data)).bit_length())
        up, down = _powers(size)
        if self._sums is None:
            terms = (self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)]
            self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        value = (self._sums[spans.end] - self._sums[spans.start]) * down[
            np.minimum(spans.start, size - 1)
        ]
        return mix(value)


def shingles(words: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` consecutive words of one text, and the place of their first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = np.flatnonzero(text[:n] == text[size - 1 :])
    value = np.zeros(len(whole), np.uint64)
    for k in range(size):
        value = mix(value * STEPS[2] + words[whole + k] * STEPS[3] + np.uint64(k + 1))
    return value, whole


def texts_in(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Slice]]:
    """The slices of an Arrow column of texts, with the rows each one covers."""
    data, starts = text_buffer(column)
    for first, last in slices(starts):
        part = starts[first : last + 1]
        yield first, last, Slice(data[part[0] : part[-1]], part, lower)
