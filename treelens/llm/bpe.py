"""Byte-level BPE: texts to the ids of a rank file, and ids back to bytes.

A text is split by the tokenizer's pattern. Each piece is encoded without
replaying its merges: an Aho-Corasick automaton over all tokens, their bytes
mapped to Latin-1 characters, gives the longest token at every byte. These are
taken from left to right; a token stays if it and the token before it would
come out of the merges of the two side by side, else the next shorter one is
tried, and without one left the token before it is taken back. A place that
was left once is never tried again, so the work is linear in the piece.

Defined results: a null text counts as empty and has no ids. Bytes that are
not UTF-8 count as U+FFFD. Rows are encoded one by one, so repeated and null
ids stay as they are; other columns are not looked at. An empty table gives an
empty result. Of a long text about half a million pieces are held at once, and
of a long piece some 20 bytes per byte.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from treelens.llm.arrays import slices, text_buffer

RANKS = "byte_bpe_multi_50k.tiktoken"
ENCODED = "doc_id long, n_tokens long, ids binary"
# Pieces of a text at once, remembered pieces (in each of two generations) and pairs, and the longest piece
# that is remembered. A piece takes some 250 bytes and a pair 120, in every worker process of an executor.
BLOCK, KNOWN_PIECES, KNOWN_PAIRS, LONG_PIECE = 500_000, 100_000, 250_000, 64
PLANE = 1 << 16  # characters compared at once
# Stands for letters and digits that the tokenizer's Unicode tables do not have: neither of both, nor a space.
NEITHER = "\ue000"


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def tokens_by_rank(rank: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (max(rank.values()) + 1)
    for token, number in rank.items():
        tokens[number] = token
    return tokens


@lru_cache(maxsize=2)
def decoder(path: str) -> list[bytes]:
    """The bytes of each id: all that decoding needs, in processes that do not encode."""
    return tokens_by_rank(ranks(path))


class Vocabulary:
    """Tokens of a rank file, and which two tokens may stand side by side.

    Every token of several bytes must be the merge of two tokens of lower rank,
    as it is in every vocabulary that merges made; others are refused.
    """

    def __init__(self, path: str):
        self.rank = ranks(path)
        self.tokens = tokens_by_rank(self.rank)
        count = len(self.tokens)
        missing = [byte for byte in range(256) if bytes([byte]) not in self.rank]
        if missing:
            raise ValueError(f"{path} has no token for {len(missing)} of the 256 bytes")
        self.size = [len(token) for token in self.tokens]
        self.shorter = [-1] * count
        # The two tokens that each token is merged from; itself for a single byte.
        self.left, self.right = list(range(count)), list(range(count))
        self.merged: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
            starts = (self.rank.get(token[:n], -1) for n in range(len(token) - 1, 0, -1))
            self.shorter[rank] = next((start for start in starts if start >= 0), -1)
        self.automaton.make_automaton()
        for rank, token in enumerate(self.tokens):
            if len(token) > 1:
                self._split(rank, token)
        self.pairs.clear()

    def _split(self, rank: int, token: bytes) -> None:
        first = self.shorter[rank]
        while first >= 0:
            second = self.rank.get(token[self.size[first] :], rank)
            if first < rank and second < rank and self._compatible(first, second):
                self.left[rank], self.right[rank] = first, second
                self.merged[first << 32 | second] = rank
                return
            first = self.shorter[first]
        raise ValueError(f"token {rank} is not a merge of two tokens of lower rank")

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both in one go leaves the border between them.

        Merges are undone from the highest rank down on either side of the
        border. A merge across it that comes before those would have been made.
        """
        limit = 1 << 32
        while True:
            if self.merged.get(a << 32 | b, limit) < limit:
                return False
            # Of equal ranks the left one is merged first, so the right one is undone first.
            for side in ("left", "right") if a > b else ("right", "left"):
                whole = a if side == "left" else b
                part = self.right[a] if side == "left" else self.left[b]
                limit = whole if side == "left" else whole + 1
                if part != whole:
                    a, b = (part, b) if side == "left" else (a, part)
                    break
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        found = self.pairs.get(a << 32 | b)
        if found is None:
            if len(self.pairs) >= KNOWN_PAIRS:
                self.pairs.clear()
            found = self.pairs[a << 32 | b] = self._compatible(a, b)
        return found

    def encode(self, piece: bytes) -> list[int] | array:
        """Ids of one piece."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        n, size, shorter, pairs, compatible = len(piece), self.size, self.shorter, self.pairs, self.compatible
        # Matches come in order of their ends, so the longest one at a place is noted last.
        longest = [0] * n if n <= LONG_PIECE else array("i", bytes(4 * n))
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - size[token]] = token
        open_place = bytearray(b"\1") * (n + 1)
        ids: list[int] | array = [] if n <= LONG_PIECE else array("i")
        at, token = 0, longest[0]
        while True:
            end = at + size[token]
            if open_place[end] and (not ids or pairs.get(ids[-1] << 32 | token) or compatible(ids[-1], token)):
                ids.append(token)
                if end == n:
                    return ids
                at, token = end, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_place[at] = 0
                token = ids.pop()
                at -= size[token]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Splitter:
    """The pieces of texts, as the tokenizer library's own Unicode tables make them."""

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)
        single = {bytes([byte]): byte for byte in range(256)}
        odd: set[str] = set()
        for kind in (r"\p{L}", r"\p{N}", r"\s"):
            library = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
            for first in range(0, 0x110000, PLANE):
                every = "".join(chr(c) for c in range(first, first + PLANE) if not 0xD800 <= c < 0xE000)
                odd ^= set(regex.findall(kind, every)) ^ set(bytes(library.encode_ordinary(every)).decode())
        self.odd = frozenset(odd)
        self.replaced = {ord(c): NEITHER for c in odd}
        # Most texts have no character as high as the first of these.
        self.high = re.compile(f"[{min(odd, default=chr(0x10FFFF))}-{chr(0x10FFFF)}]")

    def pieces(self, text: str) -> Iterator[list[str]]:
        """All pieces in order, in lists of a bounded number."""
        odd = not text.isascii() and self.high.search(text) is not None and not self.odd.isdisjoint(text)
        if not odd and len(text) <= BLOCK:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(text.translate(self.replaced) if odd else text)
        while block := [text[m.start() : m.end()] for m in islice(found, BLOCK)]:
            yield block


@lru_cache(maxsize=2)
def splitter(pattern: str) -> Splitter:
    return Splitter(pattern)


class Pieces(dict):
    """Ids of pieces as little-endian 32-bit integers; recent pieces are remembered."""

    def __init__(self, known: Vocabulary):
        self.known, self.old = known, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = np.asarray(self.known.encode(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONG_PIECE:
            if len(self) >= KNOWN_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def remembered(path: str) -> Pieces:
    """One per worker process, so that tasks after the first know the common pieces."""
    return Pieces(vocabulary(path))


def encode_text(text: str, path: str, pattern: str) -> bytes:
    """Ids of a whole text as little-endian 32-bit integers."""
    ids = remembered(path).__getitem__
    return b"".join(b"".join(map(ids, block)) for block in splitter(pattern).pieces(text))


def bpe_encode(documents: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`doc_id`, `n_tokens`, and `ids` as little-endian 32-bit integers, of every whole `text`.

    `path` names a rank file that every executor has; no special tokens are added.
    """
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_buffer(batch.column(1))
            for first, last in slices(starts):
                texts = (data[starts[k] : starts[k + 1]].tobytes() for k in range(first, last))
                ids = [encode_text(text.decode("utf-8", "replace"), path, pattern) for text in texts]
                counts = pa.array([len(own) // 4 for own in ids], pa.int64())
                columns = [batch.column(0).slice(first, last - first), counts, pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids"])

    return source.mapInArrow(run, ENCODED)


def bpe_decode(ids: Column, path: str | None = None) -> Column:
    """The bytes that ids (little-endian 32-bit integers) stand for; null stays null."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = decoder(path).__getitem__
        for batch in batches:
            decoded = [
                None if own is None else b"".join(map(token, np.frombuffer(own, "<u4").tolist()))
                for own in (value.as_py() for value in batch)
            ]
            yield pa.array(decoded, pa.binary())

    # The type hints above select the iterator form; they must be real types.
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "binary")(ids)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(bpe_decode(F.col("ids")), 256).alias("decoded_sha256"),
    )
