"""Packing of documents into token sequences, along a space-filling curve.

Hashed token counts of a document are projected to a few dimensions, and its
place there to a number on a Hilbert curve. All documents are sorted by that
number with range partitioning, and each range fills sequences one after the
other with the documents in order, cutting them where a sequence is full. So
neighbours in a sequence are alike, and nothing is padded: the rest of a range
is cut into sequences whose lengths are powers of two.

Defined results: a null or empty text has one token, its end mark. Rows with
null or repeated ids are packed one by one. An empty table gives an empty
result. Copies without number share a curve number; ids and row numbers break
the tie, so they spread over ranges as well.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain, pairwise
from math import ceil

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from treelens.llm.arrays import UPPER, slices, text_buffer
from treelens.operators.workspace import written

TOKENIZER = "word_bpe_49k.json"
BATCH = 512  # words encoded at once
# Fixed value: how the vocabulary marks the end of a word.
WORD_END = "</w>"
MARKS = ".,;:!?#$%&*"
MARK_BYTES = MARKS.encode()
LONG_MARKS = 3  # the longest run of marks that is remembered


@dataclass(frozen=True)
class PackRules:
    """Sequence length, end mark, and the curve's space."""

    length: int = 4096
    end_id: int = 2
    buckets: int = 256
    dims: int = 3
    bits: int = 12
    seed: int = 29
    tokens_per_range: int = 4_000_000
    max_ranges: int = 50_000
    cached_words: int = 300_000


# ---- tokens ----


class WordTokenizer:
    """Ids of texts, with the ids of each distinct word worked out once.

    The tokenizer drops white space and never joins what it separates, so the
    ids of a text are those of its words in a row. Words are remembered in two
    generations: what was not met again while a generation filled up is forgotten.
    """

    def __init__(self, path: str, cached_words: int, kind: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.cached_words, self.kind = cached_words, kind
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[number for token, number in vocabulary.items() if token.endswith(WORD_END)]] = True
        normalizer = self.tokenizer.normalizer
        self.lowers = normalizer is not None and normalizer.normalize_str(UPPER.decode()) == UPPER.decode().lower()
        self.specials = [token.content.lower().encode() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = {"": b""}
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """Ids of each text as bytes, and how many each one has."""
        own = [self.folded(text).split() for text in texts]
        words = list(chain.from_iterable(own))
        known = self.known
        found = list(map(known.get, words))
        missed = [k for k, code in enumerate(found) if code is None]
        distinct, old = set(map(words.__getitem__, missed)), self.old
        again = old.keys() & distinct
        known.update(zip(again, map(old.__getitem__, again)))
        letters, others, marked = set(), set(), []
        for word in distinct - again:
            if word.isalpha():
                letters.add(word)
                continue
            stem = word.rstrip(MARK_BYTES)
            # Marks behind a letter are a word of their own.
            if len(stem) == len(word) or not stem[-1:].isalpha():
                others.add(word)
                continue
            marked.append((word, stem))
            if stem in old:
                known[stem] = old[stem]
            elif stem not in known:
                (letters if stem.isalpha() else others).add(stem)
        for fresh in (list(letters), list(others)):
            for at in range(0, len(fresh), BATCH):
                batch = fresh[at : at + BATCH]
                known.update(zip(batch, self.codes(batch)))
        for word, stem in marked:
            known[word] = known[stem] + self.mark_codes(word[len(stem) :].decode())
        for k in missed:
            found[k] = known[words[k]]
        if len(known) > self.cached_words:
            self.known, self.old = {}, known
        ends = list(accumulate(map(len, own), initial=0))
        coded = [b"".join(found[first:last]) for first, last in pairwise(ends)]
        return coded, np.array([len(ids) for ids in coded], np.int64) // np.dtype(self.kind).itemsize

    def folded(self, text: bytes) -> bytes:
        """The text with A-Z in lower case, if the tokenizer does the same and nothing else hangs on it:
        letters that an accent may be composed with, and what would become a special token."""
        if not self.lowers or b"\xcc" in text or b"\xcd" in text:
            return text
        low = text.lower()
        return text if any(special in low for special in self.specials) else low

    def codes(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word. Words of letters, perhaps with marks behind them that are a word of their
        own, are encoded in a row, which costs half as much: the last id of each is one that ends a
        word, and there is no other."""
        texts = b" ".join(words).decode("utf-8", "replace").split(" ")
        stems = [text if text.isalpha() else text.rstrip(MARKS) for text in texts]
        plain = [k for k, stem in enumerate(stems) if stem.isalpha()]
        coded = self.row_codes([stems[k] for k in plain])
        if coded is not None and len(coded) == len(words) and stems == texts:
            return coded
        out: list[bytes | None] = [None] * len(words)
        for k, code in zip(plain, coded or []):
            out[k] = code + self.mark_codes(texts[k][len(stems[k]) :])
        rest = [k for k, code in enumerate(out) if code is None]
        found = self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)
        for k, code in zip(rest, found):
            out[k] = np.array(code.ids, self.kind).tobytes()
        return out

    def row_codes(self, stems: list[str]) -> list[bytes] | None:
        """Ids of words in a row; None if they do not end where the words do."""
        row = self.tokenizer.encode_batch_fast([" ".join(stems)], add_special_tokens=False)[0]
        ids = np.array(row.ids, self.kind)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(stems) or len(ids) and cuts[-1] != len(ids):
            return None
        flat, bounds = ids.tobytes(), [0, *(ids.itemsize * cuts).tolist()]
        return [flat[first:last] for first, last in pairwise(bounds)]

    def mark_codes(self, marks: str) -> bytes:
        code = self.marks.get(marks)
        if code is None:
            ids = self.tokenizer.encode(marks, add_special_tokens=False).ids
            code = np.array(ids, self.kind).tobytes()
            if len(marks) <= LONG_MARKS:
                self.marks[marks] = code
        return code


@lru_cache(maxsize=1)
def word_tokenizer(path: str, cached_words: int, kind: str) -> WordTokenizer:
    """One per worker process, so that tasks after the first know the words; it uses one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path, cached_words, kind)


# ---- places on the curve ----


@lru_cache(maxsize=2)
def projection(rules: PackRules, ids: int) -> np.ndarray:
    """For each token id, its hashed bucket's signed direction in the small space."""
    rng = np.random.default_rng(rules.seed)
    directions = rng.normal(0, 1, (rules.buckets, rules.dims))
    bucket = rng.integers(0, rules.buckets, ids)
    sign = rng.choice([-1.0, 1.0], ids)
    return (directions[bucket] * sign[:, None]).astype(np.float32)


def curve_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of whole-number points, one row each."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(hit, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    key = np.zeros_like(flip)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ flip) >> b) & 1)
    return key


def places(ids: np.ndarray, sizes: np.ndarray, rules: PackRules) -> np.ndarray:
    """Curve numbers of texts from their token ids; a text without tokens is at the middle."""
    table = projection(rules, 1 << 16 if not len(ids) else max(1 << 16, int(ids.max()) + 1))
    # Sums of whole pieces, so that a text's place does not hang on its neighbours.
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    sums = np.zeros((len(sizes), rules.dims))
    filled = np.flatnonzero(sizes > 0)
    if len(filled):
        sums[filled] = np.add.reduceat(table[ids].astype(np.float64), bounds[:-1][filled], axis=0)
    mean = sums / np.maximum(sizes, 1)[:, None]
    top = (1 << rules.bits) - 1
    return curve_key(np.rint((np.tanh(2 * mean) + 1) / 2 * top).astype(np.int64), rules.bits)


TOKENS = "doc_id long, curve long, n_tokens long, ids binary"


def id_type(path: str, rules: PackRules) -> str:
    """Two bytes hold the ids of most vocabularies."""
    top = max(Tokenizer.from_file(path).get_vocab_size() - 1, rules.end_id)
    return "<u2" if top < 1 << 16 else "<u4"


def tokens(documents: DataFrame, path: str, rules: PackRules) -> DataFrame:
    """Token ids with the end mark, and the curve number, of every document."""
    kind = id_type(path, rules)
    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path, rules.cached_words, kind)
        for batch in batches:
            data, starts = text_buffer(batch.column(1))
            for first, last in slices(starts):
                texts = [data[starts[k] : starts[k + 1]].tobytes() for k in range(first, last)]
                coded, sizes = tokenizer.ids(texts)
                curve = places(np.frombuffer(b"".join(coded), kind), sizes, rules)
                end = np.array([rules.end_id], kind).tobytes()
                coded = [own + end for own in coded]
                arrays = [
                    batch.column(0).slice(first, last - first),
                    pa.array(curve, pa.int64()),
                    pa.array(sizes + 1, pa.int64()),
                    pa.array(coded, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "curve", "n_tokens", "ids"])

    return source.mapInArrow(run, TOKENS)


# ---- packing ----

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_length long"
)


class Packer:
    """Fills the sequences of one range in order."""

    def __init__(self, length: int, first_sequence: int):
        self.length, self.sequence = length, first_sequence
        self.open: list[tuple[int | None, int, bytes, int]] = []
        self.filled = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while start < total:
            n = min(total - start, self.length - self.filled)
            self.open.append((doc_id, start, ids[4 * start : 4 * (start + n)], total))
            self.filled += n
            start += n
            if self.filled == self.length:
                self.close(self.length)

    def close(self, length: int) -> None:
        """Emit the first `length` open tokens as one sequence."""
        offset, rest = 0, []
        for doc_id, start, ids, total in self.open:
            n = min(len(ids) // 4, length - offset)
            if n:
                own = ids[: 4 * n]
                self.rows.append((doc_id, start, n, zlib.crc32(own), total, self.sequence, offset, length))
                offset += n
            if 4 * n < len(ids):
                rest.append((doc_id, start + n, ids[4 * n :], total))
        self.open, self.filled = rest, self.filled - length
        self.sequence += 1

    def finish(self) -> None:
        """Cut what is left into sequences of powers of two, longest first."""
        while self.filled:
            self.close(1 << (self.filled.bit_length() - 1))

    def taken(self) -> pa.RecordBatch:
        names = [field.split()[0] for field in PIECES.split(", ")]
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[] for _ in names]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)


def pack(documents: DataFrame, path: str | None = None, rules: PackRules | None = None) -> DataFrame:
    """Pieces of all documents with their sequences.

    Texts are tokenized once; the ids are written to the shared folder, sorted
    by ranges of the curve, and streamed through a packer per range.
    """
    rules = rules or PackRules()
    path = path or public_tokenizers.path(TOKENIZER)
    coded = written(tokens(documents, path, rules), "tokens")
    total = coded.agg(F.sum("n_tokens")).first()[0] or 0
    ranges = min(max(1, ceil(total / rules.tokens_per_range)), rules.max_ranges)
    tied = coded.withColumn("row", F.monotonically_increasing_id())
    order = ["curve", "doc_id", "row"]
    ordered = tied.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "ids")

    kind = id_type(path, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Numbers of sequences are unique over ranges, not gapless.
        packer = Packer(rules.length, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, np.frombuffer(ids.as_py(), kind).astype("<u4").tobytes())
            yield packer.taken()
        packer.finish()
        yield packer.taken()

    return ordered.mapInArrow(run, PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
