"""What a worker process of the byte BPE keeps: two small generations of pieces, and no automaton to decode."""

import tracemalloc

import public_tokenizers
import pytest

from treelens.llm import bpe

MEGABYTE = 1 << 20


class Letters:
    """Stands for a vocabulary of single bytes."""

    def encode(self, piece):
        return list(piece)


@pytest.fixture
def traced():
    tracemalloc.start()
    yield tracemalloc
    tracemalloc.stop()


def test_remembered_pieces_stay_few_whatever_is_met(traced):
    pieces = bpe.Pieces(Letters())
    before = traced.get_traced_memory()[0]
    for number in range(790_000):
        pieces[f" w{number}"]
    kept = traced.get_traced_memory()[0] - before
    assert pieces[" w5"] == b"".join(byte.to_bytes(4, "little") for byte in b" w5")
    # With 400,000 pieces to a generation it was more, which two such processes and their decoders did not leave an executor.
    assert kept < 80 * MEGABYTE


def test_tables_of_the_splitter_are_compared_in_parts(traced):
    before = traced.get_traced_memory()[0]
    made = bpe.Splitter(public_tokenizers.PATTERN)
    assert traced.get_traced_memory()[1] - before < 40 * MEGABYTE
    assert all(len(c) == 1 for c in made.odd)


def test_the_decoder_holds_the_tokens_alone(traced):
    path = public_tokenizers.path(bpe.RANKS)
    before = traced.get_traced_memory()[0]
    tokens = bpe.decoder.__wrapped__(path)
    kept = traced.get_traced_memory()[0] - before
    known = bpe.Vocabulary(path)
    assert tokens == known.tokens
    assert kept < 5 * MEGABYTE < traced.get_traced_memory()[0] - before - kept
