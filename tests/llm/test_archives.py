"""Unpacking of archives: any division into gzip members, and work in proportion to the bytes."""

import gzip
import random
import time

import pytest

from treelens.llm.warc import WarcRules, members_of, record, warcinfo


def payloads(count, size=600):
    numbers = random.Random(7)
    return [numbers.randbytes(size) for _ in range(count)]


def archive(blocks):
    return b"".join(gzip.compress(record([("WARC-Type", "response")], block), 1) for block in blocks)


def blocks_of(content):
    return [block for _, block in members_of(content)]


def test_any_division_into_members_gives_the_same_records():
    blocks = payloads(40) + [b"", b"x" * 3_000_000, *payloads(3, 100_000)]
    expected = gzip.decompress(archive(blocks))
    whole = gzip.compress(expected)
    halves = gzip.compress(expected[:30_000]) + b"\0" * 20_000 + gzip.compress(expected[30_000:]) + b"\0"
    for content in (archive(blocks), whole, halves, expected):
        assert blocks_of(content) == blocks
    assert blocks_of(gzip.compress(warcinfo(WarcRules()))) != [] and blocks_of(b"") == []


def test_an_archive_that_ends_too_early_is_an_error():
    content = archive(payloads(3))
    with pytest.raises(EOFError):
        blocks_of(content[:-5])


def test_work_grows_with_the_bytes_and_not_with_their_square():
    def seconds(content, repeats=3):
        best = float("inf")
        for _ in range(repeats):
            begun = time.process_time()
            list(members_of(content))
            best = min(best, time.process_time() - begun)
        return best

    blocks = payloads(16_000)
    small, large = seconds(archive(blocks[:1_000])), seconds(archive(blocks))
    # 16 times the records; copying what follows each of them took well over 100 times as long.
    assert large < 50 * small
