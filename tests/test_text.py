import hashlib

import pytest
from pyspark.sql import functions as F

from treelens.functions.text import (
    content_hash, content_size, decode_source, hash_line, stored_hash, strip,
)

H = "0123456789abcdef" * 4


@pytest.mark.parametrize(
    "content", [b"", b"x = 1\n", "é = 'ü'\n".encode(), b"# latin: \xe9\xe0\xfc\n", b"\xff\xfe\x00a"]
)
def test_bytes(spark, content):
    row = spark.createDataFrame([(content,)], "content binary").select(
        content_hash(F.col("content")), content_size(F.col("content")),
        decode_source(F.col("content")),
    ).first()
    try:
        text = content.decode()
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    assert tuple(row) == (hashlib.sha256(content).hexdigest(), len(content), text)


def test_line_endings_and_bom(spark):
    rows = spark.createDataFrame([(b"a\r\nb\rc\n\r\n",), (b"\xef\xbb\xbfx",)], "content binary")
    found = [r[0] for r in rows.select(decode_source(F.col("content"))).collect()]
    assert found == ["a\nb\nc\n\n", "﻿x"]


@pytest.mark.parametrize(
    "document, expected",
    [
        (f"<!-- content-hash: {H} -->\n# x", H),
        (f"  <!--   content-hash:{H}-->  \r\n# x", H),
        (f"<!-- content-hash: {H} -->", H),
        (f"<!-- content-hash: {H[:-1]} -->\n", None),
        (f"<!-- content-hash: {H.upper()} -->\n", None),
        (f"<!-- other-hash: {H} -->\n", None),
        (f"# x\n<!-- content-hash: {H} -->\n", None),
        (f"<!-- content-hash: {H} --> x\n", None),
        ("", None),
        (None, None),
    ],
)
def test_stored_hash(spark, document, expected):
    rows = spark.createDataFrame([(document,)], "d string")
    assert rows.select(stored_hash(F.col("d"))).first()[0] == expected


def test_hash_line_round_trip_and_other_label(spark):
    row = spark.createDataFrame([(H,)], "h string").select(
        stored_hash(hash_line(F.col("h"))), stored_hash(hash_line(F.col("h"), "my-hash"), "my-hash")
    ).first()
    assert tuple(row) == (H, H)


def test_strip(spark):
    text = " \x1c \t a b \n\x85"
    assert spark.createDataFrame([(text,)], "t string").select(strip(F.col("t"))).first()[0] == text.strip()
