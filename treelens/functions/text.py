"""Bytes and text of source files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.strip() removes.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def content_hash(content: Column) -> Column:
    """sha256 of the raw bytes, in lowercase hex."""
    return F.sha2(content, 256)


def content_size(content: Column) -> Column:
    """Size in bytes."""
    return F.octet_length(content).cast("bigint")


def decode_source(content: Column) -> Column:
    """Bytes as UTF-8, else latin-1, with every line ending turned into a newline."""
    raw = content.cast("binary")
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(
        F.decode(raw, "ISO-8859-1")
    )
    newline = F.lit("\n")
    return F.replace(F.replace(text, F.lit("\r\n"), newline), F.lit("\r"), newline)


def strip(text: Column) -> Column:
    """Remove blanks of every kind at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def stored_hash(document: Column, label: str = "content-hash") -> Column:
    """Hash kept in the first line of a written document; NULL if there is none."""
    first_line = strip(F.substring_index(F.substring_index(document, "\n", 1), "\r", 1))
    pattern = rf"\A<!--\s*{label}:\s*([0-9a-f]{{64}})\s*-->\z"
    return F.nullif(F.regexp_extract(first_line, pattern, 1), F.lit(""))


def hash_line(digest: Column, label: str = "content-hash") -> Column:
    """First line of a document; `stored_hash` reads it back."""
    return F.concat(F.lit(f"<!-- {label}: "), digest, F.lit(" -->"))


def valid_text(text: str) -> str:
    """A Python string with lone surrogates, which no column can hold, spelled as escapes."""
    return text.encode("utf-8", "backslashreplace").decode("utf-8")
