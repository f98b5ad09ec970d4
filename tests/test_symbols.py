import pytest

from treelens.operators.listing import with_path_parts
from treelens.operators.records import file_flags
from treelens.operators.symbols import (
    file_records, import_edges, module_metadata, ordered_union, parse_failures, symbols,
)

MODULE = '''"""Title.

    Indented more.
"""
from __future__ import annotations
import os, sys as system
import os
from pathlib import Path

def one():
    import json
    def nested(): ...
    class Inner: ...

async def two(): ...
def one(): ...

class A:
    def method(self): ...

if True:
    def hidden(): ...
    from . import sibling
    from .pkg import thing
    import a.b.c as d

def _three(): ...
class B(A): ...
import late
'''


def corpus(spark, files, root="r"):
    rows = [(root, path, text if isinstance(text, bytes) else text.encode())
            for path, text in files.items()]
    return with_path_parts(
        spark.createDataFrame(rows, "root string, path string, content binary")
    )


def test_module():
    found = module_metadata(MODULE)
    assert found == {
        "module_docstring": "Title.\n\nIndented more.",
        "functions": ["one", "two", "_three"],
        "classes": ["A", "B"],
        # Breadth first: statements inside others come after all top-level ones.
        "imports": ["__future__", "os", "sys", "pathlib", "late", "json", "pkg", "a.b.c"],
        "parse_error": None,
    }


@pytest.mark.parametrize(
    "source, error",
    [("def foo(:", "SyntaxError"), ("a = 1\0", "SyntaxError"), ("﻿x = 1", "SyntaxError"),
     ("  x = 1", "IndentationError")],
)
def test_failures_leave_empty_metadata(source, error):
    found = module_metadata(source)
    assert found.pop("parse_error") in (error, "ValueError")
    assert found == {"module_docstring": None, "functions": [], "classes": [], "imports": []}


@pytest.mark.parametrize(
    "source, docstring",
    [('""', ""), ('"a"', "a"), ('b"a"', None), ('f"a"', None), ("x = 1", None), ("", None)],
)
def test_docstring(source, docstring):
    assert module_metadata(source)["module_docstring"] == docstring


def test_deep_nesting_is_an_error_not_a_crash():
    assert module_metadata("(" * 5000 + ")" * 5000)["parse_error"] is not None


def test_records(spark):
    files = {
        "a.py": MODULE, "copy/a.py": MODULE, "empty.py": "", "bad.py": "def (",
        "latin.py": b'"""\xe9t\xe9"""', "crlf.py": "import x\r\ndef f(): ...\r\n",
    }
    rows = {r.path: r for r in file_records(corpus(spark, files), keep_source=True).collect()}
    assert set(rows) == set(files)
    assert rows["a.py"].content_hash == rows["copy/a.py"].content_hash
    assert rows["a.py"].functions == rows["copy/a.py"].functions == ["one", "two", "_three"]
    assert (rows["empty.py"].size_bytes, rows["empty.py"].module_docstring) == (0, None)
    assert rows["bad.py"].parse_error == "SyntaxError" and rows["bad.py"].imports == []
    assert rows["latin.py"].module_docstring == "été"
    assert rows["crlf.py"].source == "import x\ndef f(): ...\n"


def test_flags_and_failures(spark):
    records = file_records(corpus(spark, {"a.py": MODULE, "b.py": '""', "c.py": "x", "d.py": "("}))
    flags = {r.path: (r.symbol_count, r.is_empty) for r in file_flags(records).collect()}
    assert flags == {"a.py": (5, False), "b.py": (0, False), "c.py": (0, True), "d.py": (0, True)}
    assert [tuple(r) for r in parse_failures(records).collect()] == [("r", "SyntaxError", 1)]


def test_long_form_matches_nested(spark):
    files = {"b.py": "import q, p\ndef g(): ...", "a.py": "import p, r\ndef f(): ...\ndef g(): ..."}
    records = file_records(corpus(spark, files))
    names = symbols(records)
    for kind, column in [("function", "functions"), ("class", "classes"), ("import", "imports")]:
        for row in records.collect():
            long = names.where(f"kind = '{kind}' and path = '{row.path}'").orderBy("ordinal")
            assert [r.symbol for r in long.collect()] == row[column]
    union = ordered_union(names).where("kind = 'import'").orderBy("first_file", "first_ordinal")
    assert [r.symbol for r in union.collect()] == ["p", "r", "q"]
    assert {r.module for r in import_edges(records).collect()} == {"p", "q", "r"}


def test_lone_surrogates_are_spelled_out(spark):
    files = corpus(spark, {"a.py": '"\\ud800"', "b.py": '"""Doc."""'})
    found = {r.path: r.module_docstring for r in file_records(files).collect()}
    assert found["a.py"] == "\\ud800" and found["b.py"] == "Doc."
