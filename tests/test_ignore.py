import pytest
from pyspark.sql import functions as F

from treelens.functions.ignore import DEFAULT_IGNORE, IgnoreRules

CASES = [
    (["*.pyc"], {"a.pyc": True, "x/a.pyc": True, "a.py": False}),
    ([".git"], {".git": True, ".git/": True, ".git/config": True, "x/.git/y": True, "a.git": False}),
    (["__pycache__"], {"__pycache__/": True, "a/__pycache__/b.pyc": True, "a__pycache__": False}),
    (["build"], {"build": True, "build/": True, "build/x/y": True, "x/build": True}),
    (["build/"], {"build": False, "build/": True, "build/x": True, "x/build/y": True}),
    (["/x.py"], {"x.py": True, "a/x.py": False}),
    (["src/x.py"], {"src/x.py": True, "a/src/x.py": False, "x.py": False}),
    (["**/__pycache__/**"], {"__pycache__/a": True, "x/__pycache__/a": True, "__pycache__": False}),
    (["a/**"], {"a/b": True, "a/b/c": True, "a": False, "b/a/c": False}),
    (["a/**/b"], {"a/b": True, "a/x/b": True, "a/x/y/b/c": True, "ab": False}),
    (["*.log", "!keep.log"], {"a.log": True, "keep.log": False, "x/keep.log": False}),
    (["!keep.log", "*.log"], {"keep.log": True}),
    (["?.py"], {"a.py": True, "ab.py": False, "/.py": False}),
    (["[ab].py"], {"a.py": True, "c.py": False}),
    (["[!ab].py", "[^ab].txt"], {"a.py": False, "c.py": True, "c.txt": True, "a.txt": False}),
    (["[]x].py"], {"].py": True, "x.py": True, "y.py": False}),
    (["a[.py"], {"a[.py": True, "a.py": False}),
    (["# note", "", "   ", "/"], {"# note": False, "a": False}),
    ([r"\#a", r"\!b"], {"#a": True, "!b": True, "a": False}),
    (["a.py  "], {"a.py": True}),
    ([r"a\ "], {"a ": True, "a": False}),
    (["*"], {"a": True, "a/b": True}),
    (["**"], {"a": True, "a/b": True}),
    (["a*b/*"], {"axb/c": True, "axb": False, "x/axb/c": False}),
    (["a+b(c).py"], {"a+b(c).py": True, "aab(c).py": False}),
    ([], {"a": False}),
]


@pytest.mark.parametrize("patterns, expected", CASES)
def test_patterns(spark, patterns, expected):
    rules = IgnoreRules.of(patterns)
    rows = spark.createDataFrame([(p,) for p in expected], "path string")
    found = {r[0]: r[1] for r in rows.select("path", rules.matches(F.col("path"))).collect()}
    assert found == expected
    assert {path: rules.matches_text(path) for path in expected} == expected


def test_pruned_directories_stay_pruned(spark):
    rules = IgnoreRules.of(["vendor/", "!vendor/keep/", "*.tmp"])
    rows = spark.createDataFrame([("",), ("vendor",), ("vendor/keep",), ("src",), ("a/vendor/b",)],
                                 "dir string")
    found = {r[0]: r[1] for r in rows.select("dir", rules.prunes(F.col("dir"))).collect()}
    assert found == {
        "": False, "vendor": True, "vendor/keep": True, "src": False, "a/vendor/b": True
    }


def test_defaults(spark):
    rules = IgnoreRules.of(DEFAULT_IGNORE)
    for path in (".git/", "a/__pycache__/", "x.pyc", "p.egg-info/", "CONTEXT.md", "venv/"):
        assert rules.matches_text(path)
    assert not rules.matches_text("src/main.py")


def test_equal_neighbours_become_one_expression():
    assert len(IgnoreRules.of(DEFAULT_IGNORE).steps) == 1
    assert [v for _, v in IgnoreRules.of(["a", "b", "!c", "d"]).steps] == [True, False, True]
