import pytest
from pyspark.sql import functions as F

from treelens.functions import paths
from treelens.operators.listing import directories_of, sorted_listing, with_path_parts


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "path string").select(column).first()[0]


@pytest.mark.parametrize(
    "path, directory, name, depth",
    [("a.py", "", "a.py", 0), ("x/a.py", "x", "a.py", 1), ("x/y/é.py", "x/y", "é.py", 2)],
)
def test_parts(spark, path, directory, name, depth):
    row = with_path_parts(spark.createDataFrame([(path,)], "path string")).first()
    assert (row.dir, row.name, row.depth) == (directory, name, depth)


@pytest.mark.parametrize(
    "name, expected",
    [
        ("a.py", True), ("a.PY", True), ("a.Py", True), ("..py", True), ("a.b.py", True),
        (".py", False), ("a.txt", False), ("a.pyc", False), ("Makefile", False), ("a.js", False),
        ("a.py\n", False),
    ],
)
def test_suffix(spark, name, expected):
    assert one(spark, name, paths.has_suffix(F.col("path"))) is expected


def test_prefixes(spark):
    assert one(spark, "", paths.prefixes(F.col("path"))) == []
    assert one(spark, "a/b/c", paths.prefixes(F.col("path"))) == ["a", "a/b", "a/b/c"]


def test_depth_limit(spark):
    rows = spark.createDataFrame([("",), ("sub",), ("sub/deep",)], "dir string")

    def kept(limit):
        return rows.where(paths.within_depth(F.col("dir"), limit)).count()

    assert [kept(0), kept(1), kept(2), kept(None)] == [1, 2, 3, 3]


def test_display(spark):
    rows = spark.createDataFrame([("/r/proj", ""), ("/r/proj", "a/b")], "root string, dir string")
    shown = rows.select(
        paths.display_path(F.col("root"), F.col("dir")),
        paths.display_name(F.col("root"), F.col("dir")),
    ).collect()
    assert [tuple(r) for r in shown] == [("/r/proj", "proj"), ("/r/proj/a/b", "b")]


def test_directories_include_ancestors_and_root(spark):
    files = spark.createDataFrame([("r", "a/b/c.py"), ("r", "a/d.py"), ("q", "x.py")],
                                  "root string, path string")
    found = {tuple(r) for r in directories_of(with_path_parts(files)).collect()}
    assert found == {("r", ""), ("r", "a"), ("r", "a/b"), ("q", "")}


def test_sorted_listing_compares_components(spark):
    names = ["a.py", "a/b.py", "a-b/c.py", "a/b/c.py", "a", "Z.py", "é.py", "a/.x"]
    rows = [(root, name) for root in ("r", "q") for name in names]
    files = spark.createDataFrame(rows, "root string, path string").repartition(5)
    listed = sorted_listing(files, 4).orderBy("position").collect()
    expected = sorted(rows, key=lambda r: (r[0], [p.encode() for p in r[1].split("/")]))
    assert [(r.root, r.path) for r in listed] == expected
    assert [r.position for r in listed] == list(range(1, len(rows) + 1))
