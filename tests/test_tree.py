import os

import brute
import pytest
from pyspark.sql import functions as F

from treelens.functions.ignore import IgnoreRules
from treelens.operators.workspace import written
from treelens.sources.corpus import TreeCorpus
from treelens.functions.text import content_hash, content_size
from treelens.sources import tree as source
from treelens.sources.tree import Patience, digest_file, list_trees, read_contents, read_hashes, read_records

FILES = {
    "__init__.py": b"", "top.py": b"import os\n", "_private/p.py": b"x = 1\n",
    ".git/hook.py": b"", "sub/a.py": b"a\r\nb", "sub/__init__.py": b"",
    "sub/deep/er/x.py": b"\xe9", "notes.txt": b"n", "only_text/t.txt": b"t",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    for path, content in FILES.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_bytes(content)
    (base / "empty").mkdir()
    os.symlink(base / "sub", base / "linked")
    os.symlink(base / "top.py", base / "alias.py")
    os.symlink(base / "missing", base / "dangling.py")
    return str(base)


def kinds(frame):
    found = {}
    for row in frame.collect():
        found.setdefault(row.kind, set()).add(row.path)
    return found


def test_everything_is_listed_once(spark, tree):
    frame = list_trees(spark, [tree])
    assert frame.count() == frame.distinct().count()
    found = kinds(frame)
    assert found["file"] == set(FILES) | {"alias.py"}
    assert found["dir"] == {
        "", "_private", ".git", "sub", "sub/deep", "sub/deep/er", "only_text", "empty"
    }
    assert found["linked_dir"] == {"linked"} and found["error"] == {"dangling.py"}


def test_listing_does_not_enter_ignored_or_deep(spark, tree):
    found = kinds(list_trees(spark, [tree], IgnoreRules.of([".git", "sub/deep/"])))
    assert ".git" in found["dir"] and ".git/hook.py" not in found["file"]
    assert "sub/deep" in found["dir"] and "sub/deep/er" not in found["dir"]
    for limit, deepest in ((0, "top.py"), (1, "sub/a.py")):
        found = kinds(list_trees(spark, [tree], max_depth=limit))
        assert deepest in found["file"]
        assert max(path.count("/") for path in found["file"]) == limit
        # Children beyond the limit are still named.
        assert max(path.count("/") for path in found["dir"]) == limit


def test_contents(spark, tree):
    files = written(list_trees(spark, [tree]).where("kind = 'file'"), "files")
    rows = {r.path: r for r in read_contents(files).collect()}
    assert {p: bytes(rows[p].content) for p in FILES} == FILES
    assert bytes(rows["alias.py"].content) == FILES["top.py"]
    limited = read_contents(files, max_file_bytes=5, partitions=3).collect()
    assert {r.path for r in limited if r.read_error} == {
        p for p, c in (FILES | {"alias.py": FILES["top.py"]}).items() if len(c) > 5
    }
    lost = files.limit(1).withColumn("path", F.lit("gone.py"))
    [row] = read_contents(lost).collect()
    assert row.content is None and "gone.py" in row.read_error


def test_missing_root_is_reported(spark, tree):
    [row] = list_trees(spark, [tree + "/nowhere"]).where("kind = 'error'").collect()
    assert row.path == "" and row.read_error


def test_several_roots(spark, tree):
    corpus = TreeCorpus(spark, (tree, tree + "/sub"))
    found = {(r.root, r.path) for r in corpus.listing.collect()}
    assert (tree + "/sub", "a.py") in found and (tree, "sub/a.py") in found
    assert {r.root for r in corpus.roots.collect()} == {tree, tree + "/sub"}
    names = brute.directories({p: "" for p in FILES})
    assert {r.dir for r in corpus.directories.where(F.col("root") == tree).collect()} >= set(names)


def test_undecodable_names_are_reported(spark, tmp_path):
    with open(os.path.join(os.fsencode(str(tmp_path)), b"bad\xff.py"), "wb"):
        pass
    (tmp_path / "good.py").write_text("")
    corpus = TreeCorpus(spark, (str(tmp_path),))
    assert [r.path for r in corpus.listing.collect()] == ["good.py"]
    [row] = corpus.rejects.collect()
    assert row.path == "bad\\udcff.py" and "UTF-8" in row.read_error


def walked(root):
    """Files and directories as os.walk sees them, relative to the root."""
    files, directories = set(), set()
    for at, below, names in os.walk(root):
        relative = os.path.relpath(at, root)
        prefix = "" if relative == "." else relative + "/"
        directories.add(prefix.rstrip("/"))
        files |= {prefix + name for name in names}
    return files, directories


@pytest.fixture(scope="module")
def narrow_top(tmp_path_factory):
    """Everything below a/b, and a chain of single directories."""
    base = tmp_path_factory.mktemp("narrow")
    for n in range(60):
        (base / "a" / "b" / f"d{n}" / "deep").mkdir(parents=True)
        for name in ("x.py", "deep/y.py"):
            (base / "a" / "b" / f"d{n}" / name).write_text(f"import m{n}\n")
    chain = base / "chain"
    for n in range(40):
        chain = chain / f"c{n}"
    chain.mkdir(parents=True)
    (chain / "end.py").write_text("")
    return str(base)


@pytest.mark.parametrize(
    "patience", [Patience(), Patience(directories=1), Patience(directories=7, found=2), Patience(entries=3)]
)
def test_a_listing_has_what_a_walk_sees(spark, narrow_top, patience):
    found = kinds(list_trees(spark, [narrow_top], patience=patience))
    files, directories = walked(narrow_top)
    assert found == {"file": files, "dir": directories}


def test_a_tree_that_branches_below_its_top_is_listed_by_many_tasks(spark, narrow_top, monkeypatch):
    monkeypatch.setattr(os, "scandir", lambda at: pytest.fail(f"the driver lists {at}"))
    entries = list_trees(spark, [narrow_top])
    monkeypatch.undo()
    below = entries.where("path like 'a/b/d%'").select("_metadata.file_path", "path")
    assert below.select("file_path").distinct().count() >= 8
    assert below.count() == 60 * 4


def test_a_directory_can_be_listed_alone(spark, narrow_top):
    found = kinds(list_trees(spark, [narrow_top], max_depth=2, below="a/b"))
    assert found == {"dir": {f"a/b/d{n}" for n in range(60)}}
    found = kinds(list_trees(spark, [narrow_top], max_depth=3, below="a/b/d7"))
    assert found == {"dir": {"a/b/d7/deep"}, "file": {"a/b/d7/x.py"}}


def test_hashes_and_records_of_trees_and_tables_agree(spark, tree):
    files = list_trees(spark, [tree]).where("kind = 'file'")
    contents = read_contents(files)
    by_table = contents.select(
        "path", content_size(F.col("content")).alias("size_bytes"), content_hash(F.col("content")).alias("content_hash")
    )
    expected = sorted(map(tuple, by_table.collect()))
    for read in (read_hashes, read_records):
        rows = read(files).select("path", "size_bytes", "content_hash").collect()
        assert sorted(map(tuple, rows)) == expected
    records = {r.path: r for r in read_records(files).collect()}
    assert records["top.py"].imports == ["os"] and records["sub/deep/er/x.py"].parse_error is None
    assert records["sub/a.py"].read_error is None


def test_a_file_is_hashed_in_constant_memory(spark, tmp_path):
    """A sparse file of 3 GiB, more than any value holds, next to a small one."""
    with open(tmp_path / "huge.py", "wb") as stream:
        stream.truncate(3 << 30)
    (tmp_path / "small.py").write_text("import os")
    files = list_trees(spark, [str(tmp_path)]).where("kind = 'file'")
    rows = {r.path: r for r in read_records(files).collect()}
    assert rows["huge.py"].size_bytes == 3 << 30 and rows["huge.py"].parse_error == source.TOO_LONG_TO_PARSE
    assert rows["huge.py"].read_error is None and rows["small.py"].imports == ["os"]
    [row] = read_contents(files.where("path = 'huge.py'")).collect()
    assert row.content is None and "larger than" in row.read_error


def test_a_digest_holds_one_chunk_at_a_time(tmp_path, monkeypatch):
    import tracemalloc

    content = bytes(range(256)) * (1 << 14)
    file = tmp_path / "file"
    file.write_bytes(content * 16)
    monkeypatch.setattr(source, "CHUNK_BYTES", 1 << 16)
    tracemalloc.start()
    size, digest, kept = digest_file(str(file), keep=1 << 20)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert size == len(content) * 16 and kept is None and peak < 4 << 20
    assert digest == __import__("hashlib").sha256(content * 16).hexdigest()
    assert digest_file(str(file), keep=size)[2] == content * 16


def test_bytes_are_dealt_out_by_size(spark, tmp_path):
    from treelens.operators.bundles import in_bundles

    sizes = [1 << (n % 12) for n in range(400)] + [3000] * 20
    rows = spark.createDataFrame([(n, size) for n, size in enumerate(sizes)], "n long, size long").repartition(7)
    dealt = in_bundles(rows, F.col("size"), 5000).withColumn("task", F.spark_partition_id())
    loads = [r.load for r in dealt.groupBy("task").agg(F.sum("size").alias("load")).collect()]
    assert sum(loads) == sum(sizes) and dealt.select("n").distinct().count() == len(sizes)
    assert max(loads) <= 5000 + max(sizes) and max(loads) <= 2 * sum(loads) / len(loads)
    few = in_bundles(rows, F.col("size"), 1 << 40, least=8).withColumn("task", F.spark_partition_id())
    loads = [r.load for r in few.groupBy("task").agg(F.sum("size").alias("load")).collect()]
    assert len(loads) >= 8 and max(loads) <= 2 * sum(loads) / len(loads)
    assert in_bundles(rows.limit(0), F.col("size"), 10).count() == 0
