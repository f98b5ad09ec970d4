import os
from datetime import datetime, timezone

import brute
import pytest
from test_symbols import corpus

from treelens.functions.text import stored_hash
from treelens.operators.groups import Limits
from treelens.operators.sinks import export_documents, remove_exported
from treelens.operators.store import Store
from treelens.operators.workspace import new_folder
from treelens.plans.runs import adopt, generate, preview, purge
from treelens.sources.corpus import TableCorpus, TreeCorpus
from pyspark.sql import functions as F

FILES = {
    "main.py": '"""Main."""\nimport os\ndef run(): ...\n',
    "pkg/a.py": "import os, re\nclass A: ...\n",
    "pkg/b.py": "def b(): ...\n",
    "pkg/deep/c.py": "x = 1\n",
    "docs/readme.txt": "text",
    "build/out.py": "x",
}


def table(spark, files):
    return TableCorpus(corpus(spark, files).select("root", "path", "content"))


def counts(run):
    return tuple(run.counts.first())


@pytest.fixture
def store(spark):
    return Store(new_folder(spark, "store"))


def texts(spark, store):
    rows = store.documents(spark).orderBy("root", "dir", "section", "start").collect()
    found = {}
    for row in rows:
        found[row.dir] = found.get(row.dir, "") + row.markdown
    return found


def test_only_changed_directories_are_written(spark, store):
    assert counts(generate(table(spark, FILES), store)) == (3, 0, 0)
    first = texts(spark, store)
    assert set(first) == {"", "pkg", "pkg/deep"}
    assert counts(generate(table(spark, FILES), store)) == (0, 3, 0)
    edited = FILES | {"pkg/b.py": "def b2(): ...\n", "new/n.py": ""}
    run = generate(table(spark, edited), store)
    assert counts(run) == (2, 2, 0)
    assert {r.dir for r in run.documents.collect()} == {"pkg", "new"}
    second = texts(spark, store)
    assert set(second) == {"", "pkg", "pkg/deep", "new"}
    assert second["pkg"] != first["pkg"] and second[""] == first[""]
    assert counts(generate(table(spark, edited), store, force=True)) == (4, 0, 0)


def test_document_says_what_was_found(spark, store):
    generate(table(spark, FILES), store, at=datetime(2024, 5, 6, tzinfo=timezone.utc))
    text = texts(spark, store)["pkg"]
    digest = brute.directory_hash(FILES, "pkg")
    assert text.startswith(f"<!-- content-hash: {digest} -->\n# Context: pkg\n")
    assert "2024-05-06T00:00:00Z" in text and "Directory: `r/pkg`" in text
    sizes = [len(FILES[f"pkg/{name}"]) for name in ("a.py", "b.py")]
    assert "| `a.py` | %d B | — | A |\n| `b.py` | %d B | b | — |\n" % tuple(sizes) in text
    assert "- `os`\n- `re`\n" in text and "- [`deep/`](deep/CONTEXT.md)\n" in text
    assert "- `b`\n- `A`\n" in text
    row = store.documents(spark).where("dir = 'pkg'").select(stored_hash(F.col("markdown"))).first()
    assert row[0] == digest
    assert "build" not in texts(spark, store)[""]


def test_large_limits_and_small_limits_agree(spark, store):
    at = datetime(2024, 5, 6, tzinfo=timezone.utc)
    other = Store(new_folder(spark, "store"))
    generate(table(spark, FILES), store, at=at)
    assert counts(generate(table(spark, FILES), other, at=at, limits=Limits(rows=1))) == (3, 0, 0)
    assert texts(spark, store) == texts(spark, other)
    assert other.documents(spark).count() > 3
    assert counts(generate(table(spark, FILES), other, limits=Limits(rows=1))) == (0, 3, 0)


def test_dry_run_stores_nothing(spark, store):
    generate(table(spark, FILES), store)
    run = generate(table(spark, FILES), store, dry_run=True)
    assert counts(run) == (0, 3, 0)
    assert all(len(r.markdown) <= 820 for r in run.documents.collect())
    assert store.manifest(spark).count() == 3


def test_depth_and_empty_root(spark, store):
    files = {k: v for k, v in FILES.items() if k != "main.py"}
    assert counts(generate(table(spark, files), store, max_depth=1)) == (2, 0, 0)
    found = texts(spark, store)
    assert set(found) == {"", "pkg"} and "*No source files" in found[""]
    assert "deep/" in found["pkg"]


def test_failed_summaries(spark, store):
    def failing():
        def answer(messages):
            if "r/pkg\n" in messages[-1]["content"]:
                raise ValueError("no")
            return '{"overview": "Fine."}'

        return answer

    def working():
        return lambda messages: '{"overview": "Now."}'

    run = generate(table(spark, FILES), store, summarizer=failing, retry_delay=0.0)
    assert counts(run) == (3, 0, 1)
    found = texts(spark, store)
    assert "Fine." in found[""] and "*No summary available" in found["pkg"]
    assert counts(generate(table(spark, FILES), store, summarizer=working)) == (0, 3, 0)
    run = generate(table(spark, FILES), store, summarizer=working, retry_failed=True)
    assert counts(run) == (1, 2, 0)
    assert "Now." in texts(spark, store)["pkg"]


def test_purge_and_again(spark, store):
    generate(table(spark, FILES), store)
    assert [r.dir for r in purge(store, spark, "r", "pkg").collect()] == ["pkg", "pkg/deep"]
    assert set(texts(spark, store)) == {""}
    assert counts(generate(table(spark, FILES), store)) == (2, 1, 0)
    assert purge(store, spark).count() == 3
    assert texts(spark, store) == {}


def test_preview(spark):
    at = datetime(2024, 5, 6, tzinfo=timezone.utc)
    [row] = preview(table(spark, FILES), "r", "pkg", at=at).collect()
    assert "| `a.py`" in row.markdown and "c.py" not in row.markdown
    assert "Directory 'pkg' holds 2" in row.markdown
    [row] = preview(table(spark, FILES), "r", "docs", summarizer="none", at=at).collect()
    assert "*No source files" in row.markdown and "*No summary" in row.markdown


def test_tree_to_files_and_incremental(spark, store, tmp_path):
    for path, text in FILES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "huge.py").write_text("#" * 5000)
    root = str(tmp_path)

    def scan():
        return TreeCorpus(spark, (root,), max_file_bytes=4000)

    run = generate(scan(), store)
    assert counts(run) == (3, 0, 0)
    assert [r.path for r in run.rejects.collect()] == ["huge.py"]
    target = tmp_path / "out"
    exported = export_documents(store.documents(spark), str(target)).collect()
    assert {r.path for r in exported} == {"CONTEXT.md", "pkg/CONTEXT.md", "pkg/deep/CONTEXT.md"}
    written_text = (target / root.strip("/") / "pkg" / "CONTEXT.md").read_text()
    assert written_text == texts(spark, store)["pkg"]
    spread = Store(new_folder(spark, "store"))
    export_documents(store.documents(spark), "/").collect()
    assert (tmp_path / "pkg" / "CONTEXT.md").read_text() == texts(spark, store)["pkg"]
    # Documents next to the sources count for a new store, once it has taken them over.
    assert {r.dir for r in adopt(scan(), spread).collect()} >= {"", "pkg", "pkg/deep"}
    assert counts(generate(scan(), spread, ignore=["out", "build"])) == (0, 3, 0)
    gone = remove_exported(purge(spread, spark, root), "/").collect()
    # The copies below `out` are documents under this root as well.
    assert len(gone) == 6 and all(r.error is None for r in gone)
    assert not list(tmp_path.rglob("CONTEXT.md")) and not (tmp_path / "pkg" / "CONTEXT.md").exists()
    assert not [f for f in os.listdir(target / root.strip("/")) if f.endswith(".part")]
    target_free = scan()
    assert counts(generate(target_free, store, ignore=["out", "build"])) == (0, 3, 0)
    (tmp_path / "pkg" / "b.py").write_text("def other(): ...\n")
    run = generate(scan(), store, ignore=["out", "build"])
    assert counts(run) == (1, 2, 0) and [r.dir for r in run.documents.collect()] == ["pkg"]


def test_export_reports_errors(spark, store, tmp_path):
    generate(table(spark, FILES), store)
    (tmp_path / "r").write_text("a file where a directory should be")
    rows = export_documents(store.documents(spark), str(tmp_path)).collect()
    assert len(rows) == 3 and all(r.error and r.bytes is None for r in rows)
