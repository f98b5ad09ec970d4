"""Generations, runs that die, and what is removed."""

import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from test_runs import FILES, counts, table, texts

from treelens.operators import workspace
from treelens.operators.folders import entries
from treelens.operators.store import Store
from treelens.operators.workspace import new_folder, remove_old, scratch, written
from treelens.plans.runs import generate, preview, purge
from treelens.sources.corpus import TableCorpus, TreeCorpus


@pytest.fixture
def store(spark):
    return Store(new_folder(spark, "store"))


def names(spark, store):
    return {
        table: len(entries(spark, f"{store.path}/{table}"))
        for table in ("manifest", "documents", "commits", "generations")
    }


def dies(*_):
    raise RuntimeError("the driver is gone")


def test_compaction_folds_runs_and_removes_their_folders(spark, store, monkeypatch):
    generate(table(spark, FILES), store)
    generate(table(spark, FILES | {"pkg/b.py": "def b2(): ..."}), store)
    before = texts(spark, store)
    # A third run writes its documents and dies before its mark.
    with monkeypatch.context() as patch:
        patch.setattr(Store, "commit", dies)
        with pytest.raises(RuntimeError):
            generate(table(spark, FILES | {"pkg/b.py": "def b3(): ..."}), store)
    assert names(spark, store) == {"manifest": 2, "documents": 3, "commits": 2, "generations": 0}
    assert texts(spark, store) == before
    # Within the time of grace nothing goes.
    assert store.compact(spark, grace=3600) is not None
    assert names(spark, store) == {"manifest": 2, "documents": 3, "commits": 2, "generations": 1}
    assert texts(spark, store) == before
    assert store.compact(spark, grace=0) is None
    assert names(spark, store) == {"manifest": 0, "documents": 0, "commits": 0, "generations": 1}
    assert texts(spark, store) == before
    # The store goes on as before: nothing to write, then one change, then another generation.
    assert counts(generate(table(spark, FILES | {"pkg/b.py": "def b2(): ..."}), store)) == (0, 3, 0)
    assert counts(generate(table(spark, FILES), store)) == (1, 2, 0)
    purge(store, spark, "r", "pkg/deep")
    assert store.compact(spark, grace=0) is not None
    assert names(spark, store) == {"manifest": 0, "documents": 0, "commits": 0, "generations": 1}
    assert set(texts(spark, store)) == {"", "pkg"} and "`b` " not in texts(spark, store)["pkg"]
    assert counts(generate(table(spark, FILES), store)) == (1, 2, 0)


def test_a_compaction_that_dies_changes_nothing(spark, store, monkeypatch):
    generate(table(spark, FILES), store)
    before = texts(spark, store)
    for broken in ("treelens.operators.store.mark", "treelens.operators.store.current_manifest"):
        with monkeypatch.context() as patch:
            patch.setattr(broken, dies)
            with pytest.raises(RuntimeError):
                store.compact(spark, grace=0)
        assert texts(spark, store) == before
    # It may also die while it removes folders.
    with monkeypatch.context() as patch:
        patch.setattr("treelens.operators.store.remove", dies)
        with pytest.raises(RuntimeError):
            store.compact(spark, grace=0)
    assert texts(spark, store) == before
    store.tidy(spark, grace=0)
    assert texts(spark, store) == before
    assert names(spark, store) == {"manifest": 0, "documents": 0, "commits": 0, "generations": 1}


def test_of_two_compactions_at_once_no_run_is_lost(spark, store):
    """An older generation may cover a run that the newest one does not."""
    generate(table(spark, FILES), store)
    seen = store.state(spark)
    generate(table(spark, FILES | {"new/n.py": "x = 1"}), store)
    expected = texts(spark, store)
    assert store.compact(spark, grace=3600) is not None
    slow = Store(store.path)
    object.__setattr__(slow, "state", lambda spark: seen)
    assert slow.compact(spark, grace=0) is not None
    assert texts(spark, store) == expected


def test_rows_of_a_run_outlive_its_folder(spark, store):
    run = generate(table(spark, FILES), store)
    store.compact(spark, grace=0)
    assert {r.dir for r in store.written_by(spark, run.run_id).collect()} == {"", "pkg", "pkg/deep"}


def test_runs_remove_what_they_wrote_on_their_way(spark, store):
    base = f"{workspace.shared_folder(spark)}/treelens"
    before = set(entries(spark, base))
    run = generate(table(spark, FILES), store)
    assert counts(run) == (3, 0, 0) and run.rejects.count() == 0 and run.documents.count() == 3
    corpus = table(spark, FILES)
    for _ in range(2):
        assert counts(generate(corpus, store)) == (0, 3, 0)
    # What is left belongs to the corpora: which paths occur twice.
    left = set(entries(spark, base)) - before
    assert all(set(entries(spark, f"{base}/{name}")) <= {"repeated", "doubled", "store"} for name in left)
    dry = generate(table(spark, FILES), store, dry_run=True)
    assert dry.documents.count() == 3
    held = set(entries(spark, base))
    dry.discard()
    assert len(set(entries(spark, base))) < len(held)


def test_tables_of_a_failed_block_are_removed_and_old_ones_on_request(spark):
    base = f"{workspace.shared_folder(spark)}/treelens"
    before = set(entries(spark, base))
    with pytest.raises(KeyError):
        with scratch(spark):
            assert written(spark.range(3), "inside").count() == 3
            raise KeyError
    assert set(entries(spark, base)) == before
    written(spark.range(3), "outside")
    assert remove_old(spark, 3600) == 0
    assert len(set(entries(spark, base))) == len(before) + 1


class Counting(TableCorpus):
    """Counts how often a run asks for the bytes."""

    def __init__(self, files):
        super().__init__(files)
        object.__setattr__(self, "scans", [])

    def contents(self, *args):
        self.scans.append(args)
        return super().contents(*args)


def test_first_and_forced_runs_scan_the_corpus_once(spark, store):
    def scans(files, **how):
        corpus = Counting(table(spark, files).files)
        run = generate(corpus, store, **how)
        return len(corpus.scans), counts(run)

    assert scans(FILES) == (1, (3, 0, 0))
    assert scans(FILES) == (1, (0, 3, 0))
    assert scans(FILES | {"main.py": "y = 2"}) == (2, (1, 2, 0))
    assert scans(FILES, force=True) == (1, (3, 0, 0))
    files = written(table(spark, FILES).files, "files")
    plan = TableCorpus(files).records([])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_the_preview_of_a_table_reads_a_range_of_paths(spark, monkeypatch):
    rows = FILES | {"pkg2/x.py": "z", "pkg-a/x.py": "z", "pkg/deep/d/e.py": "z", "pkg.py": "z"}
    files = written(table(spark, rows).files, "files")
    plans = []
    real = workspace.written

    def seen(df, name, lasting=False):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name, lasting)

    monkeypatch.setattr("treelens.sources.corpus.written", seen)
    at = datetime(2024, 5, 6, tzinfo=timezone.utc)
    [row] = preview(TableCorpus(files), "r", "pkg", at=at).collect()
    [(_, plan)] = plans
    assert plan.count("FileScan") == 1
    # Long lists are cut off in the plan's text.
    assert "GreaterThanOrEqual(path,pkg/), LessThan(path," in plan
    assert "| `a.py`" in row.markdown and "deep/" in row.markdown and "pkg2" not in row.markdown
    assert "[`d/`]" not in row.markdown
    [top] = preview(TableCorpus(files), "r", "", at=at).collect()
    assert all(f"[`{name}/`]" in top.markdown for name in ("pkg", "pkg2", "pkg-a", "docs"))


def test_the_preview_of_a_tree_lists_one_directory(spark, tmp_path):
    for path, text in FILES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    corpus = TreeCorpus(spark, (str(tmp_path),))
    [row] = preview(corpus, str(tmp_path), "pkg").collect()
    assert "| `a.py`" in row.markdown and "[`deep/`]" in row.markdown and "c.py" not in row.markdown
    assert "entries" not in corpus.__dict__


def test_repeated_paths_count_once_and_are_rejected(spark, store):
    base = table(spark, FILES).files
    again = base.where("path = 'pkg/a.py'")
    other = again.withColumn("content", F.lit(b"import sys\n"))
    corpus = TableCorpus(base.unionByName(again).unionByName(other))
    run = generate(corpus, store)
    assert counts(run) == (3, 0, 0)
    assert [tuple(r) for r in run.rejects.collect()] == [("r", "pkg/a.py", "path occurs 3 times")]
    assert texts(spark, store)["pkg"].count("| `a.py`") == 1
    assert counts(generate(corpus, store)) == (0, 3, 0)
    assert corpus.hashes([]).where("path = 'pkg/a.py'").count() == 1


def test_purge_removes_files_and_counts(spark, store, tmp_path):
    from treelens.operators.sinks import export_documents

    generate(table(spark, FILES), store)
    export_documents(store.documents(spark), str(tmp_path)).collect()
    os.unlink(tmp_path / "r/pkg/deep/CONTEXT.md")
    os.makedirs(tmp_path / "r/pkg/deep/CONTEXT.md/not-a-file")
    gone = purge(store, spark, "r", "pkg", folder=str(tmp_path)).collect()
    assert {r.dir: r.error is None for r in gone} == {"pkg": True, "pkg/deep": False}
    assert set(texts(spark, store)) == {""} and (tmp_path / "r/CONTEXT.md").exists()
    assert not (tmp_path / "r/pkg/CONTEXT.md").exists()


def test_answers_that_were_paid_for_are_not_asked_again(spark, store, tmp_path):
    """A worker process dies after some of its answers; the repeated run asks for the rest only."""
    calls, journal = tmp_path / "calls", tmp_path / "journal"
    files = {f"d{n}/x.py": f"v = {n}" for n in range(24)}

    def factory(die_after):
        def make():
            made = []

            def answer(messages):
                made.append(1)
                if len(made) > die_after:
                    os._exit(9)
                with open(calls, "a") as log:
                    log.write(messages[-1]["content"].split("Directory: ")[1].split("\n")[0] + "\n")
                return '{"overview": "Paid."}'

            return answer

        return make

    how = {"journal": str(journal), "partitions": 2, "retry_delay": 0.0}
    with pytest.raises(Exception):
        generate(table(spark, files), store, summarizer=factory(5), **how)
    first = calls.read_text().split()
    assert 5 <= len(first) <= 10
    run = generate(table(spark, files), store, summarizer=factory(10**6), **how)
    assert counts(run) == (25, 0, 0)
    asked = calls.read_text().split()
    assert len(asked) == len(set(asked)) == 25
    assert all("Paid." in text for text in texts(spark, store).values())
    assert counts(generate(table(spark, files), store, summarizer=factory(0), force=True, **how)) == (25, 0, 0)
    # A line that was cut off in the middle is asked for again.
    [file] = [f for f in journal.rglob("*.jsonl")][:1]
    file.write_text(file.read_text()[:-9])
    generate(table(spark, files), store, summarizer=factory(10**6), force=True, **how)
    assert len(calls.read_text().split()) == 26
