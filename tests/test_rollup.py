import random

import brute
import pytest
from pyspark.sql import functions as F
from test_symbols import corpus

from treelens.functions.ignore import IgnoreRules
from treelens.operators.groups import Limits
from treelens.operators.listing import child_directories, directories_of, is_member, reached
from treelens.operators.render import render
from treelens.operators.rollup import directory_hashes, directory_records, with_roots
from treelens.operators.summaries import prompts, requests, summarize
from treelens.operators.symbols import file_records
from treelens.operators.workspace import written

STAMP = "2024-01-01T00:00:00Z"
SMALL = Limits(rows=7)


def hot_corpus(seed: int = 1) -> dict[str, str]:
    """One directory holds most files, and many children."""
    rng = random.Random(seed)
    files = {}
    for n in range(90):
        where = "hot/" if n % 3 else rng.choice(["", "a/", "a/b/", "c/"])
        body = [f'"""Doc {n}."""'] if n % 4 else []
        body += [f"import m{rng.randrange(40)}" for _ in range(rng.randrange(4))]
        body += [f"def f{rng.randrange(30)}(): ..." for _ in range(rng.randrange(3))]
        body += [f"class C{rng.randrange(30)}: ..." for _ in range(rng.randrange(2))]
        files[f"{where}x{rng.randrange(10**6)}.py"] = "\n".join(body)
    for n in range(30):
        files[f"hot/sub{n}/notes.txt"] = "text"
    return files


def made(spark, files, limits=Limits(), parts=5):
    everything = corpus(spark, files).repartition(parts)
    records = written(file_records(everything.where(is_member(IgnoreRules()))), "records")
    children = child_directories(directories_of(everything), IgnoreRules())
    return directory_records(records, children, everything.select("root").distinct(), limits)


def whole(documents):
    """Documents put together from their rows."""
    parts = {}
    for row in documents.orderBy("root", "dir", "section", "start").collect():
        parts.setdefault(row.dir, []).append(row.markdown)
    return {directory: "".join(texts) for directory, texts in parts.items()}


@pytest.mark.parametrize("limits", [Limits(), SMALL, Limits(rows=1)])
def test_hashes_match_brute_force(spark, limits):
    files = {p: t for p, t in hot_corpus().items() if p.endswith(".py")}
    rows = file_records(corpus(spark, files).repartition(6))
    found = {r.dir: r for r in directory_hashes(rows, limits).collect()}
    names = brute.directories(files)
    assert set(found) == set(names)
    for directory, members in names.items():
        row = found[directory]
        assert row.content_hash == brute.directory_hash(files, directory)
        assert row.file_count == len(members)
        prefix = f"{directory}/" if directory else ""
        assert row.total_size_bytes == sum(len(files[prefix + m].encode()) for m in members)


def test_hash_of_many_members_crosses_packed_rows(spark):
    files = {f"d/n{n:04}.py": f"x = {n}" for n in range(700)}
    rows = file_records(corpus(spark, files).repartition(3))
    for limits in (Limits(rows=650), Limits()):
        [row] = directory_hashes(rows, limits).collect()
        assert row.content_hash == brute.directory_hash(files, "d")


def test_roots_stay_and_middle_directories_do_not(spark):
    found = {r.dir: r for r in made(spark, {"a/b/x.py": "x"}).records.collect()}
    assert set(found) == {"", "a/b"}
    assert found[""].subdirectories == ["a"] and found[""].file_count == 0
    assert found[""].content_hash == brute.sha("")
    files = file_records(corpus(spark, {"a/x.py": "x"}))
    rows = directory_hashes(with_roots(files, files.select("root").distinct())).collect()
    assert {r.dir for r in rows} == {"", "a"}


def test_unions_keep_first_occurrence(spark):
    files = {"b.py": "import q, p\ndef g(): ...", "a.py": "import p, r\ndef f(): ...\ndef g(): ..."}
    [row] = made(spark, files).records.collect()
    assert [f.name for f in row.files] == ["a.py", "b.py"]
    assert row.all_functions == ["f", "g"] and row.all_imports == ["p", "r", "q"]


@pytest.mark.parametrize("how", ["extractive", "none"])
def test_large_directories_give_the_same_documents(spark, how):
    files = hot_corpus()
    gathered = whole(render(summarize(made(spark, files), how), STAMP))
    split = made(spark, files, SMALL)
    large = {r.dir for r in split.heads.collect()}
    assert "hot" in large and not large & {r.dir for r in split.records.collect()}
    documents = render(summarize(split, how), STAMP)
    assert documents.groupBy("dir").count().where("count > 13").count() > 0
    assert whole(documents) == gathered


def test_results_do_not_depend_on_partitioning(spark):
    files = hot_corpus(2)
    one = whole(render(summarize(made(spark, files, SMALL, parts=1)), STAMP))
    many = whole(render(summarize(made(spark, files, SMALL, parts=17)), STAMP))
    assert one == many


def test_too_many_large_directories_to_list(spark, monkeypatch):
    from treelens.operators import groups

    files = {f"d{n % 9}/m{n}.py": f"x = {n}" for n in range(60)}
    monkeypatch.setattr(groups, "MAX_LISTED", 2)
    rows = file_records(corpus(spark, files))
    found = {r.dir: r.content_hash for r in directory_hashes(rows, Limits(rows=6)).collect()}
    assert found == {f"d{n}": brute.directory_hash(files, f"d{n}") for n in range(9)}


def test_byte_limit_sets_directories_apart(spark):
    files = {"big/a.py": "x = '" + "y" * 500 + "'", "small/a.py": "x"}
    split = made(spark, files, Limits(bytes=100))
    assert [r.dir for r in split.heads.collect()] == ["big"]
    assert {r.dir for r in split.records.collect()} == {"", "small"}


def test_children(spark):
    listing = corpus(spark, {"a/x.py": "", "b/c/y.txt": "", "skip/z.py": "", "b/skip/q.py": ""})
    children = child_directories(directories_of(listing), IgnoreRules.of(["skip/"]))
    assert {(r.dir, r.name) for r in children.collect()} == {("", "a"), ("", "b"), ("b", "c")}


def test_scope_of_patterns(spark):
    listing = corpus(spark, {"x.py": "", "src/x.py": "", "src/y.py": ""})
    by_path = IgnoreRules.of(["src/x.py"])
    names = {r.path for r in listing.where(is_member(by_path) & reached(by_path)).collect()}
    # Members are judged by their bare names, so an anchored path does not hit them.
    assert names == {"x.py", "src/x.py", "src/y.py"}
    by_name = IgnoreRules.of(["/x.py"])
    names = {r.path for r in listing.where(is_member(by_name) & reached(by_name)).collect()}
    assert names == {"src/y.py"}


def test_prompt(spark):
    files = {"m.py": '"""  Hi. """\nimport a\n' + "\n".join(f"def f{n}(): ..." for n in range(20)),
             "sub/e.py": ""}
    sent = {r.dir: r for r in prompts(made(spark, files).records).collect()}
    text = sent[""].prompt
    assert "Directory: r\nSubdirectories: sub\n" in text
    assert "docstring: Hi.\n" in text and "f14" in text and "f15" not in text
    assert "classes: none" in text and "imports: a" in text
    assert "docstring: (no docstring)" in sent["sub"].prompt
    assert [m.role for m in sent[""].messages] == ["system", "user"]
    assert sent[""].messages[1].content == text
    empty = prompts(made(spark, {"a/b.txt": ""}).records).first()
    assert "(no source files in this directory)" in empty.prompt


def test_extractive_summary_takes_ten_symbols(spark):
    body = "\n".join(f"def f{n}(): ..." for n in range(8)) + "\n"
    body += "\n".join(f"class C{n}: ..." for n in range(8))
    for limits in (Limits(), Limits(bytes=1)):
        directories = summarize(made(spark, {"d/m.py": body}, limits))
        rows = [r for part in (directories.records, directories.heads) if part is not None
                for r in part.collect() if r.dir == "d"]
        assert rows[0].summary.key_symbols == [f"f{n}" for n in range(8)] + ["C0", "C1"]
        assert rows[0].summary.overview == "Directory 'd' holds 1 source file(s)."


def test_requests_do_not_depend_on_size(spark):
    files = hot_corpus()
    for request, value in (("messages", "prompt"), ("record", "record")):
        sent = [
            {(r.root, r.dir): r[value] for r in requests(made(spark, files, limits), request).collect()}
            for limits in (Limits(), SMALL)
        ]
        assert sent[0] == sent[1] and all(sent[0].values())
    expected = {(r.root, r.dir): r.record for r in prompts(made(spark, files).records).collect()}
    assert sent[1] == expected


def test_large_directories_are_asked(spark):
    def factory():
        return lambda messages: '{"overview": "seen"}'

    directories = summarize(made(spark, hot_corpus(), SMALL), factory, retry_delay=0.0)
    found = directories.rows("dir", "summary", "summary_status").collect()
    assert "hot" in {r.dir for r in directories.heads.collect()}
    assert all(r.summary.overview == "seen" and r.summary_status == "ok" for r in found)
    assert "seen" in whole(render(directories, STAMP))["hot"]


def test_queries_keep_large_directories(spark, monkeypatch):
    from treelens.plans import queries

    names = ["dir_rollup", "attach_summary", "prompt_text", "prompt_messages", "extractive_summary",
             "render_vars", "render_custom", "summarize_udf", "summarize_retry", "summarize_errors"]
    folder = "/root/testdata/sf0.001"

    def results():
        return {n: sorted(map(str, queries.QUERIES[n](spark, folder).collect())) for n in names}

    expected, plain = results(), queries._directories
    monkeypatch.setattr(queries, "_directories", lambda s, f: plain(s, f, Limits(rows=2)))
    assert results() == expected


def test_sections_of_custom_layout(spark):
    from treelens.functions.sections import Section, for_each

    def layout():
        rows = for_each("files", lambda f: F.concat(f["name"], F.lit("\n")))
        return [Section(F.concat("dir_name", F.lit("\n"))), Section(rows, over="files")]

    files = hot_corpus()
    texts = whole(render(summarize(made(spark, files, SMALL)), STAMP, layout))
    for directory, names in brute.directories(files).items():
        sources = [n for n in names if n.endswith(".py")]
        if sources:
            title = directory.rpartition("/")[2] or "r"
            assert texts[directory] == "\n".join([title, *sources, ""])


def test_unknown_name_in_layout(spark):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        render(summarize(made(spark, {"a.py": ""})), STAMP, lambda: F.col("nonsense")).collect()
