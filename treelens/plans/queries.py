"""One query per operator, over the whole test tables.

Arrays are shown as joined text, so that results compare by value.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from datetime import datetime, timezone
from glob import glob

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.functions.ignore import IgnoreRules
from treelens.functions.paths import dir_of, has_suffix, within_depth
from treelens.functions.responses import validate_answers
from treelens.functions.sections import Section, for_each
from treelens.functions.text import (
    content_hash,
    content_size,
    decode_source,
    hash_line,
    stored_hash,
)
from treelens.operators.changes import (
    change_status,
    current_manifest,
    manifest_of_documents,
    purge_listing,
    run_summary,
    with_documents,
)
from treelens.operators.groups import Limits
from treelens.operators.listing import (
    child_directories,
    directories_of,
    in_walk,
    is_member,
    sorted_listing as sort_listing,
    with_path_parts,
)
from treelens.operators.pieces import text_digests, whole_texts
from treelens.operators.records import (
    as_json,
    directory_flags,
    file_flags,
    file_from_json,
    file_struct,
)
from treelens.operators.render import render, render_variables, shortened
from treelens.operators.rollup import Directories, directory_hashes, directory_records, with_roots
from treelens.operators.sinks import export_documents as write_documents, export_files
from treelens.operators.store import Store
from treelens.operators.summaries import (
    ask,
    attach_summaries,
    extractive_summary as summarize_natively,
    requests,
    summaries_from,
    summarize,
)
from treelens.operators.symbols import file_records as parse_files
from treelens.operators.symbols import import_edges as edges_of
from treelens.operators.symbols import import_rows as imports_of
from treelens.operators.symbols import ordered_union as union_of
from treelens.operators.symbols import parse_failures as failures_of
from treelens.operators.symbols import symbols
from treelens.operators.workspace import new_folder, written
from treelens.plans import runs, views
from treelens.sources.corpus import TableCorpus
from treelens.sources.tree import list_trees, read_contents, read_hashes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# In no name of a file or symbol.
LIST_END = "\x00"
STAMP = "2024-01-01T00:00:00Z"
PAGE_PATTERNS = ["*.html", "blog.*/es/", "/www.*/de", "**/fr/6*", "!m.*/**/1?", "spam-*"]
PRUNE_PATTERNS = ["blog.*/", "fr/", "!blog.*/fr/7*", "/m.*/e[ns]/", "!/m.*/en/", "*.html"]
NAME_PATTERNS = ["*5.html", "7*", "!77*", "en/1*", "[!0-8]?", "/3*"]


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def _text(items: Column | str) -> Column:
    return F.array_join(items, ",")


def _list(name: str) -> Section:
    """The items of a list of directories, each with a comma."""
    return Section(for_each(name, lambda item: F.concat(item, F.lit(","))), over=name)


def _lists(names: list[str]) -> list[Column]:
    """Lists out of a text in which `LIST_END` parts them."""
    parts = F.split("text", LIST_END)
    return [
        F.regexp_replace(parts[at], ",$", "").alias(name) for at, name in enumerate(names)
    ]


def _paths(corpus: DataFrame) -> DataFrame:
    return with_path_parts(corpus.select("root", "path"))


def _code_records(spark: SparkSession, folder: str) -> DataFrame:
    return parse_files(with_path_parts(views.code(spark, folder)))


def _hashed(corpus: DataFrame) -> DataFrame:
    return with_path_parts(corpus).select(
        "root", "path", "dir", "name",
        content_size(F.col("content")).alias("size_bytes"),
        content_hash(F.col("content")).alias("content_hash"),
    )


def _all_corpora(spark: SparkSession, folder: str) -> DataFrame:
    made = [view(spark, folder) for view in (views.docs, views.pages, views.code)]
    return made[0].unionByName(made[1]).unionByName(made[2])


def _directories(
    spark: SparkSession, folder: str, limits: Limits = Limits()
) -> Directories:
    """Directory records of the code corpus."""
    listing = _paths(views.code(spark, folder))
    return directory_records(
        _code_records(spark, folder),
        child_directories(directories_of(listing), IgnoreRules()),
        listing.select("root").distinct(),
        limits,
        sizes=listing.withColumn("size_bytes", F.lit(0)),
    )


def _manifest(hashes: DataFrame) -> DataFrame:
    """Two earlier runs: everything, then most of it, some altered and some removed."""
    size = F.col("total_size_bytes")
    older = hashes.select(
        "root", "dir", F.lit("old").alias("content_hash"),
        F.lit(datetime(2024, 1, 1)).alias("generated_at"), F.lit(False).alias("deleted"),
        F.lit("ok").alias("summary_status"), F.lit("3").alias("python_version"), F.lit("r1").alias("run_id"),
    )
    newer = hashes.where(size % 11 != 0).select(
        "root", "dir",
        F.when(size % 7 == 0, F.reverse("content_hash")).otherwise(F.col("content_hash"))
        .alias("content_hash"),
        F.lit(datetime(2024, 1, 2)).alias("generated_at"), (size % 5 == 0).alias("deleted"),
        F.when(size % 3 == 0, "failed").otherwise("ok").alias("summary_status"),
        F.lit("3").alias("python_version"), F.lit("r2").alias("run_id"),
    )
    return older.unionByName(newer)


def _summaries(directories: Directories) -> DataFrame:
    """Summaries for some directories only."""
    made = directories.each(lambda d: summarize_natively(d.where(F.col("file_count") % 2 == 0)))
    return made.rows("root", "dir", "summary").select(
        "*", F.lit("ok").alias("summary_status"), F.lit(None).cast("string").alias("error")
    )


# Sources and scans


@query("corpus_from_table")
def corpus_from_table(spark: SparkSession, folder: str) -> DataFrame:
    corpus = views.docs(spark, folder)
    return corpus.select("root", "path", content_size(F.col("content")).alias("size_bytes"))


def _exported_code(spark: SparkSession, folder: str) -> str:
    """Write the code corpus as files and return the folder."""
    target = new_folder(spark, "tree")
    texts = views.code(spark, folder).select(
        "root", "path", F.lit(0).alias("section"), F.lit("").alias("start"),
        F.col("content").alias("markdown"),
    )
    written(export_files(texts, target), "exported")
    return target.removeprefix("file:")


@query("scan_tree")
def scan_tree(spark: SparkSession, folder: str) -> DataFrame:
    root = f"{_exported_code(spark, folder)}/code"
    entries = list_trees(spark, [root])
    read = read_hashes(entries.where(F.col("kind") == "file"))
    return read.select("path", F.col("size_bytes").alias("length"), "content_hash")


@query("scan_rejects")
def scan_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Files over the size limit of the scan are reported, not read."""
    root = f"{_exported_code(spark, folder)}/code"
    entries = list_trees(spark, [root])
    contents = read_contents(entries.where(F.col("kind") == "file"), max_file_bytes=130)
    return contents.where(F.col("read_error").isNotNull()).select("path", "length", "read_error")


@query("scan_unreadable")
def scan_unreadable(spark: SparkSession, folder: str) -> DataFrame:
    """Files that went between listing and reading are reported, the others are hashed."""
    target = _exported_code(spark, folder)
    root = f"{target}/code"
    listed = list_trees(spark, [root]).where(F.col("kind") == "file")
    for gone in glob(f"{root}/brand_7/*/p_*1.py"):
        os.unlink(gone)
    error = F.regexp_replace("read_error", ": .*", "")
    return read_hashes(listed).select("path", "size_bytes", "content_hash", error.alias("read_error"))


@query("stored_hash_parse")
def stored_hash_parse(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.table(spark, folder, "documents").select("doc_id", "text")
    digest = F.sha2("text", 256)
    kind = F.col("doc_id") % 5
    first = (
        F.when(kind == 0, hash_line(digest))
        .when(kind == 1, F.concat(F.lit("  <!--  content-hash:"), digest, F.lit("-->  \r")))
        .when(kind == 2, hash_line(F.left(digest, F.lit(63))))
        .when(kind == 3, hash_line(digest, "other-hash"))
        .otherwise(F.lit(""))
    )
    document = F.concat(first, F.lit("\n"), "text")
    return rows.select("doc_id", stored_hash(document).alias("stored_hash"))


@query("manifest_import")
def manifest_import(spark: SparkSession, folder: str) -> DataFrame:
    """Earlier documents, known by the hash in their first line."""
    rows = views.table(spark, folder, "documents").select("doc_id", "source", "text")
    first = F.when(F.col("doc_id") % 3 == 0, hash_line(F.sha2("text", 256))).otherwise("# none")
    files = rows.select(
        F.lit("docs").alias("root"),
        F.concat_ws("/", "source", "doc_id").alias("dir"),
        F.encode(F.concat(first, F.lit("\n"), "text"), "UTF-8").alias("content"),
    )
    imported = manifest_of_documents(files, "r0", datetime(2024, 1, 1))
    return imported.select("root", "dir", "content_hash", "summary_status")


# Filters


@query("suffix_filter")
def suffix_filter(spark: SparkSession, folder: str) -> DataFrame:
    paths = _paths(views.pages(spark, folder))
    spelled = F.when(F.length("path") % 2 == 0, F.upper("name")).otherwise(F.col("name"))
    return paths.select("path", spelled.alias("name")).where(has_suffix(F.col("name"), ".html"))


@query("ignore_filter")
def ignore_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = IgnoreRules.of(PAGE_PATTERNS)
    paths = _paths(views.pages(spark, folder))
    return paths.select("path", rules.matches(F.col("path")).alias("ignored"))


@query("ignore_prune")
def ignore_prune(spark: SparkSession, folder: str) -> DataFrame:
    rules = IgnoreRules.of(PRUNE_PATTERNS)
    paths = _paths(views.pages(spark, folder))
    return paths.select(
        "path",
        rules.prunes(F.col("dir")).alias("pruned"),
        in_walk(rules, None, "").alias("walked"),
    )


@query("depth_filter")
def depth_filter(spark: SparkSession, folder: str) -> DataFrame:
    flat = F.when(F.length("path") % 3 == 0, F.replace("path", F.lit("/"), F.lit("-")))
    paths = views.pages(spark, folder).select("root", F.coalesce(flat, "path").alias("path"))
    return with_path_parts(paths).where(within_depth(F.col("dir"), 1)).select("path", "depth")


@query("ignore_by_name")
def ignore_by_name(spark: SparkSession, folder: str) -> DataFrame:
    rules = IgnoreRules.of(NAME_PATTERNS)
    paths = _paths(views.pages(spark, folder))
    return paths.where(is_member(rules, "")).select("path")


@query("record_flags")
def record_flags(spark: SparkSession, folder: str) -> DataFrame:
    return file_flags(_code_records(spark, folder)).select("path", "symbol_count", "is_empty")


@query("preview_one")
def preview_one(spark: SparkSession, folder: str) -> DataFrame:
    corpus = TableCorpus(views.code(spark, folder))
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    document = runs.preview(corpus, "code", "brand_7/small", ignore=(), at=at)
    return document.select("root", "dir", "markdown")


# Projections


@query("content_hash")
def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return _hashed(views.docs(spark, folder)).select("path", "size_bytes", "content_hash")


@query("decode_text")
def decode_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.table(spark, folder, "documents").select("doc_id", "text")
    kind = F.col("doc_id") % 4
    content = (
        F.when(kind == 0, F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n")), "UTF-8"))
        .when(kind == 1, F.encode(F.replace("text", F.lit("\n"), F.lit("\r")), "UTF-8"))
        .when(kind == 2, F.encode("text", "UTF-8"))
        .otherwise(F.encode(F.regexp_replace("text", "[^\\x00-\\xff]", "?"), "ISO-8859-1"))
    )
    text = decode_source(content)
    return rows.select(
        "doc_id", F.char_length(text).alias("characters"), F.sha2(text, 256).alias("text_hash")
    )


@query("path_parts")
def path_parts(spark: SparkSession, folder: str) -> DataFrame:
    paths = _paths(_all_corpora(spark, folder))
    return paths.select("root", "path", "dir", "name", "depth")


@query("json_roundtrip")
def json_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    records = _code_records(spark, folder)
    sent = records.select("path", as_json(file_struct()).alias("json"))
    back = file_from_json(F.col("json"))
    return sent.select("path", "json", back.alias("back")).select(
        "path",
        "json",
        F.col("back.relative_path").alias("name"),
        F.col("back.size_bytes").alias("size_bytes"),
        F.col("back.module_docstring").alias("module_docstring"),
        _text(F.col("back.imports")).alias("imports"),
    )


# Symbols


@query("extract_docstring")
def extract_docstring(spark: SparkSession, folder: str) -> DataFrame:
    return _code_records(spark, folder).select("path", "module_docstring")


def _symbols_of(kind: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = symbols(_code_records(spark, folder)).where(F.col("kind") == kind)
        return found.select("path", "symbol", "ordinal")

    return run


QUERIES["extract_functions"] = _symbols_of("function")
QUERIES["extract_classes"] = _symbols_of("class")
QUERIES["extract_imports"] = _symbols_of("import")


@query("parse_failures")
def parse_failures(spark: SparkSession, folder: str) -> DataFrame:
    return failures_of(_code_records(spark, folder))


@query("file_records")
def file_records(spark: SparkSession, folder: str) -> DataFrame:
    return _code_records(spark, folder).select(
        "root", "path", "name", "size_bytes", "content_hash", "module_docstring",
        _text("functions").alias("functions"), _text("classes").alias("classes"),
        _text("imports").alias("imports"), "parse_error",
    )


@query("import_edges")
def import_edges(spark: SparkSession, folder: str) -> DataFrame:
    return edges_of(_code_records(spark, folder))


@query("import_rows")
def import_rows(spark: SparkSession, folder: str) -> DataFrame:
    return imports_of(_code_records(spark, folder))


# Aggregations


@query("dir_rollup")
def dir_rollup(spark: SparkSession, folder: str) -> DataFrame:
    members = Section(for_each("files", lambda f: F.concat(f["name"], F.lit(","))), over="files")
    totals = ["file_count", "total_size_bytes", "content_hash"]
    texts = whole_texts(
        _directories(spark, folder), [members, Section(F.lit(LIST_END)), _list("subdirectories")], totals
    )
    lists = _lists(["members", "subdirectories"])
    return texts.select("root", "dir", *totals, *lists)


@query("tree_rollup")
def tree_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Directories of all corpora, roots without files included."""
    hashed = _hashed(_all_corpora(spark, folder))
    listing = _paths(_all_corpora(spark, folder))
    return directory_hashes(with_roots(hashed, listing.select("root").distinct()))


@query("ordered_union")
def ordered_union(spark: SparkSession, folder: str) -> DataFrame:
    return union_of(symbols(_code_records(spark, folder)))


@query("dir_hash")
def dir_hash(spark: SparkSession, folder: str) -> DataFrame:
    return directory_hashes(_hashed(views.docs(spark, folder))).select(
        "root", "dir", "content_hash"
    )


@query("dir_hash_large")
def dir_hash_large(spark: SparkSession, folder: str) -> DataFrame:
    """The same hashes when almost every directory is beyond the limits."""
    hashed = _hashed(views.docs(spark, folder))
    return directory_hashes(hashed, Limits(rows=3)).select("root", "dir", "content_hash")


@query("subdirectories")
def subdirectories(spark: SparkSession, folder: str) -> DataFrame:
    listing = _paths(_all_corpora(spark, folder))
    return child_directories(directories_of(listing), IgnoreRules.of(["blog.*", "fr/", "src1?"]))


@query("subdirectory_documents")
def subdirectory_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Which of the child directories have a document that a link to them finds."""
    hashes = written(directory_hashes(_hashed(_all_corpora(spark, folder))), "hashes")
    listing = _paths(_all_corpora(spark, folder))
    children = child_directories(directories_of(listing), IgnoreRules.of(["blog.*", "fr/", "src1?"]))
    return with_documents(children, current_manifest(_manifest(hashes)))


@query("run_summary")
def run_counts(spark: SparkSession, folder: str) -> DataFrame:
    hashes = written(directory_hashes(_hashed(_all_corpora(spark, folder))), "hashes")
    status = change_status(hashes, current_manifest(_manifest(hashes)))
    errors = F.when(F.col("changed") & (F.col("total_size_bytes") % 3 == 0), 1).otherwise(0)
    return run_summary(status.withColumn("errors", errors))


# Joins


def _changed(force: bool = False, retry_failed: bool = False) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        hashes = written(directory_hashes(_hashed(_all_corpora(spark, folder))), "hashes")
        current = current_manifest(_manifest(hashes))
        status = change_status(hashes, current, force, retry_failed)
        return status.select("root", "dir", "content_hash", "changed")

    return run


QUERIES["changed_dirs"] = _changed()
QUERIES["changed_dirs_force"] = _changed(force=True)
QUERIES["changed_dirs_retry"] = _changed(retry_failed=True)


@query("attach_summary")
def attach_summary(spark: SparkSession, folder: str) -> DataFrame:
    directories = _directories(spark, folder)
    summaries = written(_summaries(directories), "summaries")
    joined = directories.each(lambda d: directory_flags(attach_summaries(d, summaries)))
    return joined.rows("root", "dir", "summary", "summary_status", "is_empty", "has_content").select(
        "root", "dir", F.col("summary.overview").alias("overview"),
        _text(F.col("summary.key_symbols")).alias("key_symbols"),
        "summary_status", "is_empty", "has_content",
    )


# Sorting and shortening


@query("sorted_listing")
def sorted_listing(spark: SparkSession, folder: str) -> DataFrame:
    return sort_listing(_all_corpora(spark, folder))


@query("preview_truncated")
def preview_truncated(spark: SparkSession, folder: str) -> DataFrame:
    documents = _documents(spark, folder)
    return documents.select("root", "dir", shortened(F.col("markdown")).alias("markdown"))


# Prompts, answers, documents


@query("prompt_text")
def prompt_text(spark: SparkSession, folder: str) -> DataFrame:
    return requests(_directories(spark, folder)).select("root", "dir", "prompt")


@query("prompt_messages")
def prompt_messages(spark: SparkSession, folder: str) -> DataFrame:
    sent = requests(_directories(spark, folder))
    return sent.select("root", "dir", F.posexplode("messages").alias("position", "m")).select(
        "root", "dir", "position", "m.role", "m.content"
    )


@query("summary_parse")
def summary_parse(spark: SparkSession, folder: str) -> DataFrame:
    checked = validate_answers(views.answers(spark, folder))
    summary = F.col("summary")
    return checked.select(
        "event_id", "parse_status", summary["overview"].alias("overview"),
        _text(summary["key_symbols"]).alias("key_symbols"),
        _text(summary["patterns"]).alias("patterns"),
        _text(summary["tribal_knowledge"]).alias("tribal_knowledge"),
    )


@query("extractive_summary")
def extractive_summary(spark: SparkSession, folder: str) -> DataFrame:
    directories = _directories(spark, folder)
    summarized = directories.each(lambda d: summarize_natively(d, "[auto] "))
    return summarized.rows("root", "dir", "summary").select(
        "root", "dir", F.col("summary.overview").alias("overview"),
        _text(F.col("summary.key_symbols")).alias("key_symbols"),
    )


def _documents(spark: SparkSession, folder: str, how: str = "extractive") -> DataFrame:
    return render(summarize(_directories(spark, folder), how), STAMP)


@query("render_vars")
def render_vars(spark: SparkSession, folder: str) -> DataFrame:
    directories = summarize(_directories(spark, folder), "extractive")
    shown = directories.each(
        lambda d: render_variables(d, STAMP).withColumns(
            {c: _text(c) for c in ("key_symbols", "patterns", "tribal_knowledge")}
        )
    )
    carry = [
        "path", "dir_name", "content_hash", "file_count", "overview", "has_summary", "generated_at",
        "hash_line", "key_symbols", "patterns", "tribal_knowledge",
    ]
    lists = ["subdirectories", "all_functions", "all_classes", "all_imports"]
    sections = [part for name in lists for part in (_list(name), Section(F.lit(LIST_END)))]
    return whole_texts(shown, sections, carry).select(*carry, *_lists(lists))


@query("render_document")
def render_document(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("root", "dir", "content_hash", "markdown")


@query("render_large")
def render_large(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents, by their hash, when many are beyond the limits and come in several rows."""
    directories = summarize(_directories(spark, folder, Limits(rows=16)), "extractive")
    return text_digests(render(directories, STAMP))


@query("render_no_summary")
def render_no_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder, "none").select("root", "dir", "content_hash", "markdown")


def _short_layout() -> list[Section]:
    title = F.concat(F.lit("= "), F.col("dir_name"), F.lit(" =\n"))
    row = for_each("files", lambda f: F.concat(F.lit("* "), f["name"], F.lit("\n")))
    return [Section(title), Section(row, over="files"), Section(F.col("hash_line"))]


@query("render_custom")
def render_custom(spark: SparkSession, folder: str) -> DataFrame:
    directories = summarize(_directories(spark, folder), "none")
    shown = directories.each(lambda d: render_variables(d, STAMP))
    return whole_texts(shown, _short_layout()).withColumnRenamed("text", "markdown")


# Summarisers supplied by the caller


def _counting_summarizer():
    """Answers with the directory and the length of the request."""

    def answer(messages: list[dict]) -> str:
        content = messages[-1]["content"]
        path = content.split("Directory: ", 1)[1].split("\n", 1)[0]
        fields = {"overview": f"{path} {len(content)}", "key_symbols": [path, None, 1]}
        return "```json\n" + json.dumps(fields) + "\n```"

    return answer


def _failing_once_summarizer():
    """Fails at the first call for every directory."""
    answer, seen = _counting_summarizer(), set()

    def failing(messages: list[dict]) -> str:
        content = messages[-1]["content"]
        if content not in seen:
            seen.add(content)
            raise ConnectionError("busy")
        return answer(messages)

    return failing


def _refusing_summarizer():
    """Fails for requests whose length is a multiple of three."""
    answer = _counting_summarizer()

    def refusing(messages: list[dict]) -> str:
        if len(messages[-1]["content"]) % 3 == 0:
            raise ValueError("refused")
        return answer(messages)

    return refusing


def _summarized_by(factory) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        sent = requests(_directories(spark, folder))
        answers = written(ask(sent, factory, max_retries=2, retry_delay=0.0), "answers")
        return summaries_from(answers).select(
            "root", "dir", F.col("summary.overview").alias("overview"),
            _text(F.col("summary.key_symbols")).alias("key_symbols"),
            "summary_status", "attempts", "error",
        )

    return run


QUERIES["summarize_udf"] = _summarized_by(_counting_summarizer)
QUERIES["summarize_retry"] = _summarized_by(_failing_once_summarizer)
QUERIES["summarize_errors"] = _summarized_by(_refusing_summarizer)


# Sinks


@query("incremental_write")
def incremental_write(spark: SparkSession, folder: str) -> DataFrame:
    """Three runs: everything, nothing new, and some files changed."""
    store = Store(new_folder(spark, "store"))
    before = views.code(spark, folder)
    touched = F.col("path").endswith("97.py")
    content = F.when(touched, F.concat("content", F.lit("\n# touched\n")))
    after = before.withColumn("content", F.coalesce(content, "content"))
    counts = None
    for number, corpus in enumerate([before, before, after], start=1):
        run = runs.generate(TableCorpus(corpus), store, ignore=())
        row = run.counts.select(F.lit(number).alias("run"), "*")
        counts = row if counts is None else counts.unionByName(row)
    return counts


@query("export_documents")
def export_documents(spark: SparkSession, folder: str) -> DataFrame:
    target = new_folder(spark, "export")
    exported = write_documents(_documents(spark, folder), target)
    return written(exported, "exported").select(
        "root", dir_of(F.col("path")).alias("dir"), "bytes", "error"
    )


@query("purge_listing")
def purge_list(spark: SparkSession, folder: str) -> DataFrame:
    hashes = directory_hashes(_hashed(_all_corpora(spark, folder)))
    current = current_manifest(_manifest(hashes))
    docs = purge_listing(current, "docs", "src3")
    return docs.unionByName(purge_listing(current, "web")).select("root", "dir")



@query("purge_effect")
def purge_effect(spark: SparkSession, folder: str) -> DataFrame:
    """What a purge leaves behind: documents, files, and counts of what it removed."""
    store, target = Store(new_folder(spark, "store")), new_folder(spark, "purged")
    runs.generate(TableCorpus(views.code(spark, folder)), store, ignore=())
    written(write_documents(store.documents(spark), target), "exported")
    gone = runs.purge(store, spark, "code", "brand_1", folder=target)
    counts = gone.agg(
        F.count_if(F.col("error").isNull()).alias("deleted"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )
    left = store.documents(spark).select("root", "dir").withColumn("stored", F.lit(True))
    found = list_trees(spark, [f"{target.removeprefix('file:')}/code"]).where(F.col("kind") == "file")
    files = with_path_parts(found.select(F.lit("code").alias("root"), "path"))
    files = files.select("root", "dir").withColumn("exported", F.lit(True))
    both = left.join(files, ["root", "dir"], "full").crossJoin(F.broadcast(counts))
    return both.select("root", "dir", "stored", "exported", "deleted", "failed")
