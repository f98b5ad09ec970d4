"""Summaries of directories: native, or by a function the caller supplies."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelens.functions.paths import display_name, display_path
from treelens.functions.prompts import messages, prompt_layout
from treelens.functions.responses import empty_summary, no_items, validate_answers
from treelens.functions.sections import whole_text
from treelens.functions.text import valid_text
from treelens.operators.groups import task_count
from treelens.operators.journal import BUCKET, Journal
from treelens.operators.pieces import whole_texts
from treelens.operators.records import as_json, closed_record, directory_struct, record_layout
from treelens.operators.rollup import Directories
from treelens.operators.sinks import mounted
from treelens.operators.workspace import written

# A summariser takes the messages of one directory, or its record as a dict, and
# returns the raw answer, or a dict with the fields of one.
Summarizer = Callable[[list[dict] | dict], str | dict | None]
# Called once per partition, on its first row.
SummarizerFactory = Callable[[], Summarizer]

KEY_SYMBOLS = 10
ANSWERS = "root string, dir string, raw string, attempts int, error string"


def named(records: DataFrame) -> DataFrame:
    """Add `path` and `dir_name` as shown to readers."""
    root, directory = F.col("root"), F.col("dir")
    return records.withColumns(
        {"path": display_path(root, directory), "dir_name": display_name(root, directory)}
    )


def extractive_summary(records: DataFrame, prefix: str = "") -> DataFrame:
    """Add a deterministic `summary` made from names and counts alone."""
    overview = F.format_string(
        "%sDirectory '%s' holds %d source file(s).", F.lit(prefix), "dir_name", "file_count"
    )
    leading = F.concat("leading_all_functions", "leading_all_classes")
    summary = F.struct(
        overview.alias("overview"),
        F.slice(leading, 1, KEY_SYMBOLS).alias("key_symbols"),
        no_items().alias("patterns"),
        no_items().alias("tribal_knowledge"),
    )
    return named(records).withColumn("summary", summary)


def prompts(records: DataFrame) -> DataFrame:
    """Add `prompt`, `messages` and the `record` as JSON to directory records."""
    return (
        named(records)
        .withColumn("prompt", whole_text(prompt_layout()))
        .withColumn("messages", messages(F.col("prompt")))
        .withColumn("record", as_json(directory_struct()))
    )


def requests(
    directories: Directories,
    request: str = "messages",
    save: Callable[[DataFrame, str], DataFrame] = written,
) -> DataFrame:
    """`root`, `dir` and the `request` of all directories: `prompt` and `messages`, or `record`.

    A request is one value; one that no value can hold is null.
    """
    shown = directories.each(named)
    if request == "messages":
        texts = whole_texts(shown, prompt_layout(), save=save)
        asked = F.when(F.col("text").isNotNull(), messages(F.col("text")))
        return texts.select("root", "dir", F.col("text").alias("prompt"), asked.alias("messages"))
    texts = whole_texts(shown, record_layout(), save=save)
    return texts.select("root", "dir", closed_record(F.col("text")).alias("record"))


def ask(
    prompted: DataFrame,
    factory: SummarizerFactory,
    max_retries: int = 2,
    retry_delay: float = 1.0,
    partitions: int | None = None,
    request: str = "messages",
    journal: str | None = None,
) -> DataFrame:
    """Answers for rows of `root`, `dir` and the `request`: `messages` or `record`.

    A call that fails is repeated up to `max_retries` times, waiting twice as
    long each time. What still fails becomes an `error`; the job goes on.
    `partitions` bounds the calls in flight; the default is one per shuffle
    partition. Calls cost and may differ when repeated: write the result before
    using it. With `journal`, a mounted folder for one kind of summariser, every
    answer is kept there at once, and a request that has one is not sent: not by
    a task that is repeated, and not by a later run.
    """

    def attempt_all(get: Callable[[], Summarizer], sent: object) -> tuple:
        error = None
        for attempt in range(1, max_retries + 2):
            try:
                answer = get()(sent)
                if answer is None or isinstance(answer, str):
                    return answer and valid_text(answer), attempt, None
                return json.dumps(answer), attempt, None
            except Exception as failure:
                error = valid_text(f"{type(failure).__name__}: {failure}")
            if attempt <= max_retries:
                time.sleep(retry_delay * 2 ** (attempt - 1))
        return None, max_retries + 1, error

    def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: list[Summarizer] = []
        too_large = (None, 0, "request too large for one value")

        def get() -> Summarizer:
            if not made:
                made.append(factory())
            return made[0]

        def answered(key: str, sent: str | None) -> tuple:
            if not sent:
                return too_large
            known = None if kept is None else kept.get(key)
            if known is not None:
                return known, 0, None
            raw, attempts, error = attempt_all(get, json.loads(sent))
            if kept is not None and error is None:
                kept.put(key, raw)
            return raw, attempts, error

        kept = None if base is None else Journal(base)
        try:
            for batch in batches:
                columns = (batch[name] for name in ("root", "dir", "key", "sent"))
                out = [(root, directory, *answered(key, sent)) for root, directory, key, sent in zip(*columns)]
                yield pd.DataFrame(out, columns=["root", "dir", "raw", "attempts", "error"])
        finally:
            if kept is not None:
                kept.close()

    base = None if journal is None else mounted(journal)
    asked = F.col(request) if request == "record" else F.to_json(request)
    sent = prompted.select("root", "dir", F.sha2(asked, 256).alias("key"), asked.alias("sent"))
    tasks = partitions or task_count(sent)
    if base is None:
        sent = sent.repartition(tasks, "root", "dir")
    else:
        # A task has whole buckets of the journal and reads them one after the other.
        sent = sent.repartition(tasks, F.left("key", F.lit(BUCKET))).sortWithinPartitions("key")
    return sent.mapInPandas(answers, ANSWERS)


def summaries_from(answers: DataFrame) -> DataFrame:
    """Validated summaries of raw answers; a failed call gives an empty one."""
    checked = validate_answers(answers)
    failed = F.col("error").isNotNull()
    return checked.select(
        "root",
        "dir",
        F.when(failed, empty_summary()).otherwise(F.col("summary")).alias("summary"),
        F.when(failed, F.lit("failed")).otherwise(F.col("parse_status")).alias("summary_status"),
        "attempts",
        "error",
    )


def attach_summaries(records: DataFrame, summaries: DataFrame) -> DataFrame:
    """Join summaries to directories; a directory without one gets the empty summary."""
    joined = records.join(
        summaries.select("root", "dir", "summary", "summary_status", "error"),
        ["root", "dir"],
        "left",
    )
    return joined.withColumns(
        {
            "summary": F.coalesce("summary", empty_summary()),
            "summary_status": F.coalesce("summary_status", F.lit("none")),
        }
    )


def without_summary(records: DataFrame) -> DataFrame:
    """Directories with the empty summary, for documents from extracted data only."""
    return records.withColumn("summary", empty_summary())


def summarize(
    directories: Directories,
    how: str | SummarizerFactory = "extractive",
    save: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
    **options,
) -> Directories:
    """Add `summary`, `summary_status` and `error` to all directories.

    `how` is `extractive`, `none`, or a factory of a summariser; `save` writes
    the answers. Directories of any size are sent. A request is one value for
    one call; one that no value can hold gets the error of a refused request.
    """
    if how == "extractive":
        return directories.each(lambda d: _marked(extractive_summary(d), "ok"))
    if how == "none":
        return directories.each(lambda d: _marked(without_summary(d), "none"))
    sent = requests(directories, options.get("request", "messages"))
    summaries = summaries_from(save(ask(sent, how, **options), "answers"))
    return directories.each(lambda d: attach_summaries(d, summaries))


def _marked(records: DataFrame, status: str, error: str | None = None) -> DataFrame:
    return records.withColumns(
        {"summary_status": F.lit(status), "error": F.lit(error).cast("string")}
    )
