"""Repeated passages: runs of neighbouring lines with 50 words or more that occur before.

From every line on, and up to every line, the shortest run of lines that is as
long as a passage is looked up by its SHA-256 over all documents. A repeated
passage of any number of lines is the union of such runs inside it, so it is
found whole, whatever surrounds it. Of equal runs the first in order of id and
line stays. Blank lines separate nothing and count for nothing. Everything is
DataFrame functions.

Defined results: null and empty texts stay as they are. Rows with the same id
and text are one document for the order of passages, so they keep and lose the
same ones; rows with null ids come first. Where a passage overlaps its own
repeat, the first is left whole. An empty table gives an empty result. Other
columns are carried along, whatever they are called. Work and memory grow with
the number of lines of a document, whose lines are an array.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChunkRules:
    """A passage has at least `min_words`."""

    min_words: int = 50


def materialised(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later expressions read instead of computing it again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def shortest(words: Column, rules: ChunkRules) -> Column:
    """How many of the first values it takes to come to a passage; null if all are too few."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))

    def more(state: Column, value: Column) -> Column:
        enough = state["sum"] >= rules.min_words
        return F.when(enough, state).otherwise(
            F.struct((state["sum"] + value).alias("sum"), (state["n"] + 1).alias("n"))
        )

    return F.aggregate(words, start, more, lambda state: F.when(state["sum"] >= rules.min_words, state["n"]))


def passage_rows(documents: DataFrame, rules: ChunkRules) -> DataFrame:
    """`doc_id`, `row_key`, first and last line and `hash` of every shortest run."""
    keyed = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), lines_of(F.col("text")).alias("all"))
    marks = F.transform(
        F.col("all"),
        lambda line, at: F.struct(at.alias("at"), F.regexp_count(line, F.lit(r"\S+")).alias("words"), line.alias("line")),
    )
    filled = materialised(keyed, "marks", F.filter(marks, lambda mark: mark["words"] > 0)).drop("all")
    filled = filled.where(F.size("marks") > 0)
    n = F.size("marks")

    # Lines with text have a word at least, so no run has more lines than a passage has words.
    def onward(at: Column) -> Column:
        run = F.slice("marks", at + 1, F.lit(rules.min_words))
        return F.struct(at.alias("first"), (at + shortest(run["words"], rules) - 1).alias("last"))

    def backward(at: Column) -> Column:
        start = F.greatest(at - rules.min_words + 1, F.lit(0))
        run = F.reverse(F.slice("marks", start + 1, at - start + 1))
        return F.struct((at - shortest(run["words"], rules) + 1).alias("first"), at.alias("last"))

    places = F.sequence(F.lit(0), n - 1)
    # In order of their first lines, so that a run is looked up in the others by its place.
    from_each = materialised(filled, "onward", F.transform(places, onward))
    up_to_each = F.filter(
        F.transform(places, backward),
        lambda r: r["first"].isNotNull() & ~F.get("onward", r["first"])["last"].eqNullSafe(r["last"]),
    )
    runs = F.concat(F.filter("onward", lambda r: r["last"].isNotNull()), up_to_each)
    found = materialised(from_each, "runs", runs)

    def described(run: Column) -> Column:
        body = F.array_join(F.slice("marks", run["first"] + 1, run["last"] - run["first"] + 1)["line"], "\n")
        return F.struct(
            F.get("marks", run["first"])["at"].alias("first"),
            F.get("marks", run["last"])["at"].alias("last"),
            F.unhex(F.sha2(body, 256)).alias("hash"),
        )

    return found.select("doc_id", "row_key", F.inline(F.transform("runs", described)))


def repeated_lines(documents: DataFrame, rules: ChunkRules) -> DataFrame:
    """`doc_id`, `row_key` and the first and last lines of the runs to remove.

    A run that a third of all documents share is one row per task after the
    partial count.
    """
    runs = passage_rows(documents.select("doc_id", "text"), rules)
    place = F.struct("doc_id", "row_key", "first", "last")
    groups = (
        runs.groupBy("hash")
        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("stays"))
        .where("n > 1")
        .select("hash", "stays")
    )
    same = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("row_key") == F.col("stays.row_key"))
    first = F.when(same, F.greatest("first", F.col("stays.last") + 1)).otherwise(F.col("first"))
    return (
        runs.join(groups, "hash")
        .where(~place.eqNullSafe(F.col("stays")))
        .select("doc_id", "row_key", first.alias("first"), "last")
        .where("first <= last")
        .groupBy("doc_id", "row_key")
        .agg(F.collect_set(F.struct("first", "last")).alias("removed"))
    )


def stretches(places: str) -> Column:
    """Number of runs of neighbouring numbers."""
    return F.size(F.array_except(F.col(places), F.transform(places, lambda at: at + 1)))


def without_repeats(documents: DataFrame, rules: ChunkRules) -> DataFrame:
    """`doc` with all columns of a document, the text that is `left` of it, and counts.

    The narrow list of removals is joined with the texts; only that join moves them.
    """
    doc = F.struct(*[F.col(f"`{n}`") for n in documents.columns])
    carried = documents.select(F.col("doc_id"), F.col("text"), doc.alias("doc"))
    gone = repeated_lines(documents, rules).select(
        F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key"), "removed"
    )
    keyed = carried.withColumn("row_key", F.xxhash64("doc_id", "text"))
    same = keyed["doc_id"].eqNullSafe(gone["gone_id"]) & (keyed["row_key"] == gone["gone_key"])
    joined = keyed.join(gone, same, "left").select("doc", "doc_id", "text", "removed")
    lines = materialised(joined, "lines", lines_of(F.col("text")))
    spans = F.transform("removed", lambda span: F.sequence(span["first"], span["last"]))
    none = F.array().cast("array<int>")
    placed = materialised(lines, "out", F.coalesce(F.array_distinct(F.flatten(spans)), none))
    pieces = materialised(placed, "kept", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("out")))
    rest = F.array_join(F.transform("kept", lambda at: F.get("lines", at)), "\n")
    return pieces.select(
        "doc",
        F.when(F.col("removed").isNull(), F.col("text")).otherwise(rest).alias("left"),
        (stretches("kept") + stretches("out")).cast("long").alias("n_chunks"),
        stretches("out").cast("long").alias("n_removed"),
    )


def own_columns(documents: DataFrame, names: list[str]) -> list[Column]:
    """Columns of a document out of `doc`, with the new text and its length."""
    columns = {n: F.col("doc").getField(n) for n in names}
    columns["text"] = F.col("left")
    if "n_chars" in names:
        changed = F.length("left").cast(documents.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_removed") > 0, changed).otherwise(F.col("doc.n_chars"))
    return [columns[n].alias(n) for n in names]


def line_dedup(documents: DataFrame, rules: ChunkRules | None = None) -> DataFrame:
    """The documents without repeated passages.

    `n_removed` counts the stretches of lines that went, `n_chunks` those and the
    ones that stayed; they stand in place of columns of these names.
    """
    done = without_repeats(documents, rules or ChunkRules())
    names = [n for n in documents.columns if n not in ("n_chunks", "n_removed")]
    return done.select(*own_columns(documents, names), "n_chunks", "n_removed")


def line_dedup_stage(documents: DataFrame, rules: ChunkRules | None = None) -> DataFrame:
    """The documents without repeated passages; those of which nothing is left go. Same columns."""
    done = without_repeats(documents, rules or ChunkRules())
    emptied = (F.col("n_removed") > 0) & (F.trim("left") == "")
    return done.where(~emptied).select(*own_columns(documents, documents.columns))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(documents).select("doc_id", "text", "n_chars", "n_chunks", "n_removed")
