"""Structured answers of a summariser: clean-up, validation, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelens.functions.text import BLANKS, strip

SUMMARY = (
    "struct<overview: string, key_symbols: array<string>, patterns: array<string>, "
    "tribal_knowledge: array<string>>"
)
LIST_FIELDS = ("key_symbols", "patterns", "tribal_knowledge")


def no_items() -> Column:
    return F.array().cast("array<string>")


def empty_summary() -> Column:
    """A summary with nothing in it."""
    return F.struct(
        F.lit("").alias("overview"), *(no_items().alias(field) for field in LIST_FIELDS)
    )


def has_content(summary: Column) -> Column:
    """True when any field of the summary says something."""
    filled = summary["overview"] != ""
    for field in LIST_FIELDS:
        filled = filled | (F.size(summary[field]) > 0)
    return F.coalesce(filled, F.lit(False))


def clean_answer(raw: Column) -> Column:
    """The answer without blanks around it and without a code fence.

    The opening fence goes with its line; a fenced answer on a single line keeps
    it and so fails to parse.
    """
    text = strip(raw)
    fence = "```"
    # Without a newline the position is 0, and the text stays as it is.
    opened = F.substring(text, F.locate("\n", text) + 1, F.char_length(text))
    inside = F.left(opened, F.char_length(opened) - len(fence))
    closed = F.when(opened.endswith(fence), F.rtrim(inside, F.lit(BLANKS))).otherwise(opened)
    return F.when(text.startswith(fence), closed).otherwise(text)


def parsed_answer(text: Column) -> Column:
    """The one JSON value a text holds, as a variant; NULL if it is not valid JSON.

    Inside of brackets nothing may follow the value. A text with a repeated key
    is read again by fields, of which the last one counts.
    """
    listed = F.concat(F.lit("["), text, F.lit("]"))
    fields = ", ".join(f"{field}: variant" for field in ("overview", *LIST_FIELDS))
    strict_json = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    by_field = F.to_json(F.from_json(listed, f"array<struct<{fields}>>", strict_json))
    values = F.coalesce(F.try_parse_json(listed), F.try_parse_json(by_field))
    values = F.try_variant_get(values, "$", "array<variant>")
    return F.when(F.size(values) == 1, F.get(values, 0))


def validate_answers(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add `summary`, always complete, and `parse_status` for a column of answers.

    The status is `ok`, `bad_json`, `not_object`, or `bad_field` when a list
    field holds something else. An empty or missing answer counts as `{}`.
    Of a repeated key the last one counts. List items become strings and nulls
    among them are dropped.
    """
    given = F.coalesce(F.nullif(F.col(raw), F.lit("")), F.lit("{}"))
    cleaned = df.withColumn("_text", clean_answer(given))
    parsed = cleaned.withColumn("_answer", parsed_answer(F.col("_text")))
    answer = F.col("_answer")
    # Valid JSON without blanks in front is an object exactly if it starts like one.
    is_object = answer.isNotNull() & F.col("_text").startswith("{")
    # An array is the only value that can be read as one.
    lists = {f: F.try_variant_get(answer, f"$.{f}", "array<string>") for f in LIST_FIELDS}
    summary = F.struct(
        F.coalesce(F.try_variant_get(answer, "$.overview", "string"), F.lit("")).alias("overview"),
        *(F.coalesce(F.array_compact(lists[f]), no_items()).alias(f) for f in LIST_FIELDS),
    )
    bad_field = F.lit(False)
    for f in LIST_FIELDS:
        present = F.try_variant_get(answer, f"$.{f}", "variant").isNotNull()
        bad_field = bad_field | (present & lists[f].isNull())
    status = (
        F.when(answer.isNull(), "bad_json")
        .when(~is_object, "not_object")
        .when(bad_field, "bad_field")
        .otherwise("ok")
    )
    return parsed.withColumns(
        {
            "summary": F.when(is_object, summary).otherwise(empty_summary()),
            "parse_status": status,
        }
    ).drop("_text", "_answer")
