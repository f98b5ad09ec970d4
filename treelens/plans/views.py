"""Corpora derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.sources.corpus import corpus_from_table

# Valid Python made from the columns of `part`; every tenth file does not parse.
CODE_PATH = (
    "concat('brand_', replace(p_brand, 'Brand#', ''), '/', lower(replace(p_type, ' ', '_')), "
    "'/p_', p_partkey, '.py')"
)
CODE = (
    "concat('\"\"\"', p_name, '\"\"\"', chr(10), 'import m_', p_size, chr(10), "
    "'def f_', p_partkey, '():', chr(10), '    import n_', p_partkey % 7, chr(10), "
    "'    def inner(): pass', chr(10), "
    "'class C_', replace(p_brand, 'Brand#', ''), ':', chr(10), "
    "'    def meth(self): pass', chr(10), "
    "'from .r_', p_size % 3, ' import y', chr(10), "
    "CASE WHEN p_partkey % 10 = 9 THEN 'def (' ELSE '' END)"
)
DOC_PATH = "concat(source, '/', lang, '/doc_', doc_id, '.txt')"

# Answers as a summariser might give them, well-formed and not.
_FIELDS = (
    "'{\"overview\": \"', event_type, ' ', event_id, '\", \"key_symbols\": [\"', event_type, "
    "'\", \"k\"], \"patterns\": [], \"tribal_knowledge\": [\"p', event_id % 5, '\"]}'"
)
ANSWER = (
    "CASE event_id % 6 "
    f"WHEN 0 THEN concat('  ', {_FIELDS}, chr(10)) "
    f"WHEN 1 THEN concat('```json', chr(10), {_FIELDS}, chr(10), '```') "
    "WHEN 2 THEN concat('{\"overview\": ', event_type) "
    "WHEN 3 THEN concat('[\"', event_type, '\"]') "
    "WHEN 4 THEN concat('{\"overview\": ', event_id % 10, ', \"key_symbols\": \"', event_type, "
    "'\", \"patterns\": [1, 2]}') "
    "ELSE concat('{\"overview\": null, \"key_symbols\": [null, \"', event_type, "
    "'\", 3], \"extra\": ', props, '}') END"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def docs(spark: SparkSession, folder: str) -> DataFrame:
    """`documents` as text files per source and language."""
    rows = table(spark, folder, "documents")
    return corpus_from_table(rows, F.expr(DOC_PATH), "text", F.lit("docs"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """`pages` as files under their hosts; pages after the first of a path have their id in it."""
    path = F.col("url")
    for pattern in ("^https?://", "[?#].*$", "/$"):
        path = F.regexp_replace(path, pattern, "")
    rows = table(spark, folder, "pages").select("page_id", path.alias("path"), "html")
    first = rows.groupBy("path").agg(F.min("page_id").alias("first"))
    unique = F.when(F.col("page_id") == F.col("first"), F.col("path")).otherwise(
        F.concat("path", F.lit("~"), "page_id")
    )
    rows = rows.join(first, "path").select(unique.alias("path"), "html")
    return corpus_from_table(rows, "path", "html", F.lit("web"))


def code(spark: SparkSession, folder: str) -> DataFrame:
    """`part` as Python files per brand and type."""
    rows = table(spark, folder, "part")
    return corpus_from_table(rows, F.expr(CODE_PATH), F.expr(CODE), F.lit("code"))


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """`events` as raw answers, keyed by event."""
    return table(spark, folder, "events").select("event_id", F.expr(ANSWER).alias("raw"))
