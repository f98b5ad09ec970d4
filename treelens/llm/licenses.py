"""License texts in documents, found by votes on diagonals.

Every run of k words of a document is hashed and joined with the places that
the run has in license templates. A hit at word p of the document and word t of
the template votes for the diagonal p - t. Neighbouring diagonals, which differ
by inserted or missing words, are merged, and a merged span counts if the words
it holds cover enough of the template in about its length. Everything is
DataFrame functions; documents are read once and never shuffled, only their
hits are.

Defined results: null and empty texts have no words and no label; rows are told
apart by a number of their own, so null or repeated ids do no harm; an empty
table gives an empty result. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treelens.operators.workspace import written

# Fixed values of the base rule: consecutive words and their label.
BASE_PHRASES = (
    (("cc", "by"), "cc-by"),
    (("general", "public", "license"), "gpl"),
    (("all", "rights", "reserved"), "reserved"),
)

# What separates words, once A-Z are in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation",
    ),
    ("bsd", "Licensed under the BSD License"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("reserved", "All rights reserved"),
)


@dataclass(frozen=True)
class VotingRules:
    """Run length, how far diagonals may lie apart, and what a span must show."""

    k: int = 3
    drift: int = 3
    min_cover: float = 0.6
    max_stretch: float = 1.5
    templates: tuple[tuple[str, str], ...] = field(default=TEMPLATES)


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """The words of a text in lower case."""
    return F.array_remove(F.split(text, SEPARATORS), "")


def run_hash(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(k)])


def run_text(words: Column, at: Column, k: int) -> Column:
    return F.concat_ws(" ", *[F.get(words, at + j) for j in range(k)])


def materialised(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later expressions read instead of computing it again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def template_runs(spark: SparkSession, rules: VotingRules) -> DataFrame:
    """The runs of all templates with their places: as many rows as the templates have words."""
    rows = [(i, label, text) for i, (label, text) in enumerate(rules.templates)]
    df = spark.createDataFrame(rows, "template int, label string, body string")
    df = materialised(df, "words", words_of(lowered(F.col("body"))))
    n = F.size("words") - (rules.k - 1)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    df = df.select("template", "label", n.alias("t_runs"), "words", F.explode(places).alias("t_at"))
    return df.select(
        "template",
        "label",
        "t_runs",
        "t_at",
        run_hash(F.col("words"), F.col("t_at"), rules.k).alias("run_hash"),
        run_text(F.col("words"), F.col("t_at"), rules.k).alias("run_text"),
        run_hash(F.col("words"), F.col("t_at"), 1).alias("word_hash"),
    )


SIEVE = 4096


def sieve(hashes: list[int]) -> Column:
    """One flag for each value of the low bits of a hash, set for the given hashes."""
    flags = [False] * SIEVE
    for h in hashes:
        flags[h % SIEVE] = True
    return F.array(*map(F.lit, flags))


def passes(hashed: Column, flags: Column) -> Column:
    """False only for hashes that no template has."""
    return F.get(flags, hashed.bitwiseAND(F.lit(SIEVE - 1)).cast("int"))


def scanned(documents: DataFrame, rules: VotingRules, known: list) -> DataFrame:
    """One row per document: the base places, and the runs that may be of a template.

    A run is hashed where its first word may be of a template, and goes on to the
    join where its hash may be. Both sieves let everything through that can match.
    """
    known_words, known_runs = sieve([r.word_hash for r in known]), sieve([r.run_hash for r in known])
    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), lowered(F.col("text")).alias("body"))
    df = materialised(df, "lower", F.col("body")).drop("body")
    may_be = F.lit(False)
    for phrase, _ in BASE_PHRASES:
        every = F.lit(True)
        for word in phrase:
            every = every & F.contains(F.col("lower"), F.lit(word))
        may_be = may_be | every
    df = df.select("doc_id", may_be.alias("may_be"), F.explode(F.array(words_of(F.col("lower")))).alias("words"))
    words, k = F.col("words"), rules.k

    def is_base(at: Column) -> Column:
        found = F.lit(False)
        for phrase, _ in BASE_PHRASES:
            same = F.lit(True)
            for j, word in enumerate(phrase):
                same = same & F.coalesce(F.get(words, at + j) == word, F.lit(False))
            found = found | same
        return found

    def base_label(at: Column) -> Column:
        label = F.lit(None).cast("string")
        for phrase, name in BASE_PHRASES:
            label = F.when(F.get(words, at) == phrase[0], F.lit(name)).otherwise(label)
        return label

    none = F.array().cast("array<int>")
    every = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(none)
    runs = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(none)
    base = F.when(F.col("may_be"), F.filter(every, is_base)).otherwise(none)
    hits = F.filter(
        runs,
        lambda at: passes(run_hash(words, at, 1), known_words) & passes(run_hash(words, at, k), known_runs),
    )
    df = df.select("doc_id", "words", F.explode(F.array(F.struct(base.alias("base"), hits.alias("hits")))).alias("found"))
    return df.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.col("found.base").alias("base"),
        F.array_sort(F.array_distinct(F.transform(F.col("found.base"), base_label))).alias("base_label_list"),
        F.transform(
            F.col("found.hits"),
            lambda at: F.struct(
                at.alias("at"), run_hash(words, at, k).alias("run_hash"), run_text(words, at, k).alias("run_text")
            ),
        ).alias("hits"),
    )


def spans_of(found: DataFrame, runs: DataFrame, rules: VotingRules) -> DataFrame:
    """Verified spans: row, template, label, first and last word, share of the template covered."""
    hits = found.select("row", F.inline("hits"))
    votes = (
        hits.join(F.broadcast(runs), ["run_hash", "run_text"])
        .groupBy("row", "template", "label", "t_runs", (F.col("at") - F.col("t_at")).alias("diagonal"))
        .agg(F.collect_set("t_at").alias("covered"), F.min("at").alias("first"), F.max("at").alias("last"))
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    # A diagonal takes part in the span of its neighbours within the drift.
    started = votes.withColumn("starts", F.when(F.coalesce(gap > rules.drift, F.lit(True)), 1).otherwise(0))
    spans = (
        started.withColumn("span", F.sum("starts").over(order))
        .groupBy("row", "template", "label", "t_runs", "span")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n_covered"),
            F.min("first").alias("first"),
            (F.max("last") + rules.k - 1).alias("last"),
        )
    )
    cover = F.col("n_covered") / F.col("t_runs")
    length = F.col("last") - F.col("first") + 1
    return spans.select("row", "template", "label", "first", "last", cover.alias("cover")).where(
        (F.col("cover") >= rules.min_cover) & (length <= rules.max_stretch * (F.col("t_runs") + rules.k - 1))
    )


def license_scan(documents: DataFrame, rules: VotingRules | None = None) -> DataFrame:
    """Words, base places and labels of every document, with the spans behind the labels."""
    rules = rules or VotingRules()
    spark = documents.sparkSession
    runs = template_runs(spark, rules)
    known = runs.collect()
    found = written(scanned(documents, rules, known), "license-hits")
    spans = spans_of(found, spark.createDataFrame(known, runs.schema), rules)
    by_row = spans.groupBy("row").agg(
        F.array_sort(F.collect_set("label")).alias("span_labels"),
        F.max("cover").alias("cover"),
        F.array_sort(F.collect_list(F.struct("first", "last", "label"))).alias("spans"),
    )
    base = F.col("base")
    n_base = F.size(base)
    empty = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union(F.col("base_label_list"), F.coalesce(F.col("span_labels"), empty)))
    score = F.when(n_base > 0, F.lit(1.0)).otherwise(F.least(F.coalesce(F.col("cover"), F.lit(0.0)), F.lit(1.0)))
    return found.drop("hits").join(by_row, "row", "left").select(
        "doc_id",
        "n_words",
        n_base.cast("long").alias("n_base"),
        F.when(n_base > 0, F.array_min(base)).cast("long").alias("first_word"),
        F.when(n_base > 0, F.array_max(base)).cast("long").alias("last_word"),
        F.array_join("base_label_list", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
        "spans",
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
