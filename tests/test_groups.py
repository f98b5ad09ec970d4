from itertools import groupby

import pytest
from pyspark.sql import functions as F

from treelens.operators.groups import Cut, Limits, in_pieces, split_by_size


@pytest.mark.parametrize("cut", [Cut(7, 1), Cut(7, 5), Cut(1, 3), Cut(1000, 4)])
def test_pieces_are_bounded_and_in_order(spark, cut):
    rows = spark.range(300).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("k"),
        F.concat(F.lit("n"), F.xxhash64("id")).alias("name"),
    )
    found = in_pieces(rows.repartition(6), ["k", "name"], cut).collect()
    assert len(found) == 300
    in_order = sorted(found, key=lambda r: (r.k, r.name))
    pieces = [(piece, len(list(rows))) for piece, rows in groupby(in_order, lambda r: r.piece)]
    numbers = [piece for piece, _ in pieces]
    assert numbers == sorted(set(numbers)) and max(n for _, n in pieces) <= cut.rows


def test_split(spark):
    rows = spark.createDataFrame(
        [("a", 1)] * 5 + [("b", 1)] * 6 + [("c", 100)] + [("d", None)], "k string, w int"
    )
    split = split_by_size(rows, ["k"], Limits(rows=5, bytes=99), F.col("w"))
    assert {r.k for r in split.bounded.collect()} == {"a", "d"}
    assert split.bounded.count() == 6 and split.oversized.count() == 7
    within = split_by_size(rows, ["k"], Limits(), F.col("w"))
    assert within.oversized is None and within.bounded.count() == 13


def test_the_tasks_of_a_sort_do_not_grow_with_the_number_of_pieces(spark):
    rows = spark.range(40_000).select((F.col("id") % 100).alias("k"), F.col("id").alias("name"))
    split = split_by_size(rows, ["k"], Limits(rows=5))
    # 8,000 pieces; a task for every 16 of them sent as many task results to the driver.
    assert split.cut.rows == 5 and split.cut.ranges <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = in_pieces(split.oversized, ["k", "name"], split.cut).groupBy("piece").count()
    assert found.agg(F.max("count"), F.sum("count")).first() == (5, 40_000)
