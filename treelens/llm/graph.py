"""Connected components of links, without a node's links ever being gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelens.operators.workspace import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node` and the smallest node it is connected with, for nodes that are not smallest themselves.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours, then its smaller ones, to the smallest node it knows. Links only
    get fewer, long chains halve, and each step is a partial aggregate and a
    join that Spark may split. Every round is written, so a lost executor costs
    its tasks only. The last round is the one that has as many links as the one
    before and none that it had not.
    """
    # The larger node stands in u.
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = written(edges.distinct(), "links")
    count = edges.count()
    while count:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select("u", "v", "low")
        after = written(
            small.select("u", F.col("low").alias("v"))
            .unionByName(small.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")))
            .distinct(),
            "links",
        )
        left = after.count()
        settled = left == count and after.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges, count = after, left
        if settled:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
