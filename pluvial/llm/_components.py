"""Connected components of a graph given as rows, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, remove_folder

#: A side of fewer rows than this (a few long columns) may be broadcast.
SMALL = 400_000


def beside(rows: DataFrame, side: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``side``, a table read from files: by broadcast if its counted rows are few,
    else by a shuffle of both, whose large partitions Spark splits."""
    return rows.join(F.broadcast(side) if side.count() <= SMALL else side.hint("merge"), on, how)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b: long, not null); root is the component's smallest node.

    A large-star step links each node's larger neighbours to the smallest one,
    a small-star step does so for the node and its smaller neighbours; when a
    round changes nothing, each node hangs on its root. The number of rounds
    grows with the logarithm of the longest path. Repeated edges and loops do
    no harm; no edges, no rows.
    """
    spark = edges.sparkSession
    e, uri = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def digest(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = digest(e)
    for _ in range(rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, uri_1 = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "edges")
        large = beside(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, uri_2 = cut(large.where("u <> v"), "edges")
        least, uri_3 = cut(large.groupBy("u").agg(F.min("v").alias("m")), "edges")
        small = beside(large, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new, uri_4 = cut(small.where("u <> v").distinct(), "edges")
        for x in (uri, uri_1, uri_2, uri_3):
            remove_folder(spark, x)
        e, uri = new, uri_4
        after = digest(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
