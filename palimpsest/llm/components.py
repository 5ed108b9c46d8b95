"""Connected components of a link table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import discard, staged


def connected_components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node, comp for every node of a link; comp is the smallest node of its component.

    Large-star and small-star steps in turn, each written to the shared folder, until nothing changes (told by the
    number and two 64-bit sums of the distinct links); the number of rounds grows with the logarithm of the longest
    chain. No links: no rows.
    """
    spark = links.sparkSession

    def mark(table: DataFrame) -> tuple:
        one = F.xxhash64("u", "v")
        return tuple(table.agg(F.count("*"), F.bit_xor(one), F.sum(F.shiftright(one, 20))).first())

    edges, path = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u goes to the smallest one of u and its neighbours
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of u, and u itself, go to the smallest of them
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(floor, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(floor.select("u", F.col("m").alias("v")))
        after, after_path = staged(small.where("u <> v").distinct(), "links")
        discard(spark, path)
        edges, path, found = after, after_path, mark(after)
        if found == before:
            break
        before = found
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
