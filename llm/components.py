"""Connected components of a link table, by contracting stars (large and small star steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import settle


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that each linked id reaches. Ids without a link have no row.

    Every round hangs each id below the smallest neighbour of its neighbourhood: first for larger neighbours
    (large star), then for smaller ones (small star). Minima are combined before the shuffle, and the joins that
    bring them back may be split by the optimizer, so a hub is not gathered in one task. The table is written
    after each round; rounds grow with the logarithm of the longest path. Nulls and loops are ignored.
    """
    stars = settle(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u > v").distinct())
    state = None
    while True:
        both = stars.select(F.col("u"), F.col("v")).union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        stars = settle(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(least.select("u", F.col("m").alias("v"))).distinct())
        now = stars.agg(F.count("*"), F.countDistinct("u"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == state and now[0] == now[1]:
            break
        state = now
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
