"""Connected components of a table of links, by alternating large and small stars.

Every step rewrites links towards the smallest neighbour and is a grouped minimum joined back on its
key, so a node with very many links is split like any skewed join key. No link leaves the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.plans.staging import stage


def _large(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node that has a link to another: the smallest node it can reach.

    ``links`` has two columns of one ordered type; direction, repeats and loops do not matter.
    """
    links = stage(links.toDF("u", "v").filter("u <> v"), "links")
    before = None
    while True:
        links = stage(_small(_large(links)), "links")
        now = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before or not now[0]:
            break
        before = now
    star = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.union(star.select("root", "root").distinct())
