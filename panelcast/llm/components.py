"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.session import stored


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step: links ``(hi, lo)`` move towards
    the smallest node around without parting any component."""
    both = links.union(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("node"), F.least("hi", "m").alias("m"))
    large = (both.join(least, both.hi == least.node).where("lo > hi")
             .select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct())
    least = large.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("node"), "m")
    near = large.join(least, large.hi == least.node)
    return (near.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(least.select(F.col("node").alias("hi"), F.col("m").alias("lo"))).distinct())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node that has a link; ``root`` is the smallest
    node of its component.

    Alternates star steps until nothing moves; each round is written to the
    shared folder, and only a checksum of the links comes to the driver."""
    now = stored(links.where(F.col(a) != F.col(b))
                 .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "links")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = stored(_stars(now), "links")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
