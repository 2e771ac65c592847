"""Connected components of a link table, by alternating large-star and small-star steps.

Links never leave the cluster: every round is a few joins whose result is written to the shared
folder, and only a row count and a checksum come to the driver. A hub's links lie under one key of
those joins; the table of least neighbours is written first, so both sides are plain scans and
Spark's skew join can split the hub's side, which it does not do above an aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, kept


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root for every node in links whose root, the smallest node reachable, is another one.

    Links are undirected; null ends and loops are ignored; repeated links count once.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    stars = kept(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(lo.alias("lo"), hi.alias("hi")).distinct(), "links")
    last = None
    while True:
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        last = now
        both = stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        large = kept(both.join(least, "u").filter("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct(), "large", (least,))
        small = kept(large.groupBy("hi").agg(F.min("lo").alias("m")), "small")
        near = large.join(small, "hi").select(F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")))).alias("s"))
        stars = kept(near.select("s.lo", "s.hi").filter("lo < hi").distinct(), "stars", (stars, large, small))
