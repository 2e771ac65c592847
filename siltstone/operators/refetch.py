"""Refetches as tables: bounded bodies, and redirect chains whose every hop is checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

#: The largest body, in bytes, and the most requests of one chain.
MOST_BYTES, MOST_REQUESTS = 8 * 1024 * 1024, 6


def bounded(body: Column, declared: Column | None = None, most: int = MOST_BYTES) -> Column:
    """A body cut at the cap; empty where its declared length is beyond it."""
    cut = F.when(F.octet_length(body) <= most, body).otherwise(F.decode(F.substring(F.encode(body, "utf-8"), 1, most), "utf-8"))
    return cut if declared is None else F.when(declared > most, F.lit("")).otherwise(cut)


def chains(hops: DataFrame) -> DataFrame:
    """url, status, redirect_hops, final_url, error: one row per refetched url.

    hops: url, hop (0 for the url itself), target, status. A chain ends at its first target that must
    not be requested, at its first status that is no redirect, or after MOST_REQUESTS requests.
    """
    h = hops.withColumn("f", urls.url_fields("target")).withColumn("refusal", urls.refetch_refusal(F.col("f.scheme"), F.col("f.host")))
    ends = F.col("refusal").isNotNull() | ~F.col("status").between(300, 399) | (F.col("hop") >= MOST_REQUESTS - 1)
    step = F.struct("hop", "target", "status", "refusal")
    found = h.groupBy("url").agg(F.min(F.when(ends, step)).alias("end"), F.max(step).alias("last"))
    end = F.coalesce("end", "last")
    refusal = end["refusal"]
    error = F.when(refusal.isNotNull() & (end["hop"] == 0), refusal).when(refusal == "refused_scheme", F.lit("refused_redirect_scheme")).when(refusal.isNotNull(), F.lit("refused_redirect_to_private_host"))
    return found.select("url", F.when(refusal.isNull(), end["status"]).alias("status"), F.when(refusal.isNull(), end["hop"]).otherwise(F.greatest(end["hop"] - 1, F.lit(0))).alias("redirect_hops"), F.when(refusal.isNull(), end["target"]).alias("final_url"), error.alias("error"))


def last_of_each(refetches: DataFrame, key: str = "url") -> DataFrame:
    """One refetch (url, body, content_type, redirect_hops, and fetched_at if they have it) of each url, or other key: the last, and of those of one time always the same."""
    time = [F.desc_nulls_last("fetched_at")] if "fetched_at" in refetches.columns else []
    order = Window.partitionBy(key).orderBy(*time, "redirect_hops", "content_type", F.xxhash64("body"))
    return refetches.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def corroboration(claims: DataFrame, claim: str = "claim", origin: str = "origin") -> DataFrame:
    """claim, origins: how many different organisations stand behind each claim."""
    return claims.groupBy(claim).agg(F.count_distinct(origin).alias("origins"))
