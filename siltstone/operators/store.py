"""Stored tables: upserts, reconciliation with a block-list file, retention, and additive schema changes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BLOCKLIST


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """current with changes merged in: of each key the row with the latest `at` stays, a change before a current row of the same time."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(at), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n", "__new")


def session_table(calls: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """session_id, web_tool_call_count, started_at: calls added to the counts of earlier sessions."""
    new = calls.groupBy("session_id").agg(F.count(F.lit(1)).alias("web_tool_call_count"), F.min("ts").alias("started_at"))
    both = new if sessions is None else sessions.unionByName(new)
    return both.groupBy("session_id").agg(F.sum("web_tool_call_count").alias("web_tool_call_count"), F.min("started_at").alias("started_at"))


def reconcile(current: DataFrame, file_entries: DataFrame) -> DataFrame:
    """The block list after the file's entries replaced all user rows; an entry for a domain already listed turns that row into a user row that keeps its added_at."""
    columns = [f.split()[0] for f in BLOCKLIST.split(", ")]
    entries = file_entries.select("domain", "reason", F.col("added_at").cast("timestamp").alias("added_at"), F.col("expires_at").cast("timestamp").alias("expires_at"))
    entries = entries.withColumn("__n", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc_nulls_last("added_at"), "reason"))).filter("__n = 1").drop("__n")
    others = current.filter("source != 'user'")
    own = others.select("domain", F.col("added_at").alias("__added"), F.col("session_id").alias("__session"))
    user = entries.join(own, "domain", "left").select("domain", "reason", F.coalesce("__added", "added_at").alias("added_at"), F.lit("user").alias("source"), "expires_at", F.col("__session").alias("session_id"))
    return others.join(entries.select("domain"), "domain", "left_anti").select(*columns).unionByName(user.select(*columns))


def exported(blocklist: DataFrame) -> DataFrame:
    """What a new block-list file holds: all but the sessions' own rows."""
    return blocklist.filter("source != 'session'").select("domain", "reason", "added_at", "source", "expires_at")


def pruned(table: DataFrame, column: str, now: Column, days: float) -> DataFrame:
    """table without rows from before the retention period; a period that is no positive number keeps all."""
    if not math.isfinite(days) or days <= 0:
        return table
    return table.filter(F.col(column).isNull() | (F.col(column) >= now - F.make_dt_interval(secs=F.lit(float(days) * 86400))))


def unexpired(blocklist: DataFrame, now: Column) -> DataFrame:
    return blocklist.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def prune_due(last: Column, now: Column) -> Column:
    """Whether a day has passed since the last pruning."""
    return last.isNull() | (now - last >= F.make_dt_interval(days=F.lit(1)))


def as_schema(df: DataFrame, schema: str) -> DataFrame:
    """df in a table's columns and types; columns that it lacks are null."""
    wanted = [c.rsplit(" ", 1) for c in schema.split(", ")]
    return df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in wanted))
