"""Replaying logged decisions against a configuration, and status counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from .signals import aborts, with_tiers


def logged_signals(log: DataFrame) -> DataFrame:
    """log with fired: the stored names, empty ones dropped."""
    return log.withColumn("fired", F.filter(F.split(F.coalesce("risk_signals", F.lit("")), ","), lambda s: s != ""))


def decisions(log: DataFrame, config: Config, since: str | None = None, version: str | None = None) -> DataFrame:
    """Logged rows since a time, with would_abort under the configuration and drift: would_abort_now_only, used_to_abort_only, unchanged, legacy_unknown; null for rows of other versions."""
    rows = log if since is None else log.filter(F.col("fetched_at") >= F.lit(since).cast("timestamp"))
    rows = with_tiers(logged_signals(rows), config).withColumn("would_abort", aborts(config))
    drift = F.when(F.col("abort_decision").isNull(), F.lit("legacy_unknown")).when(F.col("would_abort") & ~F.col("abort_decision"), F.lit("would_abort_now_only")).when(~F.col("would_abort") & F.col("abort_decision"), F.lit("used_to_abort_only")).otherwise(F.lit("unchanged"))
    return rows.withColumn("drift", drift if version is None else F.when(F.col("sanitiser_version") == version, drift))


def drift_counts(log: DataFrame, config: Config, since: str | None = None, version: str | None = None) -> DataFrame:
    """One row: rows_examined (of any version), rows_with_abort_decision, and a count of each drift."""
    kinds = ("would_abort_now_only", "used_to_abort_only", "unchanged", "legacy_unknown")
    d = decisions(log, config, since, version)
    return d.agg(F.count(F.lit(1)).alias("rows_examined"), *(F.count_if(F.col("drift") == k).alias(k) for k in kinds)).withColumn("rows_with_abort_decision", F.col("rows_examined") - F.col("legacy_unknown"))


def signal_counts(log: DataFrame, config: Config) -> DataFrame:
    """signal, rows, current: how often each logged signal fired, and whether it is still configured."""
    each = logged_signals(log).select(F.explode("fired").alias("signal"))
    return each.groupBy("signal").agg(F.count(F.lit(1)).alias("rows")).withColumn("current", F.col("signal").isin(*config.tiers))


def removed_signals(log: DataFrame, config: Config) -> DataFrame:
    """signal: logged signals that the configuration no longer has."""
    known = F.broadcast(config.tier_table(log.sparkSession).select("signal"))
    return logged_signals(log).select(F.explode("fired").alias("signal")).distinct().join(known, "signal", "left_anti")


def status(log: DataFrame, blocklist: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: fetch_log_rows, blocklist_size, sessions."""
    tables = {"fetch_log_rows": log, "blocklist_size": blocklist, "sessions": sessions}
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    return counts.agg(*(F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in tables))
