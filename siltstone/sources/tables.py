"""Sources and sinks: events, whole texts, block-list files, logs, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT


def events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON-lines events in EVENT's columns; malformed lines are dropped."""
    reader = (spark.readStream if streaming else spark.read).schema(EVENT).option("mode", "DROPMALFORMED")
    return reader.json(path)


def parsed_events(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Events from a column of JSON, and the lines that are none, for a dead-letter table."""
    p = lines.withColumn("__e", F.from_json(column, EVENT, {"mode": "PERMISSIVE"})).withColumn("__ok", F.try_parse_json(F.col(column)).isNotNull() & F.col(column).rlike(r"^\s*\{"))
    return p.filter("__ok").select("__e.*"), p.filter("NOT coalesce(__ok, false)").select(F.col(column).alias("line"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, body: one row per file, gzipped ones unpacked."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def blocklist_file(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a block-list file; no rows where it is malformed or has none."""
    entry = "array<struct<domain:string,reason:string,added_at:timestamp,source:string,expires_at:timestamp>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"version int, entries {entry}").alias("f"))
    return raw.select(F.explode("f.entries").alias("e")).select("e.*").withColumn("session_id", F.lit(None).cast("string")).filter("domain IS NOT NULL")


def write_blocklist_file(blocklist: DataFrame, path: str, only_if_missing: bool = True) -> bool:
    """One JSON document of all entries but the sessions', unless the file is there already; whether it was written.

    The format is one document, so it is put together in one task, which a block list is small enough for.
    """
    spark = blocklist.sparkSession
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    if only_if_missing and file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file):
        return False
    e = blocklist.filter("source != 'session'").select(F.struct("domain", "reason", "added_at", "source", "expires_at").alias("e"))
    e.agg(F.to_json(F.struct(F.lit(1).alias("version"), F.sort_array(F.collect_list("e")).alias("entries"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return True


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table; columns that later versions added are null in older files."""
    return spark.read.schema(schema).parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows to a table partitioned by day."""
    rows.withColumn("day", F.to_date("fetched_at")).write.mode("append").partitionBy("day").parquet(path)


def append_jsonl(rows: DataFrame, path: str, with_bodies: bool = False) -> None:
    """Append rows as JSON lines; bodies only where they are asked for."""
    (rows if with_bodies else rows.drop("body", "sanitised")).write.mode("append").json(path)


def decision_json(permission: Column, reason: Column, context: Column, command: Column) -> Column:
    """One JSON decision per event; null where there is nothing to say."""
    inner = F.struct(permission.alias("permissionDecision"), reason.alias("permissionDecisionReason"), context.alias("additionalContext"), F.when(command.isNotNull(), F.struct(command.alias("command"))).alias("updatedInput"))
    return F.when(F.coalesce(permission, reason, context, command).isNotNull(), F.to_json(F.struct(inner.alias("hookSpecificOutput"))))


def manifest(bodies: DataFrame) -> DataFrame:
    """path, raw_bytes, sha256 of whole texts."""
    return bodies.select("path", F.octet_length("body").cast("long").alias("raw_bytes"), F.sha2("body", 256).alias("sha256"))
