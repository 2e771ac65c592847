"""Command line: sanitise a text from standard input, replay a fetch log, or report its size.

    python -m siltstone.cli [--url=URL] < page
    python -m siltstone.cli replay --log=PATH --since=DATE [--version=V] [--config=FILE]
    python -m siltstone.cli status --log=PATH --blocklist=PATH --sessions=PATH
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import VERSION, Config, load
from .operators import replay
from .plans.score import piped
from .schema import BLOCKLIST, FETCH_LOG, SESSIONS
from .session import ship
from .sources import tables


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="siltstone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", nargs="?", choices=("sanitise", "replay", "status"), default="sanitise")
    p.add_argument("--url", default="stdin")
    p.add_argument("--config")
    p.add_argument("--log")
    p.add_argument("--blocklist")
    p.add_argument("--sessions")
    p.add_argument("--since")
    p.add_argument("--version")
    a = p.parse_args(argv)
    missing = [n for n in {"replay": ("log", "since"), "status": ("log", "blocklist", "sessions")}.get(a.command, ()) if getattr(a, n) is None]
    if missing:
        p.error(f"{a.command} needs " + ", ".join(f"--{n}" for n in missing))
    return a


def replay_report(log: DataFrame, config: Config, since: str, version: str | None) -> DataFrame:
    """One row, report: the drift, the signal counts and the signals no longer configured, as JSON."""
    rows = log.filter(F.col("fetched_at") >= F.lit(since).cast("timestamp"))
    mine = rows if version is None else rows.filter(F.col("sanitiser_version") == version)
    drift = replay.drift_counts(rows, config, version=version).select(F.struct("*").alias("drift"), F.lit(None).alias("signals"))
    counts = replay.signal_counts(mine, config).agg(F.lit(None).alias("drift"), F.sort_array(F.collect_list(F.struct("signal", "rows", "current"))).alias("signals"))
    both = drift.select(F.to_json("drift").alias("drift"), F.lit(None).cast("string").alias("signals")).unionByName(counts.select(F.lit(None).cast("string").alias("drift"), F.to_json("signals").alias("signals")))
    return both.agg(F.concat(F.lit(f'{{"since": "{since}", "sanitiser_version_now": "{VERSION}", "drift": '), F.max("drift"), F.lit(', "signals": '), F.max("signals"), F.lit("}")).alias("report"))


def run(spark: SparkSession, a: argparse.Namespace, text: str = "") -> str:
    ship(spark)
    config = load(a.config) if a.config else Config()
    if a.command == "replay":
        return replay_report(tables.stored(spark, a.log, FETCH_LOG), config, a.since, a.version).first().report
    if a.command == "status":
        counts = replay.status(*(tables.stored(spark, p, s) for p, s in ((a.log, FETCH_LOG), (a.blocklist, BLOCKLIST), (a.sessions, SESSIONS))))
        return counts.select(F.to_json(F.struct(F.lit(VERSION).alias("sanitiser_version"), "*")).alias("j")).first().j
    return piped(spark.createDataFrame([(a.url, text)], "url string, body string"), config).first().output


def main() -> None:
    a = arguments(sys.argv[1:])
    text = sys.stdin.read() if a.command == "sanitise" else ""
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    print(run(spark, a, text))


if __name__ == "__main__":
    main()
