"""The gate before a fetch: one plan from events to decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import robots, shell, urls
from ..operators import events, history

LABEL = "[web-hygiene]"
DECISION = "permission string, reason string, context string, updated_command string"


def reminder(lines: Column) -> Column:
    """Messages in one block; null without any."""
    return F.when(F.size(lines) > 0, F.concat(F.lit("<system-reminder>\n"), F.array_join(lines, "\n"), F.lit("\n</system-reminder>")))


def message(*parts: Column | str) -> Column:
    return F.concat(F.lit(LABEL + " "), *(F.lit(p) if isinstance(p, str) else p for p in parts))


def call_reminder(count: Column) -> Column:
    return F.when(count >= 2, message("web tool call #", count, " of this session: apply the research rules to every source."))


def gate(calls: DataFrame, config: Config, blocklist: DataFrame, robots_cache: DataFrame, mode: str = "enforce") -> DataFrame:
    """calls (id, ts, session_id, tool_name, tool_input) with route and the columns of DECISION.

    An adversarial url is denied, a blocked domain asks, a shell command that fetches is rewritten;
    other findings are context. robots_cache: domain, body and, where files are fetched again, fetched_at; then the
    file counts that was the last of its domain at the time of the call, as long as it is fresh. Searches, inspected fetches and rewritten commands count as calls
    of their session; a denied url does not.
    """
    e = calls.withColumn("url", events.url_or_query(F.col("tool_input"))).withColumn("route", events.route(F.col("tool_name"), F.col("url"), mode))
    e = e.withColumns({"__f": urls.url_fields("url"), "__m": shell.matched(F.when(F.col("route") == "shell", F.try_element_at(F.col("tool_input"), F.lit("command"))))})
    e = e.withColumn("__i", urls.inspect(F.col("url"), F.col("__f")))
    refused = (F.col("route") == "inspect") & F.col("__i.refuse").isNotNull()
    counted = (F.col("route") == "search") | (F.col("route") == "inspect") & ~refused | F.col("__m.matched")
    e = e.withColumns({"__counted": counted, "domain": F.when(F.col("route") == "inspect", F.col("__f.host")), "__session": F.coalesce("session_id", F.lit("unknown"))})
    e = history.running(e, ["__session"], F.coalesce(F.col("__counted"), F.lit(False)).cast("long"), "call_count", ["ts", "id"])
    e = history.blocked(e, blocklist)
    path = F.concat(F.col("__f.path"), F.when(F.col("__f.query") != "", F.concat(F.lit("?"), F.col("__f.query"))).otherwise(F.lit("")))
    e = e.withColumn("__path", path)
    if "fetched_at" in robots_cache.columns:
        hours = config.thresholds["robots_cache_ttl_hours"]
        files = robots.versions(robots_cache, hours)
        e = robots.with_version(e, files, hours)
        files = files.select("robots", "body").distinct()
    else:
        e, files = e.withColumn("robots", F.col("domain")), robots_cache.select(F.col("domain").alias("robots"), "body")
    rules = robots.applicable(robots.directives(files, "robots"))
    verdicts = robots.verdicts(e.filter("robots IS NOT NULL"), rules, "robots", "__path").withColumnsRenamed({"domain": "robots", "path": "__path"})
    e = e.join(verdicts, ["robots", "__path"], "left")

    warnings = F.transform(F.col("__i.warnings"), lambda w: F.concat(F.lit(LABEL + " "), w))
    disallowed = F.when(F.col("disallowed"), F.when(F.col("ai_agent").isNotNull(), message("robots.txt of ", F.col("domain"), " disallows ", F.col("__path"), " for the crawler group ", F.col("ai_agent"))).otherwise(message("robots.txt of ", F.col("domain"), " disallows ", F.col("__path"), " for all agents")))
    blocked = F.col("block_domain").isNotNull()
    lines = F.concat(warnings, F.array_compact(F.array(call_reminder(F.col("call_count")), F.when(~blocked, disallowed))))
    shell_lines = F.array_compact(F.array(
        F.when(F.col("__m.matched"), message("web fetch via ", F.array_join("__m.bins", ", "), F.when(F.col("__m.interpreter"), F.lit(" (inline code)")).otherwise(F.lit("")), "; its output is piped through the sanitiser.")),
        F.when(F.col("__m.matched") & F.col("__m.writes_to_file"), message("this command writes the response to a file, which the sanitiser does not see.")),
        F.when(F.col("__m.parse_failed") & F.col("__m.possible_fetch"), message("the command could not be read (", F.col("__m.reason"), ") and runs unwrapped.")),
    ))
    r = F.col("route")
    permission = F.when((r == "deny") | refused, F.lit("deny")).when((r == "inspect") & blocked, F.lit("ask"))
    reason = (
        F.when(r == "deny", message("strict mode refuses ", F.col("tool_name"), ": fetch through the sanitised shell path instead: curl -sL ", F.when(F.col("url") == "", F.lit("<url>")).otherwise(F.col("url"))))
        .when(refused, message("fetch refused: ", F.col("__i.refuse")))
        .when((r == "inspect") & blocked, message(F.col("domain"), " is on the ", F.col("block_source"), " blocklist (", F.col("block_reason"), ")"))
    )
    context = F.when(r == "search", reminder(F.array_compact(F.array(call_reminder(F.col("call_count")))))).when((r == "inspect") & ~refused, reminder(lines)).when(r == "shell", reminder(shell_lines))
    return e.select(*calls.columns, "url", "route", permission.alias("permission"), reason.alias("reason"), context.alias("context"), F.col("__m.rewritten").alias("updated_command"))
