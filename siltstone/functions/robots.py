"""Crawler rules: robots.txt as rows of rules, and verdicts by longest match, in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Agents whose groups concern crawlers of this kind.
AI_AGENTS = ("claudebot", "claude-web", "claude-searchbot", "anthropic-ai", "gptbot", "chatgpt-user", "oai-searchbot", "ccbot", "google-extended", "perplexitybot", "cohere-ai", "bytespider", "ai2bot", "meta-externalagent")


def directives(robots: DataFrame, domain: str = "domain", body: str = "body") -> DataFrame:
    """domain, line, key, value, group: the agent and rule lines; group counts the groups up to a line, 0 before the first.

    An agent line opens a group unless the last agent or rule line was an agent line too.
    """
    line = F.trim(F.regexp_replace("text", "#.*$", ""))
    rows = robots.select(F.col(domain).alias("domain"), F.posexplode(F.split(body, r"\r?\n")).alias("line", "text"))
    rows = rows.select("domain", "line", F.lower(F.regexp_extract(line, r"^([A-Za-z-]+)\s*:\s*(.*)$", 1)).alias("key"), F.trim(F.regexp_extract(line, r"^([A-Za-z-]+)\s*:\s*(.*)$", 2)).alias("value"))
    rows = rows.filter(F.col("key").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("domain").orderBy("line")
    opens = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    return rows.withColumn("group", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def applicable(lines: DataFrame) -> DataFrame:
    """domain, agent, kind, rule: the rules that count for a domain.

    Groups that name one of AI_AGENTS, merged under the first such agent, stand alone where there are any; else the groups for *.
    """
    agents = lines.filter("key = 'user-agent'").select("domain", "group", "line", F.lower("value").alias("agent"))
    agents = agents.withColumn("ai", F.col("agent").isin(*AI_AGENTS)).filter("ai OR agent = '*'")
    per = Window.partitionBy("domain")
    agents = agents.withColumns({"any_ai": F.max("ai").over(per), "first": F.min(F.when(F.col("ai"), F.struct("line", "agent"))).over(per)["agent"]})
    named = agents.filter("ai = any_ai").select("domain", "group", F.when(F.col("ai"), F.col("first")).otherwise(F.lit("*")).alias("agent")).distinct()
    rules = lines.filter("key != 'user-agent' AND value != '' AND group > 0").select("domain", "group", F.col("key").alias("kind"), F.col("value").alias("rule"))
    return named.join(rules, ["domain", "group"]).select("domain", "agent", "kind", "rule").distinct()


def path_matches(rule: Column, path: Column) -> Column:
    """Whether a rule covers a path: a prefix, with * for any run and a final $ for the end; an empty rule covers nothing."""
    anchored = F.endswith(rule, F.lit("$"))
    body = F.when(anchored, F.substr(rule, F.lit(1), F.length(rule) - 1)).otherwise(rule)
    quoted = F.regexp_replace(F.regexp_replace(body, r"[.+?^${}()|\[\]\\]", r"\\$0"), r"\*", ".*")
    pattern = F.concat(F.lit("^"), quoted, F.when(anchored, F.lit(r"\z")).otherwise(F.lit("")))
    plain = ~rule.contains("*") & ~anchored
    return F.when(rule == "", F.lit(False)).when(plain, F.startswith(path, rule)).otherwise(F.regexp_like(path, pattern))


def verdicts(requests: DataFrame, rules: DataFrame, domain: str = "domain", path: str = "path") -> DataFrame:
    """domain, path, disallowed, ai_agent for every distinct request: the longest matching rule wins, allow on a tie; without rules, allowed.

    requests join rules by domain, so a path meets its own site's rules only.
    """
    asked = requests.select(F.col(domain).alias("domain"), F.col(path).alias("path")).distinct()
    hit = asked.join(rules, "domain").filter(path_matches(F.col("rule"), F.col("path")))
    best = hit.groupBy("domain", "path").agg(
        F.max(F.when(F.col("kind") == "allow", F.length("rule"))).alias("allow"), F.max(F.when(F.col("kind") == "disallow", F.length("rule"))).alias("disallow"), F.max("agent").alias("agent")
    )
    no = F.coalesce(F.col("disallow") > F.coalesce("allow", F.lit(-1)), F.lit(False))
    return asked.join(best, ["domain", "path"], "left").select("domain", "path", no.alias("disallowed"), F.when(no & (F.col("agent") != "*"), F.col("agent")).alias("ai_agent"))


def fresh(cache: DataFrame, at: Column, hours: float) -> DataFrame:
    """Rows of a cache that are at most so many hours old."""
    return cache.filter(F.col("fetched_at") >= at - F.make_dt_interval(hours=F.lit(int(hours))))


def versions(cache: DataFrame, hours: float) -> DataFrame:
    """robots (a key for directives), domain, body, since, until and bucket of every cached file: it counts from its fetch until the next of its domain, and no longer than so many hours.

    A file lies in two buckets of that length of time, one of which has the bucket of any time it counts for. Files without a body, of failed fetches, count too, and have no rules.
    """
    seconds = int(hours * 3600)
    v = cache.select("domain", "body", F.col("fetched_at").alias("since")).distinct()
    v = v.withColumn("until", F.lead("since").over(Window.partitionBy("domain").orderBy("since", "body")))
    v = v.withColumn("robots", F.concat_ws("@", "domain", F.unix_micros("since")))
    first = F.floor(F.unix_seconds("since") / max(seconds, 1))
    return v.withColumn("bucket", F.explode(F.array(first, first + 1)))


def with_version(requests: DataFrame, found: DataFrame, hours: float, domain: str = "domain", ts: str = "ts") -> DataFrame:
    """requests with robots, the key of the file that counts for their domain at their time; null where none is fresh."""
    seconds = max(int(hours * 3600), 1)
    v = found.select("robots", F.col("domain").alias("__domain"), "since", "until", "bucket")
    r = requests.withColumn("__bucket", F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds))
    at, end = F.col(ts).cast("timestamp"), F.col("since") + F.make_dt_interval(secs=F.lit(seconds))
    counts = (F.col(domain) == F.col("__domain")) & (F.col("__bucket") == F.col("bucket")) & (F.col("since") <= at) & (at <= end) & (F.col("until").isNull() | (at < F.col("until")))
    return r.join(v, counts, "left").drop("__domain", "since", "until", "bucket", "__bucket")
