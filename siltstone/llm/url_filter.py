"""URL filter: allow and block rules in one trie over reversed host labels, then path segments.

A rule is a host and a path. It fits the host itself and all its subdomains when the url's path
starts with the rule's; of the rules that fit, the longest (code points of host and path, then of
host) wins, and of equal ones block. The trie is built on the driver and broadcast; max_rules
bounds its size. A longer rule list goes through an exact shuffle join instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fresh, ship, table

#: About 1.1 KB a rule in a worker's trie: it stays under 60 MB.
MAX_RULES = 50_000

Rule = tuple[str, str, str]  # host, path, allow or block


class Trie:
    """Host labels from the right, then whole path segments; a rule's last piece may be part of a segment."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})  # None: from the host to its paths
            *segments, part = path.split("/")
            for segment in segments:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, {})  # None: the pieces of a segment with which rules end
            old = ends.get(part)
            if old is None or verdict == "block":
                ends[part] = (len(host) + len(path), len(host), verdict == "block", host + path, verdict)

    def match(self, host: str, path: str) -> tuple | None:
        """The winning rule's (length, host length, blocks, text, verdict)."""
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            at = node.get(None)
            for segment in segments if at else ():
                for part, rule in at.get(None, {}).items():
                    if segment.startswith(part) and (best is None or rule > best):
                        best = rule
                at = at.get(segment)
                if at is None:
                    break
        return best


def url_parts(url: Column) -> dict[str, Column]:
    """host: after the first :// up to / ? # or the end, A-Z in lower case; path: from there up to ? or #."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))
    return {"host": F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)}


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, url: str = "url", default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """pages with host, path, rule (null where none fits) and verdict (the rule's, else default).

    A null url, or one without ://, has empty host and path and fits no rule. Columns of pages with
    those four names are replaced. rules: a list, or a DataFrame of host, path, verdict; beyond
    max_rules it is joined, not broadcast.
    """
    spark = pages.sparkSession
    ship(spark)
    pages = pages.withColumns(url_parts(pages[url]))
    if not isinstance(rules, DataFrame):
        if len(rules) > max_rules:
            return judge_by_join(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), default)
    else:
        if rules.count() > max_rules:
            return judge_by_join(pages, rules, default)
        rules = [tuple(r) for r in rules.select("host", "path", "verdict").collect()]
    trie = spark.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def found(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        at = trie.value
        for hosts, paths in parts:
            got = [at.match(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": [g and g[3] for g in got], "verdict": [g[4] if g else default for g in got]}, dtype=object)

    name = fresh("__found", *pages.columns)
    return pages.withColumn(name, found("host", "path")).select(*pages.drop("rule", "verdict").columns, F.col(name)["rule"].alias("rule"), F.col(name)["verdict"].alias("verdict"))


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts without a broadcast: every (suffix of the host, beginning of the path) once, joined to the rules by both, so a host with many rules and urls meets no more than its own.

    Beginnings are those with the length of some rule's path; their lengths are few and collected, up to the longest path of a rule.
    """
    r = rules.groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict"))["verdict"].alias("v")).select(F.col("host").alias("rhost"), F.col("path").alias("rpath"), "v")
    long = F.array(*(F.lit(x[0]) for x in r.select(F.length("rpath")).distinct().collect()))
    labels = F.split("host", r"\.")
    seen = pages.select("host", "path").distinct()
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("rhost")
    start = F.explode(F.transform(F.filter(long, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("rpath")
    fits = seen.select("host", "path", suffix).join(r.select("rhost").distinct(), "rhost", "left_semi").select("*", start).join(r, ["rhost", "rpath"])
    order = F.struct((F.length("rhost") + F.length("rpath")).alias("l"), F.length("rhost").alias("h"), (F.col("v") == "block").alias("b"), F.concat("rhost", "rpath").alias("rule"), F.col("v").alias("verdict"))
    name = fresh("__best", *pages.columns)
    best = fits.groupBy("host", "path").agg(F.max(order).alias(name))
    return pages.join(best, ["host", "path"], "left").select(*pages.drop("rule", "verdict").columns, F.col(name)["rule"].alias("rule"), F.coalesce(F.col(name)["verdict"], F.lit(default)).alias("verdict"))


#: Fixed values of the query.
RULES: list[Rule] = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH r(rhost, rpath, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, row_number() OVER () AS n FROM pages),
p AS (SELECT page_id, n, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
b AS (SELECT n, arg_max(rhost || rpath, (length(rhost) + length(rpath)) * 1000 + length(rhost)) AS rule, arg_max(v, (length(rhost) + length(rpath)) * 1000 + length(rhost)) AS v
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN b USING (n)
"""
