"""What earlier fetches of a session say: running counts, distinct urls in a window, near-duplicates, promotions, block lists.

Windows are keyed by session and domain. Window frames that look back over time are cut into
buckets of the window's length, so that one long session does not become one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, urls

#: A block list up to so many rows is broadcast.
BROADCAST_ROWS = 200_000


#: Seconds of a bucket of running counts.
BUCKET = 3600


def bucket_of(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds)


def running(df: DataFrame, keys: list[str], amount: Column, name: str, order: list, seconds: int = BUCKET, inclusive: bool = True) -> DataFrame:
    """df with the running sum of amount per keys, in the order given (time first), itself included or not.

    Sums of buckets of time are added up first, and rows within their bucket: a key with many rows
    is as many windows as it has buckets, and only the buckets' sums meet in one.
    """
    time = order[0]
    d = df.withColumns({"__b": bucket_of(time, seconds), "__amount": amount.cast("long")})
    totals = d.groupBy(*keys, "__b").agg(F.sum("__amount").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, "__b"])), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    same = F.lit(True)
    for i, k in enumerate([*keys, "__b"]):
        same = same & d[k].eqNullSafe(totals[f"__k{i}"])
    within = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return d.join(totals, same).withColumn(name, F.col("__before") + F.coalesce(F.sum("__amount").over(within), F.lit(0))).select(*df.columns, name)


def session_counts(log: DataFrame) -> DataFrame:
    """log with call_count: how many calls of its session came so far, itself included."""
    return running(log, ["session_id"], F.lit(1), "call_count", ["ts", "id"])


def abort_counts(log: DataFrame) -> DataFrame:
    """log with aborts_so_far of its session and domain, itself included."""
    return running(log, ["session_id", "domain"], F.coalesce(F.col("abort_decision"), F.lit(False)).cast("long"), "aborts_so_far", ["ts", "id"])


def distinct_urls(log: DataFrame, minutes: float) -> DataFrame:
    """log with distinct_urls: different urls of its session and domain in the minutes before it, itself excluded.

    A row counts for later ones until its url comes again or the window is over, so the number is
    a running sum of rows minus a running sum of ends: no set is kept and nothing is joined to
    itself. The url's next coming is looked for in a row's bucket of time and the next one.
    """
    seconds = max(int(minutes * 60), 1)
    window = F.make_dt_interval(secs=F.lit(float(minutes) * 60))
    b = bucket_of("ts", seconds)
    rows = log.select("*", F.explode(F.array(F.struct(b.alias("b"), F.lit(True).alias("live")), F.struct((b - 1).alias("b"), F.lit(False).alias("live")))).alias("__at"))
    again = Window.partitionBy("session_id", "domain", "url", "__at.b").orderBy("ts", "id")
    rows = rows.withColumns({"__next": F.lead(F.struct("ts", "id")).over(again), "__until": F.col("ts") + window}).filter("__at.live")
    first = F.when(F.col("__next.ts") <= F.col("__until"), F.col("__next")).otherwise(F.struct(F.col("__until").alias("ts"), F.lit(2**63 - 1).alias("id")))
    kept = [F.col(c) for c in log.columns]
    starts = rows.select(*kept, F.col("ts").alias("__ts"), F.col("id").cast("long").alias("__id"), F.lit(1).alias("__d"))
    ends = rows.select(*(F.col(c) if c in ("session_id", "domain") else F.lit(None).cast(log.schema[c].dataType).alias(c) for c in log.columns), first["ts"].alias("__ts"), first["id"].cast("long").alias("__id"), F.lit(-1).alias("__d"))
    both = running(starts.unionByName(ends), ["session_id", "domain"], F.col("__d"), "distinct_urls", ["__ts", "__id", F.desc("__d")], seconds, inclusive=False)
    return both.filter("__d = 1").select(*log.columns, "distinct_urls")


def near_duplicates(log: DataFrame, minutes: float, distance: Column | int, recent: int = 200) -> DataFrame:
    """log with near_duplicate_of: the latest other url among the last `recent` fetches of its session and domain in the minutes before it whose simhash is near; null where none is.

    Each row goes to its bucket of time and, as history only, to the next one.
    """
    seconds = int(minutes * 60)
    bucket = bucket_of("ts", seconds)
    rows = log.select("*", F.explode(F.array(F.struct(bucket.alias("b"), F.lit(True).alias("live")), F.struct((bucket + 1).alias("b"), F.lit(False).alias("live")))).alias("__at"))
    before = Window.partitionBy("session_id", "domain", "__at.b").orderBy("ts", "id").rowsBetween(-recent, -1)
    rows = rows.withColumn("__seen", F.collect_list(F.struct("ts", "url", "simhash")).over(before)).filter("__at.live")
    near = F.filter(F.reverse("__seen"), lambda s: (s["ts"] >= F.col("ts") - F.make_dt_interval(secs=F.lit(seconds))) & (s["url"] != F.col("url")) & (hashing.hamming(s["simhash"], F.col("simhash")) <= distance))
    return rows.withColumn("near_duplicate_of", F.try_element_at(near, F.lit(1))["url"]).select(*log.columns, "near_duplicate_of")


def promotions(log: DataFrame, repeats: int, hours: float = 24, search_domain: str = "websearch") -> DataFrame:
    """domain, session_id, aborts, added_at, expires_at, reason, source: block-list entries for domains that a session aborted often enough.

    The last abort of each session and domain decides; searches and unknown domains are never promoted.
    """
    rows = abort_counts(log).filter(F.col("abort_decision") & F.col("session_id").isNotNull() & ~F.col("domain").isin(search_domain, "unknown")).filter(F.col("aborts_so_far") >= repeats)
    last = rows.groupBy("session_id", "domain").agg(F.max(F.struct("ts", "id", "aborts_so_far", "risk_signals")).alias("l"))
    reason = F.concat(F.col("l.aborts_so_far"), F.lit(" aborted fetches this session (last signals: "), F.when(F.coalesce("l.risk_signals", F.lit("")) == "", F.lit("none")).otherwise(F.col("l.risk_signals")), F.lit(")"))
    return last.select("domain", "session_id", F.col("l.aborts_so_far").alias("aborts"), F.col("l.ts").alias("added_at"), (F.col("l.ts") + F.make_dt_interval(hours=F.lit(int(hours)))).alias("expires_at"), reason.alias("reason"), F.lit("session").alias("source"))


def blocked(fetches: DataFrame, blocklist: DataFrame, key: str = "id") -> DataFrame:
    """fetches (key, domain, session_id, ts) with block_domain, block_reason, block_source of the most specific live entry for the host or a parent of it.

    Entries past expires_at do not count; session entries count in their own session only. The list
    is broadcast up to BROADCAST_ROWS rows; a longer one is joined on the suffix.
    """
    entries = blocklist.select(F.lower("domain").alias("block_domain"), F.col("reason").alias("block_reason"), F.col("source").alias("block_source"), F.col("expires_at").alias("__expires"), F.col("session_id").alias("__session"))
    if blocklist.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        entries = F.broadcast(entries)
    tried = fetches.select(F.col(key), "session_id", "ts", F.explode(urls.suffixes(F.col("domain"))).alias("block_domain"))
    live = (F.col("__expires").isNull() | (F.col("__expires") >= F.col("ts"))) & ((F.col("block_source") != "session") | F.coalesce(F.col("__session") == F.col("session_id"), F.lit(False)))
    hits = tried.join(entries, "block_domain").filter(live)
    best = hits.groupBy(key).agg(F.max_by(F.struct("block_domain", "block_reason", "block_source"), F.struct(F.length("block_domain"), "block_source", "block_reason")).alias("__b"))
    return fetches.join(best, key, "left").select(*fetches.columns, "__b.block_domain", "__b.block_reason", "__b.block_source")


def expired_on_read(fetches: DataFrame, blocklist: DataFrame) -> DataFrame:
    """blocklist without the entries that looking up the fetches (domain, session_id, ts) found expired.

    A look-up goes from the host to its parents and ends at the first live entry that counts for the
    session; what it passes that is past expires_at is deleted, what it never reaches stays.
    """
    entries = blocklist.select(F.lower("domain").alias("block_domain"), "source", F.col("expires_at").alias("__expires"), F.col("session_id").alias("__session"))
    if blocklist.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        entries = F.broadcast(entries)
    looks = fetches.select("domain", "session_id", "ts").distinct().withColumn("__look", F.monotonically_increasing_id())
    tried = looks.select("__look", "session_id", "ts", F.explode(urls.suffixes(F.col("domain"))).alias("block_domain")).join(entries, "block_domain")
    late = F.coalesce(F.col("__expires") < F.col("ts"), F.lit(False))
    counts = ~late & ((F.col("source") != "session") | F.coalesce(F.col("__session") == F.col("session_id"), F.lit(False)))
    end = Window.partitionBy("__look")
    passed = tried.withColumn("__end", F.max(F.when(counts, F.length("block_domain"))).over(end)).filter(late & (F.length("block_domain") > F.coalesce("__end", F.lit(0))))
    gone = passed.select("block_domain", "__expires").distinct()
    on = (F.lower(blocklist["domain"]) == gone["block_domain"]) & (blocklist["expires_at"] == gone["__expires"])
    return blocklist.join(gone, on, "left_anti")


def scanned_results(bodies: DataFrame, blocklist: DataFrame, key: str = "id", body: str = "body", most: int = urls.MOST_URLS) -> DataFrame:
    """bodies (key, body, session_id, ts) with scanned, truncated, blocked_results (domains) and suspicious_results (url and reason) of the first `most` distinct urls in the text."""
    found = bodies.withColumn("__urls", urls.urls_in(F.col(body)))
    each = found.select(F.col(key), "session_id", "ts", F.posexplode(F.slice("__urls", 1, most)).alias("__pos", "url"))
    each = each.withColumn("f", urls.url_fields("url"))
    each = each.withColumns({"refuse": urls.inspect(F.col("url"), F.col("f"))["refuse"], "domain": F.col("f.host"), "__row": F.concat_ws("#", F.col(key), F.col("__pos"))})
    each = blocked(each, blocklist, "__row")
    domains = F.array_sort(F.collect_list(F.when(F.col("block_domain").isNotNull(), F.struct("__pos", "domain"))))
    bad = F.array_sort(F.collect_list(F.when(F.col("refuse").isNotNull(), F.struct("__pos", "url", F.col("refuse").alias("reason")))))
    per = each.groupBy(key).agg(F.array_distinct(F.transform(domains, lambda x: x["domain"])).alias("blocked_results"), F.transform(bad, lambda x: F.struct(x["url"].alias("url"), x["reason"].alias("reason"))).alias("suspicious_results"))
    out = found.join(per, key, "left")
    none = F.array()
    return out.withColumns({"scanned": F.least(F.size("__urls"), F.lit(most)), "truncated": F.size("__urls") > most, "blocked_results": F.coalesce("blocked_results", none.cast("array<string>")), "suspicious_results": F.coalesce("suspicious_results", none.cast("array<struct<url:string,reason:string>>"))}).drop("__urls")
