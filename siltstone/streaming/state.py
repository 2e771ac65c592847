"""Streaming: the session counter, the promotion of domains that a session aborts, and the windows of a session, as keyed state."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "10 minutes"


def session_counters(calls: DataFrame) -> DataFrame:
    """Streaming session_id, call_count, first: complete or update mode."""
    return calls.groupBy("session_id").agg(F.count(F.lit(1)).alias("call_count"), F.min("ts").alias("first"))


def promoted(fetches: DataFrame, repeats: int, hours: float = 24) -> DataFrame:
    """Streaming session_id, domain, aborts, added_at, expires_at: one row whenever an abort reaches or passes the repeats.

    State is a count per session and domain, and goes when nothing came for `hours` of event time.
    """
    aborts = fetches.filter("abort_decision AND session_id IS NOT NULL AND domain NOT IN ('websearch', 'unknown')").withWatermark("ts", WATERMARK)
    keep = int(hours * 3600 * 1000)

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        at = range(n + 1, n + len(rows) + 1)
        state.update((n + len(rows),))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + keep)
        out = rows.assign(aborts=list(at), session_id=key[0], domain=key[1]).query(f"aborts >= {repeats}")
        if len(out):
            yield pd.DataFrame({"session_id": out["session_id"], "domain": out["domain"], "aborts": out["aborts"], "added_at": out["ts"], "expires_at": out["ts"] + pd.Timedelta(hours=hours)})

    return aborts.select("session_id", "domain", "ts", "id").groupBy("session_id", "domain").applyInPandasWithState(count, "session_id string, domain string, aborts long, added_at timestamp, expires_at timestamp", "n long", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_urls(fetches: DataFrame, minutes: int) -> DataFrame:
    """Streaming window, session_id, domain, distinct_urls (approximate), fetches per sliding window: append mode, late rows beyond the watermark are left out."""
    rows = fetches.withWatermark("ts", WATERMARK)
    return rows.groupBy(F.window("ts", f"{minutes} minutes", f"{max(minutes // 5, 1)} minutes"), "session_id", "domain").agg(F.approx_count_distinct("url").alias("distinct_urls"), F.count(F.lit(1)).alias("fetches"))


def history_signals(fetches: DataFrame, minutes: float, count: int, distance: int, recent: int = 200) -> DataFrame:
    """Streaming id, session_id, domain, distinct_urls, explosion, near_duplicate_of: each fetch against its session's earlier ones in the minutes before.

    State per session and domain is the url, simhash and time of fetches within the window; it is
    dropped after the window has passed in event time. Rows of one trigger are taken in time order,
    each entering and leaving the window once; near duplicates are sought among the `recent` last.
    """
    span = pd.Timedelta(minutes=minutes)
    rows = fetches.filter("session_id IS NOT NULL").withWatermark("ts", WATERMARK).select("id", "session_id", "domain", "ts", "url", "simhash")

    def look(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        past = deque(zip(*state.get, strict=True) if state.exists else ())
        urls, out = Counter(u for _, u, _ in past), []
        for r in pd.concat(list(batches)).sort_values(["ts", "id"]).itertuples():
            now = int(r.ts.value)
            while past and past[0][0] < now - span.value:
                gone = past.popleft()[1]
                urls[gone] -= 1
                if not urls[gone]:
                    del urls[gone]
            near = next((u for _, u, h in islice(reversed(past), recent) if u != r.url and h is not None and r.simhash is not None and (int(h, 16) ^ int(r.simhash, 16)).bit_count() <= distance), None)
            out.append((r.id, key[0], key[1], len(urls), len(urls) >= count, near))
            past.append((now, r.url, r.simhash))
            urls[r.url] += 1
        state.update(tuple(map(list, zip(*past, strict=True))))
        state.setTimeoutTimestamp(max(past[-1][0] // 10**6, state.getCurrentWatermarkMs()) + int(minutes * 60_000) + 1)
        yield pd.DataFrame(out, columns=["id", "session_id", "domain", "distinct_urls", "explosion", "near_duplicate_of"])

    return rows.groupBy("session_id", "domain").applyInPandasWithState(look, "id long, session_id string, domain string, distinct_urls long, explosion boolean, near_duplicate_of string", "at array<long>, url array<string>, simhash array<string>", "append", GroupStateTimeout.EventTimeTimeout)
