"""Risk signals of scored pages, their tiers, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import hashing, text, urls


def page_signals(pages: DataFrame, config: Config, html: str = "html", domain: str = "domain") -> DataFrame:
    """sanitised pages with fired (names, in the order they are checked), matched_phrase, repeat_ratio, sniffed_mime.

    Columns content_type, redirect_hops, distinct_urls, near_duplicate_of, simhash_distance,
    blocked_results and suspicious_results are used where pages has them: they come from refetches,
    history and result scans.
    """
    has, d, body = set(pages.columns), F.col(domain), F.coalesce(F.col(html), F.lit(""))
    p = pages.withColumns({"__hay": text.for_matching(F.substring(body, 1, 4_000_000)), "__visible": text.visible_text(body), "sniffed_mime": text.sniff_mime(body)})
    p = p.withColumns({"matched_phrase": text.phrase_found(F.col("__hay"), config), "repeat_ratio": text.repetition_ratio(F.col("__visible"))})

    def over(name: str, column: str, signal: str) -> tuple[str, Column]:
        return signal, F.col(column) > config.threshold(name, d)

    checks = [
        ("injection_phrase", F.col("matched_phrase").isNotNull()),
        ("wrapper_escape_attempt", text.reserved_count(body) > 0),
        ("unicode_tag_chars", F.col("tag_char_count") > 0),
        ("bidi_control_chars", text.bidi_count(body) > 0),
        over("oversized_response_bytes", "original_bytes", "oversized_response"),
        over("repeating_substring_ratio_max", "repeat_ratio", "repeating_substring_ratio_high"),
        ("url_cardinality_explosion", F.col("distinct_urls") >= config.threshold("url_cardinality_explosion_count", d)) if "distinct_urls" in has else None,
        over("zero_width_chars_max", "zero_width_count", "zero_width_chars"),
        over("hidden_content_ratio_max", "hidden_content_ratio", "hidden_content_ratio_high"),
        over("redirect_chain_max_hops", "redirect_hops", "redirect_chain_long") if "redirect_hops" in has else None,
        ("content_type_mismatch", (F.col("content_type") != "") & ~text.mime_agrees(F.col("content_type"), F.col("sniffed_mime"))) if "content_type" in has else None,
        ("near_duplicate_to_session", F.col("near_duplicate_of").isNotNull()) if "near_duplicate_of" in has else None,
        ("cloaking_suspected", cloaked(F.col("simhash_distance"), d, config)) if "simhash_distance" in has else None,
        ("blocklisted_result_domain", F.size("blocked_results") > 0) if "blocked_results" in has else None,
        ("suspicious_result_url", F.size("suspicious_results") > 0) if "suspicious_results" in has else None,
    ]
    fired = F.array_compact(F.array(*(F.when(c[1], F.lit(c[0])) for c in checks if c)))
    return p.withColumn("fired", fired).drop("__hay", "__visible")


def cloaked(distance: Column, domain: Column, config: Config) -> Column:
    """Two captures of a page that differ by more than twice the near-duplicate distance."""
    return distance > config.threshold("near_duplicate_hamming_distance", domain) * 2


def with_tiers(df: DataFrame, config: Config, fired: str = "fired", unknown_as_elevated: bool = False) -> DataFrame:
    """df with critical, elevated, unknown: the fired names by configured tier."""
    known = F.array(*map(F.lit, config.tiers))
    unknown = F.filter(fired, lambda s: ~F.array_contains(known, s))
    elevated = F.filter(fired, lambda s: F.array_contains(config.signals("elevated"), s))
    if unknown_as_elevated:
        elevated, unknown = F.concat(elevated, unknown), F.array().cast("array<string>")
    return df.withColumns({"critical": F.filter(fired, lambda s: F.array_contains(config.signals("critical"), s)), "elevated": elevated, "unknown": unknown})


def downgraded(df: DataFrame, config: Config, domain: str = "domain") -> DataFrame:
    """df with meta_allowlisted; a lone critical injection_phrase moves to elevated on hosts that write about injections."""
    lone = (F.size("critical") == 1) & F.array_contains("critical", "injection_phrase") & urls.matches_any(F.col(domain), config.research_hosts, subdomains=True)
    lone = F.coalesce(lone, F.lit(False))
    return df.withColumn("meta_allowlisted", lone).withColumns({
        "elevated": F.when(F.col("meta_allowlisted"), F.array_append("elevated", F.lit("injection_phrase"))).otherwise(F.col("elevated")),
        "critical": F.when(F.col("meta_allowlisted"), F.array().cast("array<string>")).otherwise(F.col("critical")),
    })


def aborts(config: Config, critical: str = "critical", elevated: str = "elevated") -> Column:
    """Any critical signal, or enough elevated ones."""
    return (F.size(critical) > 0) | (F.size(elevated) >= config.thresholds["abort_on_elevated_count"])


def verdict(config: Config) -> Column:
    return F.when(aborts(config), F.lit("ABORT")).when(F.size("fired") > 0, F.lit("Caution")).otherwise(F.lit("Clean"))


def retention(sanitised: str = "sanitised_bytes", original: str = "original_bytes") -> Column:
    return F.when(F.col(original) == 0, F.lit(1.0)).otherwise(F.col(sanitised) / F.col(original))


def cloaking(fetches: DataFrame, refetches: DataFrame, key: str = "url") -> DataFrame:
    """fetches (url, simhash) with simhash_distance to the refetch of the same url, the last one where refetches have fetched_at; null without one."""
    at = F.col("fetched_at") if "fetched_at" in refetches.columns else F.lit(0)
    other = refetches.groupBy(key).agg(F.max(F.struct(at.alias("at"), "simhash"))["simhash"].alias("__other"))
    return fetches.join(other, key, "left").withColumn("simhash_distance", hashing.hamming(F.col("simhash"), F.col("__other"))).drop("__other")
