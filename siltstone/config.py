"""Risk configuration: thresholds, tiers, phrases and lists, with defaults and a JSON loader."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION, MAJOR = "1.1.0", 1

# Defaults of the configuration.
THRESHOLDS = {
    "oversized_response_bytes": 5242880,
    "repeating_substring_ratio_max": 0.6,
    "url_cardinality_explosion_count": 30,
    "url_cardinality_explosion_window_minutes": 5,
    "zero_width_chars_max": 3,
    "hidden_content_ratio_max": 0.3,
    "redirect_chain_max_hops": 5,
    "near_duplicate_hamming_distance": 10,
    "abort_on_elevated_count": 3,
    "robots_cache_ttl_hours": 24,
    "session_blocklist_repeat_threshold": 3,
    "auto_blocklist_ttl_days": 90,
    "fetch_log_retention_days": 90,
}
CRITICAL = ("injection_phrase", "wrapper_escape_attempt", "unicode_tag_chars", "cloaking_suspected", "oversized_response", "repeating_substring_ratio_high", "url_cardinality_explosion")
ELEVATED = ("zero_width_chars", "bidi_control_chars", "hidden_content_ratio_high", "redirect_chain_long", "content_type_mismatch", "near_duplicate_to_session", "blocklisted_result_domain", "suspicious_result_url")
OVERRIDES = {"en.wikipedia.org": {"near_duplicate_hamming_distance": 16}, "arxiv.org": {"near_duplicate_hamming_distance": 6}}
SKIP_REFETCH = ("drive.google.com", "docs.google.com", "*.cloudflare.com")
RESEARCH_HOSTS = ("saif.google", "owasp.org", "atlas.mitre.org", "csrc.nist.gov", "learn.microsoft.com", "ai.googleblog.com", "research.google")
PHRASES = (
    "ignore previous instructions",
    "ignore all previous instructions",
    "ignore the above",
    "disregard prior instructions",
    "disregard all previous",
    "you are now",
    "your new instructions are",
    "new instruction:",
    "system prompt:",
    "</system>",
    "<|im_start|>",
    "[INST]",
    "begin new task",
    "forget everything above",
    "the assistant should",
    "claude, you must",
    "you must now",
    "remove the wrapper",
    "do not sanitise",
    "the sanitiser is wrong",
    "trust this source",
    "execute the following",
    "here is your real task",
    "developer mode enabled",
    "jailbreak",
    "do not tell the user",
    "without informing the user",
    "without telling the user",
    "reveal your system prompt",
    "print your system prompt",
    "</untrusted_source>",
    "end of untrusted content",
)


def _frozen(m: Mapping) -> Mapping:
    return MappingProxyType(dict(m))


@dataclass(frozen=True)
class Config:
    """One immutable configuration; its values enter plans as literals."""

    thresholds: Mapping[str, float] = field(default_factory=lambda: _frozen(THRESHOLDS))
    tiers: Mapping[str, str] = field(default_factory=lambda: _frozen({**dict.fromkeys(CRITICAL, "critical"), **dict.fromkeys(ELEVATED, "elevated")}))
    overrides: Mapping[str, Mapping[str, float]] = field(default_factory=lambda: _frozen(OVERRIDES))
    skip_refetch: tuple[str, ...] = SKIP_REFETCH
    research_hosts: tuple[str, ...] = RESEARCH_HOSTS
    phrases: tuple[str, ...] = PHRASES

    def with_thresholds(self, **changed: float) -> Config:
        return replace(self, thresholds=_frozen({**self.thresholds, **changed}))

    def threshold(self, name: str, domain: Column | None = None) -> Column:
        """The threshold as a column; with a domain, that domain's override (exact match) where it has one."""
        value = F.lit(self.thresholds[name])
        own = {d: o[name] for d, o in self.overrides.items() if name in o}
        if domain is None or not own:
            return value
        for d, v in own.items():
            value = F.when(domain == d, F.lit(v)).otherwise(value)
        return value

    def tier_table(self, spark: SparkSession) -> DataFrame:
        """signal, tier; one row per configured signal."""
        return spark.createDataFrame(sorted(self.tiers.items()), "signal string, tier string")

    def signals(self, tier: str) -> Column:
        return F.array(*[F.lit(s) for s, t in self.tiers.items() if t == tier])


def load(path: str) -> Config:
    """The configuration in a JSON file. Keys that are not thresholds (comments) are ignored; a missing file raises."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)

    def numbers(d: Mapping) -> dict:
        return {k: v for k, v in d.items() if k in THRESHOLDS and isinstance(v, int | float)}

    return Config(
        _frozen({**THRESHOLDS, **numbers(raw.get("thresholds", {}))}),
        _frozen({name: "critical" if d.get("tier") == "critical" else "elevated" for name, d in raw.get("signals", {}).items() if isinstance(d, Mapping)}),
        _frozen({d: numbers(o) for d, o in raw.get("per_domain_overrides", {}).items() if isinstance(o, Mapping)}),
        tuple(raw.get("refetch_skip_domains", ())),
        tuple(raw.get("meta_allowlist", {}).get("hosts", ())),
        tuple(raw.get("injection_phrases", ())),
    )
