"""Text functions as column expressions: invisible characters, folding, stripping, sniffing, wrapping."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MAJOR, VERSION, Config
from . import types

# Character classes by code point.
INVISIBLE_RANGES = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x2064), (0x2066, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE01EF),
)
TAG_RANGES = ((0xE0000, 0xE007F),)
BIDI_RANGES = ((0x200E, 0x200F), (0x202A, 0x202E), (0x2066, 0x2069))
#: White space as the matching rules have it: wider than what \s means in Java.
SPACE_RANGES = ((0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
# Letters that look like Latin ones.
CYRILLIC = dict(zip("авекмнорстухѕіјԁԛѡԝӏһѵԥәғ", "abekmhopctyxsijdqwwlhvpef", strict=True))
GREEK = dict(zip("αβεικμνορστυχγ", "abeikuvopotuxy", strict=True))
CONFUSABLES = CYRILLIC | GREEK
# Reserved tag names, and the rules for URIs and handlers.
RESERVED_TAGS = ("untrusted_source", "safe_research_summary", "system-reminder", "function_results", "antml:")
URI_ATTRIBUTES = "href|src|action|formaction"


def java_class(ranges) -> str:
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" if a != b else rf"\x{{{a:X}}}" for a, b in ranges) + "]"


INVISIBLE, TAGS, BIDI, SPACE = map(java_class, (INVISIBLE_RANGES, TAG_RANGES, BIDI_RANGES, SPACE_RANGES))
NOT_SPACE_OR_GT = "[^>" + SPACE[1:]
LINE = r"[^\n\r\x{2028}\x{2029}]"
WORD_END = "(?![A-Za-z0-9_])"
COMMENT = r"(?s)<!--.*?-->"
SCRIPTS = (
    *(rf"(?i)<{t}{WORD_END}[^>]*>[\s\S]*?</{t}{SPACE}*>" for t in ("script", "style", "iframe")),
    *(rf"(?i)<{t}{WORD_END}[^>]*>(?!{LINE}*?</{t}{SPACE}*>)" for t in ("script", "iframe")),
)
HANDLER = rf"""(?i){SPACE}+on[a-z]+{SPACE}*={SPACE}*("[^"]*"|'[^']*'|{NOT_SPACE_OR_GT}+)"""


def _uri(scheme: str) -> str:
    return rf"""(?i)({URI_ATTRIBUTES}){SPACE}*={SPACE}*("{scheme}[^"]*"|'{scheme}[^']*'|{scheme}{NOT_SPACE_OR_GT}+)"""


SCRIPT_URI, DATA_URI = _uri("javascript:"), _uri("data:(?!image/)")
# Sample, gram and least length of the repetition ratio.
SAMPLE, GRAM, LEAST = 32_768, 16, 256
RESERVED = rf"(?i)<{SPACE}*(/?){SPACE}*({'|'.join(RESERVED_TAGS)})"


def matches(c: Column, pattern: str) -> Column:
    """How often the pattern matches."""
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def removed(c: Column, *patterns: str) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, F.lit(p), F.lit(""))
    return c


def strip_comments(html: Column) -> Column:
    """Without terminated comments; an open one stays."""
    return removed(html, COMMENT)


def strip_scripts(html: Column) -> Column:
    """Without script, style and iframe elements, then without script and iframe openers that nothing closes on their line."""
    return removed(html, *SCRIPTS)


def strip_handlers(html: Column) -> Column:
    """Without on...= attributes, javascript: URIs and data: URIs other than images."""
    return removed(html, HANDLER, SCRIPT_URI, DATA_URI)


def strip_invisible(c: Column) -> Column:
    return removed(c, INVISIBLE)


def invisible_count(c: Column) -> Column:
    return matches(c, INVISIBLE)


def tag_char_count(c: Column) -> Column:
    return matches(c, TAGS)


def bidi_count(c: Column) -> Column:
    return matches(c, BIDI)


def decode_tag_chars(c: Column, most: int = 120) -> Column:
    """What invisible tag characters spell, cut with dots at `most`."""
    points = range(TAG_RANGES[0][0], TAG_RANGES[0][1] + 1)
    hidden = F.regexp_replace(c, F.lit("[^" + TAGS[1:]), F.lit(""))
    plain = F.translate(hidden, "".join(map(chr, points)), "".join(chr(p - 0xE0000) for p in points))
    return F.when(F.length(plain) >= most, F.concat(F.substring(plain, 1, most), F.lit("..."))).otherwise(plain)


def fold_confusables(c: Column) -> Column:
    return F.translate(c, "".join(CONFUSABLES), "".join(CONFUSABLES.values()))


def mixes_scripts(c: Column) -> Column:
    """Latin letters together with Cyrillic or Greek ones."""
    return c.rlike("[A-Za-z]") & c.rlike(r"[\x{370}-\x{3FF}\x{400}-\x{52F}]")


def folds_to_latin(c: Column) -> Column:
    """Not ASCII, yet a plain Latin word once folded."""
    return c.rlike(r"[^\x00-\x7F]") & fold_confusables(F.lower(c)).rlike("^[a-z0-9-]+$")


@F.pandas_udf(types.of("string"))
def nfkc(s: pd.Series) -> pd.Series:
    """NFKC, for which Spark has no function; ASCII passes through."""
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def units(c: Column) -> Column:
    """Length in UTF-16 units."""
    return F.length(c) + matches(c, r"[\x{10000}-\x{10FFFF}]")


def for_matching(c: Column) -> Column:
    """The form phrases are sought in: no invisible characters, NFKC, lower case, confusables folded, white space single."""
    return F.regexp_replace(fold_confusables(F.lower(nfkc(strip_invisible(c)))), F.lit(SPACE + "+"), F.lit(" "))


def literal_for_matching(s: str) -> str:
    """for_matching of a constant, on the driver."""
    gone = {p for a, b in INVISIBLE_RANGES for p in range(a, b + 1)}
    spaces = {chr(p) for a, b in SPACE_RANGES for p in range(a, b + 1)}
    t = unicodedata.normalize("NFKC", "".join(ch for ch in s if ord(ch) not in gone)).lower()
    out: list[str] = []
    for ch in t:
        ch = CONFUSABLES.get(ch, ch)
        if ch in spaces:
            if out and out[-1] == " ":
                continue
            ch = " "
        out.append(ch)
    return "".join(out)


def visible_text(html: Column, most: int = 200_000) -> Column:
    """What a reader sees of the first `most` characters: no script or style bodies, no tags, white space single."""
    t = F.substring(html, 1, most)
    t = F.regexp_replace(t, F.lit(rf"(?i)<(script|style){WORD_END}[^>]*>[\s\S]*?</\1{SPACE}*>"), F.lit(" "))
    t = F.regexp_replace(t, F.lit("<[^>]+>"), F.lit(" "))
    return F.trim(F.regexp_replace(t, F.lit(SPACE + "+"), F.lit(" ")))


@F.pandas_udf(types.of("double"))
def repetition_ratio(s: pd.Series) -> pd.Series:
    """Share of the character grams of a text's sample that repeat an earlier one; 0 for short texts. Counts UTF-16 units.

    Python sets of slices take a twentieth of the time of the array functions here, whose every gram is an array of its own.
    """

    def ratio(t: str | None) -> float:
        t = (t or "")[:SAMPLE]
        if t.isascii() or max(t) < "\U00010000":
            n, step, data = len(t), 1, t
        else:
            data = t.encode("utf-16-le")[: 2 * SAMPLE]
            n, step = len(data) // 2, 2
        if n < LEAST:
            return 0.0
        grams = n - GRAM + 1
        return 1 - len({data[i : i + step * GRAM] for i in range(0, step * grams, step)}) / grams

    return s.map(ratio)


def sniff_mime(body: Column) -> Column:
    """The type that the first 512 characters show, or null."""

    def sniffed(head: Column) -> Column:
        def starts(*heads: str) -> Column:
            hit = F.lit(False)
            for h in heads:
                hit = hit | F.startswith(head, F.lit(h))
            return hit

        return (
            F.when(starts("<!doctype html", "<html"), F.lit("text/html"))
            .when(starts("<?xml", "<rss", "<feed"), F.lit("application/xml"))
            .when(starts("{", "["), F.lit("application/json"))
            .when(starts("%pdf-"), F.lit("application/pdf"))
        )

    return types.let(F.lower(F.regexp_replace(F.substring(body, 1, 512), F.lit(f"^{SPACE}+"), F.lit(""))), sniffed)


def mime_agrees(declared: Column, sniffed: Column) -> Column:
    """Whether a declared type and a sniffed one are of a family."""
    d = F.lower(F.trim(F.split_part(declared, F.lit(";"), F.lit(1))))
    return (d == sniffed) | (F.startswith(d, F.lit("text/")) & (sniffed == "text/html")) | (F.contains(d, F.lit("xml")) & (sniffed == "application/xml")) | (F.contains(d, F.lit("json")) & (sniffed == "application/json"))


def reserved_count(c: Column) -> Column:
    """Tags that would close or forge the frame around a body."""
    return matches(c, RESERVED)


def neutralise(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(RESERVED), F.lit("&lt;$1$2"))


def escape_attribute(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def nonce() -> Column:
    """16 random hex digits."""
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16)


def wrap(url: Column, body: Column, rules: Column, original_bytes: Column, sha256: Column, signals: Column, fetched_at: Column, nonce: Column, mode: str = "enforce") -> Column:
    """The body in a frame that carries its provenance; rules and signals are arrays of names."""
    listed = F.array_join(rules, ",")
    done, pending = (listed, F.lit("")) if mode == "enforce" else (F.lit(""), listed if mode == "log" else F.lit(""))
    parts = {"url": escape_attribute(url), "fetched_at": fetched_at, "sanitiser_version": F.lit(VERSION), "mode": F.lit(mode), "nonce": nonce, "rules_applied": done, "original_bytes": original_bytes.cast("string"), "content_sha256": sha256, "risk_signals": F.array_join(signals, ",")}
    head = F.concat_ws(" ", *(F.concat(F.lit(f'{k}="'), v, F.lit('"')) for k, v in parts.items()), F.when(pending != "", F.concat(F.lit('rules_pending="'), pending, F.lit('"'))))
    return F.concat(F.lit("<untrusted_source "), head, F.lit(">\n"), neutralise(body), F.lit('\n</untrusted_source nonce="'), nonce, F.lit('">'))


def wrapper_version(raw: Column) -> Column:
    """compatible and found: the version in a frame, and whether its major number is known."""
    found = F.nullif(F.regexp_extract(raw, rf'sanitiser_version{SPACE}*={SPACE}*"([^"]+)"', 1), F.lit(""))
    major = F.regexp_extract(found, r"^\s*([+-]?\d+)", 1).try_cast("int")
    return F.struct(F.coalesce(major <= MAJOR, F.lit(False)).alias("compatible"), found.alias("found"))


def phrase_found(haystack: Column, config: Config) -> Column:
    """The first configured phrase that a body made ready by for_matching contains, or null."""
    return types.let(haystack, lambda h: F.coalesce(*(F.when(F.contains(h, F.lit(literal_for_matching(p))), F.lit(p)) for p in config.phrases), F.lit(None).cast("string")))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)
