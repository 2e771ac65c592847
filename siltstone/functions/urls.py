"""URL functions: hosts, private addresses, punycode, adversarial checks, suffix candidates.

Checks are column expressions. Only hosts with characters beyond ASCII or with encoded labels need
Python (punycode and IDN parsing), in one Arrow UDF that returns at once for other urls.
"""

from __future__ import annotations

import re
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import types
from .text import INVISIBLE, INVISIBLE_RANGES, folds_to_latin, mixes_scripts

# Suffixes of internal names, and what a url token in running text may not contain.
INTERNAL = (".local", ".localhost", ".internal", ".intranet", ".lan", ".home.arpa")
URL_TOKEN = r"""https?://[^\s"'<>()\[\]{}|\\\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"""
MOST_URLS = 50
_GONE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in INVISIBLE_RANGES) + "]")


# ---------------------------------------------------------------- punycode (RFC 3492)


def punycode_decode(text: str) -> str | None:
    """The label after xn--, decoded; None where it is malformed."""
    head, dash, tail = text.rpartition("-")
    if dash and not head or not head.isascii():
        return None
    out, n, i, bias = list(head), 128, 0, 72
    digits = iter(tail)
    for first in digits:
        before, weight, k, ch = i, 1, 36, first
        while True:
            value = ord(ch) - 22 if "0" <= ch <= "9" else ord(ch.lower()) - 97 if ch.isascii() and ch.isalpha() else None
            if value is None:
                return None
            i += value * weight
            if i > 4 * 0x10FFFF:
                return None
            least = min(max(k - bias, 1), 26)
            if value < least:
                break
            weight *= 36 - least
            k += 36
            ch = next(digits, None)
            if ch is None:
                return None
        size = len(out) + 1
        delta = (i - before) // (2 if before else 700)
        delta += delta // size
        turns = 0
        while delta > 455:
            delta //= 35
            turns += 36
        bias = turns + 36 * delta // (delta + 38)
        n += i // size
        i %= size
        if n > 0x10FFFF:
            return None
        out.insert(i, chr(n))
        i += 1
    return "".join(out)


@F.pandas_udf(types.of("string"))
def decoded_label(s: pd.Series) -> pd.Series:
    """Punycode labels decoded; null for malformed ones and for labels without xn--."""
    return s.map(types.guarded(lambda x: punycode_decode(x[4:]) if x is not None and x[:4].lower() == "xn--" else None, lambda *_: None))


# ---------------------------------------------------------------- parsing


def parsed(url: str) -> tuple[str, str, str, str, str] | None:
    """scheme, user info, host, path, query as a browser sees them; None where it would not parse."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", url.strip("\x00\x01\x02\x03\x04\x05\x06\x07\x08\t\n\x0b\x0c\r\x0e\x0f\x10\x11\x12\x13\x14\x15\x16\x17\x18\x19\x1a\x1b\x1c\x1d\x1e\x1f "))
    if not m:
        return None
    scheme, rest = m[1].lower(), m.string[m.end() :].replace("\t", "").replace("\n", "").replace("\r", "")
    if scheme not in ("http", "https", "ftp", "ws", "wss"):
        p = urlsplit(m.string)
        return scheme, "", (p.netloc.rpartition("@")[2].partition(":")[0]).lower(), p.path, p.query
    rest = rest.replace("\\", "/").lstrip("/")
    authority, path = re.match(r"([^/?#]*)(.*)", rest, re.S).groups()
    user, _, host_port = authority.rpartition("@")
    if host_port.startswith("["):
        host, bracket, port = host_port.partition("]")
        host += bracket
        port = port.lstrip(":")
        if not bracket:
            return None
    else:
        host, _, port = host_port.partition(":")
        host = host_of(host)
    if not host or port and not (port.isdigit() and int(port) < 65536):
        return None
    path, _, query = path.partition("#")[0].partition("?")
    return scheme, user, host.lower(), quote(path, safe="/%:@!$&'()*+,;=~[]|^{}`\"<>") or "/", query


def host_of(host: str) -> str:
    """The ASCII host of a special url; empty where it is not a host. Numbers become dotted IPv4."""
    from urllib.parse import unquote

    host = unquote(host)
    if not host.isascii():
        import unicodedata

        host = unicodedata.normalize("NFKC", _GONE.sub("", host)).lower()
        try:
            host = ".".join(p if p.isascii() else "xn--" + p.encode("punycode").decode() for p in re.split("[.。．｡]", host))
        except UnicodeError:
            return ""
    host = host.lower()
    if not host or re.search(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]", host):
        return ""
    parts = host.removesuffix(".").split(".")
    if re.fullmatch(r"[0-9]+|0x[0-9a-f]*", parts[-1]):
        if len(parts) > 4:
            return ""
        try:
            numbers = [int(p, 16) if p[:2] == "0x" and p[2:] else 0 if p == "0x" else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p) for p in parts]
        except ValueError:
            return ""
        if any(v > 255 for v in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
            return ""
        value = numbers[-1] + sum(v << 8 * (3 - i) for i, v in enumerate(numbers[:-1]))
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
    return host


@F.pandas_udf(types.struct("scheme string, user string, host string, path string, query string, error string"))
def url_fields(s: pd.Series) -> pd.DataFrame:
    """parsed() as a column of structs; fields are null where the url does not parse, and error says why where parsing fails."""
    one = types.guarded(lambda u: (*((parsed(u) if u is not None else None) or (None,) * 5), None), lambda _, error: (*(None,) * 5, error))
    return pd.DataFrame([one(u) for u in s], columns=["scheme", "user", "host", "path", "query", "error"], dtype=object)


PLAIN_URL = r"^https?://[A-Za-z0-9._-]*[A-Za-z_-][A-Za-z0-9_-]*(:[0-9]{1,4})?([/?#][\x21-\x7E]*)?$"


def plain_host(url: Column) -> Column:
    """The host, without Python, of a url with an ASCII name as host; null for other urls."""
    return F.when(url.rlike(PLAIN_URL) & ~F.lower(url).rlike(r"^https?://([^/?#:]*\.)?0x[0-9a-f]*[:/?#]"), F.lower(F.regexp_extract(url, r"^https?://([^/?#:]*)", 1)))


def host(url: Column) -> Column:
    """The host of any url, null where it does not parse; only urls that plain_host leaves open are parsed in Python."""
    plain = plain_host(url)
    return F.coalesce(plain, url_fields(F.when(plain.isNull(), url))["host"])


def raw_host(url: Column) -> Column:
    """The host as written: after the scheme and any user info, without the port; null without a scheme."""
    has = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host_port = F.substring_index(authority, "@", -1)
    bracketed = F.when(host_port.contains("]"), F.concat(F.substring_index(host_port, "]", 1), F.lit("]")))
    return F.when(has, F.when(F.startswith(host_port, F.lit("[")), bracketed).otherwise(F.substring_index(host_port, ":", 1)))


# ---------------------------------------------------------------- private hosts


def _number(part: Column) -> Column:
    """A decimal, 0x or 0-octal number of 32 bits; null for anything else."""
    base = F.when(part.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.lit(16)).when(part.rlike("^0[0-7]{1,20}$"), F.lit(8)).when(part.rlike("^[0-9]{1,18}$"), F.lit(10))
    value = F.when(base == 16, F.conv(F.substring(part, 3, 20), 16, 10)).when(base == 8, F.conv(part, 8, 10)).when(base == 10, part).cast("long")
    return types.let(value, lambda v: F.when(v <= 0xFFFFFFFF, v))


def _private_v4(n: Column) -> Column:
    """Of four octets, or of one number of 32 bits; null for anything else."""
    octets = F.when((F.size(n) == 4) & F.forall(n, lambda v: F.coalesce(v <= 255, F.lit(False))), n).when((F.size(n) == 1) & n[0].isNotNull(), F.array(F.shiftright(n[0], 24), F.shiftright(n[0], 16).bitwiseAND(F.lit(255).cast("long"))))

    def private(o: Column) -> Column:
        a, b = o[0], o[1]
        return a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & b.isin(0, 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | (a >= 224)

    return types.let(octets, lambda o: F.when(o.isNotNull(), private(o)))


def _v4(host: Column) -> Column:
    return _private_v4(F.transform(F.split(host, r"\."), _number))


def is_private(host: Column) -> Column:
    """Hosts that are no public site: empty, local and dotless names, internal suffixes, private and reserved addresses."""
    internal = "(" + "|".join(s.replace(".", r"\.") for s in INTERNAL) + ")$"

    def six(inner: Column) -> Column:
        mapped = F.regexp_extract(inner, r"::ffff:([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
        return inner.isin("::1", "::", "0:0:0:0:0:0:0:1") | inner.rlike("^f[cd][0-9a-f]{0,2}:|^fe[89ab][0-9a-f]?:") | F.coalesce(_v4(mapped), F.lit(False))

    def private(h: Column) -> Column:
        return F.when((h == "") | (h == "localhost") | h.rlike(internal), F.lit(True)).when(F.startswith(h, F.lit("[")), six(F.regexp_replace(h, r"^\[|\]$", ""))).otherwise(F.coalesce(_v4(h), ~h.contains(".")))

    return types.let(F.regexp_replace(F.lower(host), r"\.$", ""), lambda h: F.when(h.isNotNull(), private(h)))


# ---------------------------------------------------------------- inspection


def inspect(url: Column, fields: Column) -> Column:
    """refuse (null: may be fetched) and warnings of a url; fields: url_fields of it.

    The first reason to refuse wins. A url that does not parse is neither refused nor warned of.
    Labels are judged as written, before an IDN host is encoded, and encoded labels once decoded.
    """
    raw = raw_host(url)

    def encoded(x: Column) -> Column:
        return F.startswith(F.lower(x), F.lit("xn--"))

    def label_refusal(p: Column) -> Column:
        x, d = p["label"], p["decoded"]
        said = F.concat(F.lit('punycode label "'), x, F.lit('" decodes to "'), d)
        return F.when(
            encoded(x),
            F.when(d.isNull(), F.concat(F.lit('malformed punycode label "'), x, F.lit('"')))
            .when(mixes_scripts(d), F.concat(said, F.lit('", which mixes Latin with lookalikes')))
            .when(folds_to_latin(d), F.concat(said, F.lit('", a whole-script homoglyph'))),
        ).when(x.rlike(r"[^\x00-\x7F]"), F.concat(F.lit('non-ASCII characters in hostname label "'), x, F.lit('"')))

    def label_warning(p: Column) -> Column:
        return F.when(encoded(p["label"]) & p["decoded"].isNotNull(), F.concat(F.lit('internationalised label "'), p["label"], F.lit('" decodes to "'), p["decoded"], F.lit('"')))

    def judged(u: Column) -> Column:
        f = u["f"]
        pairs = F.zip_with(F.split(u["raw"], r"\."), u["decoded"], lambda x, d: F.struct(x.alias("label"), d.alias("decoded")))
        refuse = (
            F.when(f["scheme"].isNull(), F.lit(None).cast("string"))
            .when(~f["scheme"].isin("http", "https"), F.concat(F.lit('non-web scheme "'), f["scheme"], F.lit(':"')))
            .when(f["user"].rlike("[^:]"), F.lit("embedded credentials"))
            .when(F.regexp_count(u["authority"], F.lit("@")) > 1, F.lit("multiple @ in authority"))
            .when(F.coalesce(u["raw"].rlike(INVISIBLE), F.lit(False)) | f["host"].rlike(INVISIBLE) | f["path"].rlike(INVISIBLE), F.lit("invisible characters in host or path"))
            .otherwise(F.try_element_at(F.array_compact(F.transform(pairs, label_refusal)), F.lit(1)))
        )
        private = F.when(is_private(f["host"]), F.concat(F.lit("private host "), f["host"]))
        warnings = F.array_compact(F.concat(F.coalesce(F.transform(pairs, label_warning), F.array().cast("array<string>")), F.array(private)))
        return types.let(refuse, lambda r: F.struct(r.alias("refuse"), F.when(r.isNull() & f["scheme"].isNotNull(), warnings).otherwise(F.array().cast("array<string>")).alias("warnings")))

    return types.let(F.struct(raw.alias("raw"), F.regexp_extract(url, r"://([^/?#]*)", 1).alias("authority"), decoded_labels(raw).alias("decoded"), fields.alias("f")), judged)


@F.pandas_udf(types.of("array<string>"))
def decoded_labels(s: pd.Series) -> pd.Series:
    """Each dot-separated label's punycode decoded, null where it has none or is malformed."""
    one = types.guarded(lambda x: punycode_decode(x[4:]) if x[:4].lower() == "xn--" else None, lambda *_: None)
    return s.map(lambda h: None if h is None else [one(x) for x in h.split(".")])


def refetch_refusal(scheme: Column, host: Column) -> Column:
    """Why an unattended request must not be made, or null."""
    return F.when(~F.coalesce(scheme.isin("http", "https"), F.lit(False)), F.lit("refused_scheme")).when(host.isNull() | is_private(host), F.lit("refused_private_host"))


def matches_any(domain: Column, patterns: tuple[str, ...], subdomains: bool = False) -> Column:
    """Exactly a pattern, or under it: for *.suffix patterns, or for all where subdomains is set."""
    hit = F.lit(False)
    for p in patterns:
        if p.startswith("*."):
            hit = hit | F.endswith(domain, F.lit(p[1:]))
        else:
            hit = hit | (domain == p) | (F.endswith(domain, F.lit("." + p)) if subdomains else F.lit(False))
    return hit


def suffixes(domain: Column) -> Column:
    """The host and its parents down to two labels, most specific first; a dotless host is its own."""
    parts = F.filter(F.split(F.lower(domain), r"\."), lambda x: x != "")
    n = F.size(parts)
    return F.when(n < 2, F.array(F.lower(domain))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, n), ".")))


def urls_in(body: Column) -> Column:
    """The distinct urls of a text, in order."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(URL_TOKEN), F.lit(0)))
