"""Structural stripping: hidden elements and page furniture, whose tags must be balanced.

Balanced tags are beyond regular expressions, so these two rules run in an Arrow UDF, one trip per
page; pages without any candidate tag return at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F

from . import types
from .text import SPACE_RANGES

# Concealing CSS, tags without an end, furniture tags in order, most rounds and tags.
S = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in SPACE_RANGES) + "]"
CONCEALING = (
    rf"(?:display{S}*:{S}*none|visibility{S}*:{S}*hidden|opacity{S}*:{S}*0|font-size{S}*:{S}*0|text-indent{S}*:{S}*-{S}*[0-9]"
    rf"|clip-path{S}*:{S}*(?:inset\(100%|circle\(0)|(?:left|top){S}*:{S}*-{S}*[0-9]{{3,}}|(?:width|height){S}*:{S}*0(?:px|%)?{S}*[;\"'])"
)
ENDLESS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = ("nav", "noscript", "svg", "aside")
MOST_HIDDEN, MOST_FURNITURE, MOST_TAGS = 500, 200, 10_000

#: What conceals the element whose tag has it: a style, or one of two attributes.
CONCEALED = re.compile(rf"""(?ai)\b(?:style{S}*={S}*(?:"[^"]*?{CONCEALING}[^"]*?"|'[^']*?{CONCEALING}[^']*?')|aria-hidden{S}*={S}*(?:"true"|'true')|hidden(?=[>{S[1:]}))""")
TAG = re.compile(r"(?ai)<([a-z][a-z0-9]*)\b")
#: The words without which nothing is concealed.
MAY_HIDE = re.compile(r"(?ai)hidden|style")


def utf16(s: str) -> int:
    return len(s) + sum(c > "\uffff" for c in s) if not s.isascii() else len(s)


def concealed(html: str) -> tuple[int, int, str] | None:
    """Start, end and name of the first tag that conceals its element.

    What conceals is sought first, and its tag is the first one opened since the last >, so no tag is read twice.
    """
    last, at = html.rfind(">"), 0
    while m := CONCEALED.search(html, at):
        at = m.start() + 1  # what looks concealing outside a tag may have a tag inside
        if m.end() > last:
            continue
        tag = TAG.search(html, html.rfind(">", 0, m.start()) + 1, m.start())
        if tag:
            return tag.start(), html.index(">", m.end()) + 1, tag[1].lower()
    return None


def opened(html: str, tag: re.Pattern) -> tuple[int, int] | None:
    """Start and end of the first tag; nothing is sought beyond the last >."""
    m = tag.search(html, 0, html.rfind(">") + 1)
    return m and m.span()


def element_end(html: str, tag: str, start: int) -> int | None:
    """Where the element whose opening tag ends at start is over, counting nested tags of its name; None if nowhere."""
    open_tags = 1
    for seen, m in enumerate(re.compile(rf"(?ai)<(/?){tag}\b[^>]*>").finditer(html, start, html.rfind(">") + 1)):
        if seen >= MOST_TAGS:
            return None
        open_tags += -1 if m[1] else 1
        if not open_tags:
            return m.end()
    return None


def without(html: str, find: Callable[[str], tuple[int, int, str] | None], rounds: int) -> tuple[str, int]:
    """html without the elements that find meets, always looking from the top again, and the UTF-16 units removed.

    An element without an end loses its opening tag only, so malformed markup never costs the rest of the page.
    """
    gone = 0
    for _ in range(rounds):
        found = find(html)
        if found is None:
            break
        start, end, tag = found
        end = (None if tag in ENDLESS else element_end(html, tag, end)) or end
        gone += utf16(html[start:end])
        html = html[:start] + html[end:]
    return html, gone


def strip_hidden(html: str) -> tuple[str, int]:
    return without(html, concealed, MOST_HIDDEN) if MAY_HIDE.search(html) else (html, 0)


def strip_furniture(html: str) -> tuple[str, int]:
    gone = 0
    for tag in FURNITURE:
        pattern = re.compile(rf"(?ai)<{tag}\b[^>]*>")
        html, n = without(html, lambda h, p=pattern, t=tag: (m := opened(h, p)) and (*m, t), MOST_FURNITURE)
        gone += n
    return html, gone


def _udf(strip: Callable[[str], tuple[str, int]]):
    one = types.guarded(lambda t: (None, 0, None) if t is None else (*(strip(t) if "<" in t else (t, 0)), None), lambda t, error: (t, 0, error))

    @F.pandas_udf(types.struct("html string, removed long, error string"))
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in pages:
            yield pd.DataFrame([one(t) for t in s], columns=["html", "removed", "error"]).astype({"html": object, "error": object})

    return run


hidden_stripped = _udf(strip_hidden)
furniture_stripped = _udf(strip_furniture)
