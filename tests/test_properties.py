"""Properties of the functions that run in Python, on random inputs."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.functions import hashing, markup, shell, text, urls

SOME = settings(max_examples=100, deadline=None)


@SOME
@given(st.text(st.characters(max_codepoint=0x2FFF), min_size=1, max_size=12))
def test_punycode_undoes_the_codec(word):
    encoded = word.encode("punycode").decode()
    if not encoded.startswith("-"):
        assert urls.punycode_decode(encoded) == word


@SOME
@given(st.text(alphabet="0123456789abcxyz-", max_size=12))
def test_punycode_never_raises(label):
    got = urls.punycode_decode(label)
    assert got is None or isinstance(got, str)


@SOME
@given(st.text(max_size=40))
def test_fnv_of_units(word):
    h = 14695981039346656037
    data = word.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(data), 2):
        h = (h ^ int.from_bytes(data[i : i + 2], "little")) * 1099511628211 % 2**64
    assert hashing._fnv(word) == h


@SOME
@given(st.lists(st.sampled_from(["<div>", "</div>", '<div hidden>', "<p>", "</p>", '<p style="display:none">', "text", "<img hidden >", "<nav>", "</nav>", "é😀"]), max_size=12).map("".join))
def test_stripping_loses_no_visible_text_at_the_end(page):
    kept, gone = markup.strip_hidden(page + "TAIL")
    assert kept.endswith("TAIL") and gone == markup.utf16(page + "TAIL") - markup.utf16(kept) and markup.concealed(kept) is None


@SOME
@given(st.text(alphabet="ab '\"\\$`(){}|&;<>#*?\n", max_size=40))
def test_shell_reading_never_raises(command):
    assert len(shell.match(command)) == 8


@SOME
@given(st.text(alphabet="a'\"\\ b", max_size=30))
def test_open_quotes(command):
    quote, i = "", 0
    while i < len(command):
        c = command[i]
        if c == "\\" and quote != "'":
            i += 1
        elif c in "'\"" and quote in ("", c):
            quote = "" if quote else c
        i += 1
    assert shell.open_quotes(command) == bool(quote)


@SOME
@given(st.text(max_size=60))
def test_matching_form_is_stable(s):
    once = text.literal_for_matching(s)
    assert not re.search("  ", once)


def test_structural_stripping_equals_the_regular_expression():
    """The tag that conceals, as one expression would find it, which takes quadratic time on malformed pages."""
    S = markup.S
    one = re.compile(rf"""(?ai)<([a-z][a-z0-9]*)\b([^>]*?)(?:\bstyle{S}*={S}*(?:"[^"]*?{markup.CONCEALING}[^"]*?"|'[^']*?{markup.CONCEALING}[^']*?')|\baria-hidden{S}*={S}*(?:"true"|'true')|\bhidden(?=[>{S[1:]}))[^>]*>""")

    def end(html, tag, start):
        depth = 1
        for m in re.finditer(rf"(?ai)<(/?){tag}\b[^>]*>", html[start:]):
            depth += -1 if m[1] else 1
            if not depth:
                return start + m.end()
        return start

    def slow(html, find, name):
        while m := find(html):
            tag = name(m)
            html = html[: m.start()] + html[m.end() if tag in markup.ENDLESS else end(html, tag, m.end()) :]
        return html

    pieces = ["<div", "<p", "<br", "<hidden", "</div>", "</p>", ">", " ", "hidden", 'aria-hidden="true"', "aria-hidden='true'", 'style="', "style='", '"', "'", "display:none", "width:0;", "x", "<", "<nav", "</nav>", "<svg>", "</svg>", "<aside ", "text", "left: -999", "/"]
    rng = random.Random(1)
    for _ in range(20_000):
        html = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 22)))
        assert markup.strip_hidden(html)[0] == slow(html, one.search, lambda m: m[1].lower())
        want = html
        for tag in markup.FURNITURE:
            want = slow(want, re.compile(rf"(?ai)<{tag}\b[^>]*>").search, lambda m, tag=tag: tag)
        assert markup.strip_furniture(html)[0] == want


@pytest.mark.parametrize("piece", ["<a ", "<a hidden ", "<nav ", '<div style="display ', "<p style='", "<div hidden>x</div>"])
def test_malformed_pages_take_linear_time(piece):
    html = piece * (10**6 // len(piece))
    began = time.process_time()
    markup.strip_hidden(html), markup.strip_furniture(html)
    assert time.process_time() - began < 3
