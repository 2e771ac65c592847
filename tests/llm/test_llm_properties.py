"""Properties on random inputs, without a session."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import flac, language_model, secrets, sentence_pieces, simhash, url_filter

SOME = settings(max_examples=60, deadline=None)
with open(sentence_pieces.MODEL, "rb") as f:
    MODEL = f.read()


@SOME
@given(st.lists(st.binary(max_size=3000) | st.text(max_size=1500).map(str.encode), min_size=1, max_size=4))
def test_flac_round_trip(data):
    data = [flac.payload(d) for d in data]
    assert [(x + 128).astype(np.uint8).tobytes() for x in flac.decode_batch(flac.encode_batch(data))] == data


@SOME
@given(st.lists(st.text(max_size=200), min_size=1, max_size=5))
def test_pieces(texts):
    own, other = sentence_pieces.pieces(MODEL), sentence_pieces.reference(MODEL)
    ids = own.encode(texts)
    assert ids == other.encode(texts) and [own.decode(i) for i in ids] == [other.decode(i) for i in ids]


@SOME
@given(st.text(alphabet="aAbB0 :='\"secretTOKENapi_keyAKIAXYZ/+=.-é", max_size=200))
def test_base_spans(text):
    pattern = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    want = [(m.start(), 0, m.end()) for m in pattern.finditer(text) if len(m[2]) >= 6]
    want += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    want += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    assert secrets.base_spans(text) == sorted(want)


HOSTS, PATHS = st.sampled_from(["org", "a.org", "b.a.org", "x.com", "com", "ba.org"]), st.sampled_from(["", "/", "/a", "/a/", "/a/b", "/ab", "/a/b/c"])


@SOME
@given(st.lists(st.tuples(HOSTS, PATHS, st.sampled_from(["allow", "block"])), max_size=8), HOSTS, PATHS)
def test_trie_is_the_longest_match(rules, host, path):
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    assert url_filter.Trie(rules).match(host, path) == max(fits, default=None)


@SOME
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=2))
def test_close_fingerprints_share_an_anchor(x, flips):
    y = x
    for bit in flips:
        y ^= 1 << bit
    row, key = simhash.anchors_of_fingerprints(np.array([x, y], np.uint64))
    assert set(key[row == 0]) & set(key[row == 1])


@SOME
@given(st.dictionaries(st.integers(0, 2**64 - 1), st.integers(1, 10**6), min_size=1, max_size=60))
def test_filter_never_loses_a_count(counts):
    keys, n = np.array(list(counts), np.uint64), np.array(list(counts.values()))
    bits, size = language_model.slice_of(keys, n)
    assert (language_model.Filter(np.frombuffer(bits, np.uint8), np.array([0]), np.array([size])).level(keys) >= language_model.levels(n)).all()
