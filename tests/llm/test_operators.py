"""Every operator against a brute-force version or its SQL, and on odd rows."""

import collections
import functools
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import exact_dedup, flac, language_model, mixing, quality, secrets, sentence_pieces, simhash, token_counts, url_filter
from siltstone.llm.common import kept, marked
from siltstone.llm.components import components
from siltstone.llm.queries import ORACLE, QUERIES


def texts(duck):
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, small, duck, same, name):
    same(QUERIES[name](spark, small), duck.execute(ORACLE[name]))


# ---------------------------------------------------------------- op1


def slow_decode(data):
    """One sample after the other, as the format's description has it; 1 channel, no stereo."""
    at = 4
    while True:
        last, size = data[at] >> 7, int.from_bytes(data[at + 1 : at + 4], "big")
        if data[at] & 127 == 0:
            total = int.from_bytes(data[at + 14 : at + 22], "big") & (1 << 36) - 1
        at += 4 + size
        if last:
            break
    out = []
    while len(out) < total:
        start = at
        bits = "".join(f"{b:08b}" for b in data[at : at + 20_000])
        pos = 0

        def take(n):
            nonlocal pos
            pos += n
            return int(bits[pos - n : pos], 2) if n else 0

        def signed(n):
            v = take(n)
            return v - (1 << n) if v >> (n - 1) else v

        assert take(14) == 0x3FFE
        take(2)
        size, _ = take(4), take(4)
        take(8)
        lead = take(8)
        while lead & 0x40 and lead & 0x80:
            take(8)
            lead = lead << 1 & 0xFF
        n = take(8) + 1 if size == 6 else take(16) + 1 if size == 7 else flac.BLOCK_SIZES[size]
        take(8)
        kind = take(8) >> 1
        if kind == 0:
            x = [signed(8)] * n
        elif kind == 1:
            x = [signed(8) for _ in range(n)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            x = [signed(8) for _ in range(order)]
            c, shift = flac.FIXED.get(order, ()) if kind < 32 else (), 0
            if kind >= 32:
                p, shift = take(4) + 1, signed(5)
                c = [signed(p) for _ in range(order)]
            assert take(6) == 0
            k = take(4)
            while len(x) < n:
                q = 0
                while not take(1):
                    q += 1
                u = q << k | take(k)
                x.append((u >> 1 ^ -(u & 1)) + (sum(a * b for a, b in zip(c, x[::-1])) >> shift))
        out += x
        at = start + (pos + 7) // 8 + 2
    return out


def streams():
    rng = np.random.default_rng(1)
    data = [b"", b"a" * 100, bytes(rng.integers(0, 256, 5000, dtype=np.uint8)), ("the quick brown fox äöü " * 300).encode(), bytes(range(256)) * 20, bytes(rng.integers(60, 64, 3000, dtype=np.uint8))]
    return [flac.payload(d) for d in data]


def test_flac_round_trip_and_slow_decoder():
    data = streams()
    coded = flac.encode_batch(data)
    for d, s, x in zip(data, coded, flac.decode_batch(coded), strict=True):
        assert (x + 128).astype(np.uint8).tobytes() == d
        assert [v + 128 for v in slow_decode(s)] == list(d)
    bare = [s[:4] + b"\x80" + s[5:42] + s[flac.stream_info(s)["frames"] :] for s in coded]
    assert [(x + 128).astype(np.uint8).tobytes() for x in flac.decode_batch(bare)] == data
    kinds = {s[flac.frame_header(s, flac.stream_info(s)["frames"], flac.stream_info(s))["body"] // 8] >> 1 for s in coded}
    assert {0, 1} <= kinds and kinds & {8, 9, 33}


def test_flac_checksums():
    s = bytearray(flac.encode_batch([streams()[3]])[0])
    first = flac.stream_info(bytes(s))["frames"]
    for at in (first + 2, first + 40, len(s) - 1, 30):
        bad = bytearray(s)
        bad[at] ^= 4
        with pytest.raises(flac.BadStream):
            flac.decode_batch([bytes(bad)])
    with pytest.raises(flac.BadStream):
        flac.decode_batch([bytes(s[:-200])])


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, v, n):
        self.bits += f"{v & (1 << n) - 1:0{n}b}" if n else ""

    def rice(self, e, k):
        u = e << 1 if e >= 0 else (-e << 1) - 1
        self.bits += "0" * (u >> k) + "1"
        self.put(u, k)


def test_flac_stereo_partitions_escapes_and_high_orders():
    """A frame of 16 bits, mid and side: order 4, partitions with an escape, a long unary run, wasted bits."""
    rng = np.random.default_rng(3)
    left = np.cumsum(rng.integers(-60, 60, 64)).astype(int)
    right = left + rng.integers(-3, 4, 64) * 2
    right[40:] = left[40:]
    mid, side = (left + right) >> 1, left - right
    w = Writer()
    head = bytes([0xFF, 0xF8, 0x60, 0xA8]) + b"\x00" + bytes([63])
    head += bytes([flac.crc8(head)])

    def residual(x, c):
        return [int(x[t]) - sum(a * int(x[t - 1 - j]) for j, a in enumerate(c)) for t in range(len(c), len(x))]

    w.put((8 + 4) << 1, 8)
    for v in mid[:4]:
        w.put(int(v), 16)
    e = residual(mid, flac.FIXED[4])
    w.put(0, 2)
    w.put(2, 4)  # four partitions
    for p in range(4):
        part = e[max(0, 16 * p - 4) : 16 * p + 12]
        if p == 2:
            w.put(15, 4)
            w.put(12, 5)
            for v in part:
                w.put(v, 12)
        else:
            w.put(1 if p == 3 else 5, 4)
            for v in part:
                w.rice(v, 1 if p == 3 else 5)
    half = side >> 1  # one wasted bit
    w.put(8 << 1 | 1, 8)
    w.put(1, 1)
    w.put(1, 2)
    w.put(1, 4)  # two partitions with parameters of five bits
    for p in range(2):
        part = half[32 * p : 32 * p + 32]
        if p == 1 and not part[8:].any() and not part[:8].any():
            w.put(31, 5)
            w.put(0, 5)
        else:
            w.put(2, 5)
            for v in part:
                w.rice(int(v), 2)
    w.bits += "0" * (-len(w.bits) % 8)
    frame = head + int(w.bits, 2).to_bytes(len(w.bits) // 8, "big")
    crc = int(flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0])
    frame += crc.to_bytes(2, "big")
    both = np.stack([left, right], 1)
    md5 = hashlib.md5(both.astype("<i2").tobytes()).digest()
    info = (64).to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | 1 << 41 | 15 << 36 | 64).to_bytes(8, "big") + md5
    assert (flac.decode_batch([b"fLaC\x80\x00\x00\x22" + info + frame])[0] == both).all()


def test_flac_known_checksums():
    data = np.frombuffer(b"123456789", np.uint8)
    assert flac.crc8(b"123456789") == 0xF4
    assert flac.crc16(data, np.array([0]), np.array([9]))[0] == 0xFEE8


def test_flac_query(spark, small, duck):
    got = {r.doc_id: r for r in QUERIES["op1_flac"](spark, small).collect()}
    for i, t in texts(duck):
        data = flac.payload((t or "").encode())
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        x = [b - 128 for b in data]
        mean = sum(x) / len(x)
        c = [v - mean for v in x]
        turns = sum(a * b < 0 for a, b in zip(c, c[1:])) / (len(x) - 1)
        assert r.feature == f"n={len(x)};mean={mean:.4f};rms={math.sqrt(sum(v * v for v in x) / len(x)):.4f};zcr={turns:.4f};step={max(abs(a - b) for a, b in zip(x, x[1:]))}"
        assert r.blocks == -(-len(data) // 4096)
    media = {r.doc_id: r.media for r in flac.with_media(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert {i: (len(m), hashlib.sha256(m).hexdigest()) for i, m in media.items()} == {i: (r.media_bytes, r.media_sha256) for i, r in got.items()}


def test_flac_odd(odd, empty):
    got = flac.stored_and_read(odd).collect()
    assert len(got) == odd.count() and len({r.media_sha256 for r in got if r.n_bytes == 0}) == 1
    assert flac.stored_and_read(empty).count() == 0
    media = flac.with_media(odd.filter("doc_id in (1, 6, 8)"))
    blocks = flac.pcm_blocks(media).collect()
    for doc_id, t in ((r.doc_id, r.text) for r in odd.filter("doc_id in (1, 6, 8)").collect()):
        own = sorted((b for b in blocks if b.doc_id == doc_id), key=lambda b: b.block)
        assert [b.sample_offset for b in own] == [4096 * i for i in range(len(own))]
        back = b"".join(b.pcm for b in own)
        assert (np.frombuffer(back, np.int8).astype(int) + 128).astype(np.uint8).tobytes() == flac.payload(t.encode())


# ---------------------------------------------------------------- op2


def brute_base(t):
    a = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    out = [(m.start(), 0, m.end()) for m in a.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def planted(rng, n):
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_secret_spans(spark, small, duck):
    got = {r.doc_id: r for r in QUERIES["op2_secrets"](spark, small).collect()}
    for i, t in texts(duck):
        base, r = brute_base(t or ""), got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in base) for j in range(3)]
        assert r.base_sha256 == hashlib.sha256(secrets.written(base).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == [x for x in secrets.written(base).split(",") if x]


def test_secret_patterns():
    for t in ('api_key = "abcdef123"', "PASSWD:\"x\" token='secret=abcdef'", "\u017fecret=abcdefg", "secret=token = abcdefgh", "xAKIA" + "A" * 16 + "b", "AKIAAKIA12", "é 😀 " + "0f" * 12, "TOKEN:" + " " * 3 + "a.b-c/d+e"):
        assert secrets.base_spans(t) == brute_base(t)


def test_random_tokens_found_and_text_left(spark):
    rng = random.Random(5)
    keys = [planted(rng, 32) for _ in range(40)]
    plain = ["Donaudampfschifffahrtsgesellschaftskapitaen", "get_elements_by_tag_name_and_attribute", "path/to/some/file/name/here/index", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "abcabcabcabcabcabcabcabcabc"]
    docs = spark.createDataFrame([(i, f"before {k} after") for i, k in enumerate(keys)] + [(100 + i, f"a {w} b") for i, w in enumerate(plain * 20)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.secrets(docs).collect()}
    assert sum(got[i] == "random:7:39" for i in range(40)) >= 38
    assert not any("random" in got[100 + i] for i in range(len(plain) * 20))


def ordinary(rng, vocabulary):
    """A token of 20 characters or more such as text and its markup hold: words run together, names in code, paths, dates."""
    w = [rng.choice(vocabulary) for _ in range(12)]
    kind = rng.randrange(6)
    t = ""
    for x in w:
        t += {0: x, 1: x.capitalize(), 2: "_" + x, 3: "/" + x, 4: "-" + x, 5: x + (str(rng.randrange(1990, 2030)) if rng.random() < 0.1 else "")}[kind]
        if len(t) >= 20 + rng.randrange(30):
            break
    return t.strip("_/-").ljust(20, "s")


@pytest.fixture(scope="module")
def vocabulary(duck):
    return sorted({w for _, t in texts(duck) for w in re.findall("[a-z]{2,}", t or "")})


def test_p_values_of_ordinary_text_are_valid(vocabulary):
    rng = random.Random(2)
    found = [secrets.evidence(ordinary(rng, vocabulary)) for _ in range(20_000)]
    for least in (1, 2, 3):
        assert sum(x is not None and x[1] >= least for x in found) <= 10**-least * len(found)


def test_false_discoveries_stay_below_the_rate(spark, vocabulary):
    """Keys among a hundred times as many ordinary tokens: most long keys are found, and of what is found hardly anything is ordinary."""
    rng = random.Random(3)
    false = true = 0
    for seed in range(3):
        keys = [planted(rng, n) for n in (24, 32, 40, 64) for _ in range(15)]
        rows = [(i, f"before {k} after") for i, k in enumerate(keys)] + [(1000 + i, f"a {ordinary(rng, vocabulary)} b") for i in range(6000)]
        got = secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        true += sum(r.n_random for r in got if 15 <= r.doc_id < 1000)
        false += sum(r.n_random for r in got if r.doc_id >= 1000)
    assert true >= 0.9 * 3 * 45 and false <= 0.02 * true


def test_long_texts_with_many_spans_take_linear_time():
    rng = random.Random(4)
    text = " ".join(rng.choice((f"{rng.getrandbits(128):032x}", planted(rng, 24), "word", f"token={rng.getrandbits(64):x}")) for _ in range(400_000))
    assert len(text) > 8 * 10**6
    began = time.process_time()
    spans = secrets.base_spans(text)
    assert len(spans) > 10**5 and time.process_time() - began < 10
    few = text[:400_000]
    taken = [s for s in spans if s[2] <= 400_000]
    began = time.process_time()
    found, others = secrets.candidates(few, taken)
    assert time.process_time() - began < 10
    tested = [t.span() for t in secrets.TOKEN.finditer(few) if not any(t.start() < e and s < t.end() for s, _, e in taken)]
    assert len(found) + sum(others.values()) == sum(secrets.evidence(few[a:z]) is not None for a, z in tested) and {(f["start"], f["end"]) for f in found} <= set(tested)
    assert secrets.evidence("aB3" * 10**6)[1] == 0 and time.process_time() - began < 30


def test_battery_p_values():
    rng = np.random.default_rng(0)
    x = rng.chisquare(15, 200_000)
    assert abs((x > 30).mean() - secrets.chi_squared_tail(30, 15)) < 2e-3
    assert abs((rng.binomial(30, 0.12, 200_000) >= 7).mean() - secrets.binomial_tail(30, 7, 0.12)) < 2e-3


def test_secrets_odd(odd, empty):
    got = secrets.secrets(odd).collect()
    assert len(got) == odd.count() and secrets.secrets(empty).count() == 0
    assert {r.n_hex for r in got if r.doc_id == -4} == {2}
    assert all(r.spans == "" for r in got if r.doc_id in (3, 4, 5))


# ---------------------------------------------------------------- op3


def brute_lm(rows):
    tokens = {i: [*words(t), None] for i, t in rows}
    c = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in tokens.items()}


def test_language_model(spark, small, duck):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = brute_lm(texts(duck))
    got = language_model.scored(docs).collect()
    assert len(got) == len(want)
    for r in got:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and math.isfinite(r.score) and r.score < 0
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def slow_scores(rows, buckets):
    """The scores in plain Python: sets of bits for the filter, integers for the hashes."""
    M, end = (1 << 64) - 1, 0x9E3779B97F4A7C15
    shift = 64 - (buckets - 1).bit_length()

    def mix(x):
        x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & M
        x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 & M
        return x ^ x >> 33

    def pair(a, b):
        rest = max(0, 16 - (buckets - 1).bit_length())
        return mix((a * 0x9E3779B97F4A7C15 + (b ^ b >> 31)) & M) >> rest << rest

    def level(c):
        n = 0
        while 1.5**n <= c + 1e-9:
            n += 1
        return n

    def bits(key, j, size):
        x = mix((key + 0xD6E8FEB86659FD93 * j) & M)
        return [((x & 0xFFFFFFFF) + p * (x >> 32 | 1)) % size for p in range(4)]

    hashed = {i: [*(xxhash.xxh3_64_intdigest(w) for w in words(t)), end] for i, t in rows}
    grams = {i: [*zip(h, map(pair, [end, *h], h))] for i, h in hashed.items()}
    train = [g for i, gs in grams.items() if zlib.crc32(str(i).encode()) % 10 for g in gs]
    one, two = collections.Counter(w for w, _ in train), collections.Counter(p for _, p in train)
    slices = collections.defaultdict(list)
    for c in (one, two):
        for k, n in c.items():
            slices[k >> shift] += [(k, j) for j in range(1, level(n) + 1)]
    size = {b: max(64, len(e) * 8 // 64 * 64) for b, e in slices.items()}
    on = {(b, x) for b, e in slices.items() for k, j in e for x in bits(k, j, size[b])}

    @functools.cache
    def guess(key):
        b, j = key >> shift, 0
        while b in size and all((b, x) in on for x in bits(key, j + 1, size[b])):
            j += 1
        lo, hi = math.ceil(1.5 ** (j - 1) - 1e-9), math.ceil(1.5**j - 1e-9) - 1
        return (lo + max(hi, lo)) / 2 if j else 0.0

    total, out = len(train) + 0.1 * (len(one) + 1), {}
    for i, gs in grams.items():
        out[i], before = 0.0, guess(end)
        for w, p in gs:
            g = guess(w)
            out[i] += math.log10((min(guess(p), g, before) + language_model.SMOOTHING * (g + 0.1) / total) / (before + language_model.SMOOTHING))
            before = g
    return out


def test_language_model_scores_equal_brute(spark, small, duck):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = texts(duck)
    want = slow_scores(rows, language_model.buckets_for(sum(len((t or "").encode()) for _, t in rows)))
    for most in (1 << 26, 0):
        assert {r.doc_id: r.score for r in language_model.scored(docs, max_filter=most).collect()} == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("most", [1 << 26, 0])
def test_language_model_does_not_depend_on_the_layout(spark, small, most):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one, *others = ({r.doc_id: tuple(r) for r in language_model.scored(docs.repartition(n), max_filter=most).collect()} for n in (1, 29, 100))
    for other in others:
        assert other.keys() == one.keys()
        assert all(other[i] == pytest.approx(one[i], rel=1e-12) for i in one)


def test_filter_levels():
    rng = np.random.default_rng(2)
    keys, counts = rng.integers(0, 1 << 63, 5000, dtype=np.uint64), np.minimum(rng.zipf(1.5, 5000), 10**6)
    bits, size = language_model.slice_of(keys, counts)
    f = language_model.Filter(np.frombuffer(bits, np.uint8), np.array([0]), np.array([size]))
    got, want = f.level(keys), language_model.levels(counts)
    assert (got >= want).all() and (got == want).mean() > 0.9
    assert (f.level(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)) > 0).mean() < 0.06
    mean = language_model.expected()
    for c in (1, 2, 3, 10, 1000):
        assert 0.66 * c <= mean[language_model.levels(np.array([c]))[0]] <= 1.5 * c


def test_language_model_odd(spark, odd, empty):
    got = language_model.scored(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (3, 4, 5))
    assert language_model.scored(empty).count() == 0
    held = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    assert {(r.train_tokens, r.n_known) for r in language_model.scored(held).collect()} == {(0, 0)}


def test_language_model_beyond_the_broadcast(spark, small, odd):
    """A filter larger than the bound scores as the broadcast one does."""
    for docs in (spark.read.parquet(f"{small}/documents.parquet"), odd):
        want, got = (sorted(language_model.scored(docs, max_filter=m).collect(), key=str) for m in (1 << 26, 0))
        assert len(got) == len(want) > 0
        for a, b in zip(want, got, strict=True):
            assert a[:5] == b[:5] and a.base_score == pytest.approx(b.base_score, rel=1e-12) and a.score == pytest.approx(b.score, rel=1e-12)


# ---------------------------------------------------------------- op4


def test_exact_odd(odd, empty):
    got = exact_dedup.exact_groups(odd).collect()
    assert len(got) == odd.count() and exact_dedup.exact_groups(empty).count() == 0
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert {(r.keep_id, r.group_size, r.kept) for r in by[2]} == {(2, 3, True)} and by[1][0].keep_id == 2 and not by[1][0].kept
    assert {r.keep_id for i in (3, 4, 5) for r in by[i]} == {5} and by[10][0].kept
    assert exact_dedup.drop_exact(odd).columns == odd.columns


def test_exact_keeps_one_row_of_each_text(spark, odd):
    """Also of rows without a doc_id, or with a repeated one."""
    squeezed = lambda r: re.sub(r"[ \t-\r]", "", r.text or "")
    got = [squeezed(r) for r in exact_dedup.drop_exact(odd).collect()]
    assert sorted(got) == sorted({squeezed(r) for r in odd.collect()})
    docs = spark.createDataFrame([(None, "own"), (None, "twice"), (None, "twice"), (1, "twice"), (2, "x"), (2, "y"), (3, "y")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in exact_dedup.drop_exact(docs).collect()) == [(0, "own"), (1, "twice"), (2, "x"), (2, "y")]
    hot = spark.range(400).selectExpr("IF(id % 3 = 0, NULL, id % 7) AS doc_id", "IF(id < 300, 'hot', concat('own ', id)) AS text")
    assert exact_dedup.drop_exact(hot).count() == 101


def test_exact_heavy(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN concat('hot text', repeat(' ', int(id % 5))) ELSE concat('own ', id % 1500) END AS text")
    got = exact_dedup.exact_groups(docs, heavy=4, tracked=64).groupBy("keep_id", "group_size").count().collect()
    assert all(r["count"] == r.group_size for r in got)
    assert [(r.keep_id, r.group_size) for r in got if r.group_size > 10] == [(9, 1000)]


# ---------------------------------------------------------------- op5


def test_mixing_targets_and_hot_source(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "repeat('w ', int(1 + id * 7919 % 97)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 101 = 0 THEN NULL ELSE concat('s', id % 5) END AS source")
    got = mixing.mixture(docs)
    by = got.selectExpr("*", "target AS t").groupBy("source_size", "t").agg({"taken": "sum", "size": "sum"}).collect()
    for r in by:
        assert r["sum(size)"] == r.source_size and r.t <= 2 * r.source_size and abs(r["sum(taken)"] - r.t) < 0.03 * r.t + 100
    assert got.filter("taken > 2 * size OR copies > 2").count() == 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.mixture(docs).collect()))


def test_mixing_odd(odd, empty):
    got = mixing.mixture(odd).collect()
    assert len(got) == odd.count() and mixing.mixture(empty).count() == 0 and all(r.taken <= 2 * r.size for r in got)
    some = mixing.mixed(odd.filter("doc_id > 4"))
    assert some.columns == odd.columns and some.count() >= 1


def test_mixing_of_rows_without_or_with_repeated_ids(spark, odd):
    many = spark.range(600).selectExpr("IF(id % 3 = 0, NULL, id % 5) AS doc_id", "concat('w', id, repeat(' w', int(id % 9))) AS text", "concat('s', id % 4) AS source")
    for docs in (odd, many):
        out = collections.Counter(r.text for r in mixing.mixed(docs).collect())
        have = collections.Counter(r.text for r in docs.collect())
        assert out and all(n <= 2 * have[t] for t, n in out.items())
        want = mixing.mixture(docs).agg({"copies": "sum"}).first()[0]
        assert sum(out.values()) == want


# ---------------------------------------------------------------- op6


def brute_fingerprint(t):
    w = words(t)
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b) and find(a) != find(b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_query(spark, small, duck):
    rows = texts(duck)
    fp = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash"](spark, small).collect()}
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def test_every_pair_within_two_bits_meets(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base.tolist():
        for _ in range(30):  # chains, and a dense cluster around the first
            x ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
            fps.add(x)
    for _ in range(200):
        fps.add(int(base[0]) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(s, bytearray(x.to_bytes(8, "big"))) for s, x in zip(signed, fps, strict=True)], "node long, sig binary")
    found = {r.node: r.root for r in components(simhash.fingerprint_links(nodes), "a", "b").collect()}
    mask = (1 << 64) - 1
    assert {n: found.get(n, n) for n in signed} == brute_components(sorted(signed), lambda a, b: ((a ^ b) & mask).bit_count() <= 2)


def test_code_is_perfect():
    patterns, first, many = simhash.covering()
    assert many[0].tolist() == [1] * 2048 and many.sum(1).tolist() == [2048, 10903, 44552]


def test_flood_equals_brute():
    rng = np.random.default_rng(6)
    check = (rng.integers(0, 2, (300, 1)) * 0xFFFF ^ (1 << rng.integers(0, 16, (300, 1)))).astype(np.uint64)
    root = simhash.flood(check, 2)
    want = brute_components(range(300), lambda a, b: int(check[a, 0] ^ check[b, 0]).bit_count() <= 2)
    assert root.tolist() == [want[i] for i in range(300)]


@pytest.mark.parametrize("most", [0, 1, 2])
def test_neighbours_equal_brute(monkeypatch, most):
    monkeypatch.setattr(simhash, "POINTS", 5000)
    x = np.unique(np.random.default_rng(most).integers(0, 1 << 12, 700, dtype=np.uint64) << np.uint64(20 * most))
    want = brute_components(range(len(x)), lambda a, b: int(x[a] ^ x[b]).bit_count() <= most)
    assert simhash.neighbours(x, most).tolist() == [want[i] for i in range(len(x))]


def test_a_million_fingerprints_at_one_anchor():
    rng = np.random.default_rng(3)
    fp = np.unique((rng.integers(0, 1 << 18, 1_100_000, dtype=np.uint64) | np.uint64(0xABCDE << 40)) ^ (np.uint64(1) << rng.integers(18, 64, 1_100_000).astype(np.uint64)))
    assert len(fp) > 10**6
    root = simhash.connected(np.zeros(len(fp), np.int64), fp[:, None], 2)
    assert (root == 0).all()


def test_crowded_anchors_are_split(spark):
    """The same components, and no key with more than a small part of the crowd."""
    rng = np.random.default_rng(5)
    fps = np.unique(np.uint64(0xABCDE << 40) | rng.integers(0, 1 << 18, 400, dtype=np.uint64) ^ (rng.integers(0, 2, 400, dtype=np.uint64) << np.uint64(50))).tolist()
    nodes = spark.createDataFrame([(x, bytearray(x.to_bytes(8, "big"))) for x in fps], "node long, sig binary")
    crowds = simhash.crowded(nodes, 2, 100)
    row, key = simhash.split_anchors(np.array(fps, np.uint64), 2, crowds)
    assert len(crowds) and np.unique(key[(key >> 6 & 3) > 0], return_counts=True)[1].max() < 40
    want = brute_components(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 2)
    assert len(set(want.values())) < len(fps)
    for crowd in (None, 100):
        found = {r.node: r.root for r in components(simhash.fingerprint_links(nodes, 2, crowd), "a", "b").collect()}
        assert {n: found.get(n, n) for n in fps} == want


@pytest.mark.parametrize("held", [10, 10**6])
def test_spanning_pairs_connect_what_all_pairs_do(monkeypatch, held):
    monkeypatch.setattr(simhash, "PAIRS", held)
    rng = np.random.default_rng(9)
    keys, label, check = rng.integers(0, 5, 300), rng.integers(0, 60, 300), rng.integers(0, 1 << 16, (300, 2), dtype=np.uint64)
    by = np.lexsort((label, keys))
    keys, label, check = keys[by], label[by], check[by]

    def near(i, j):
        return keys[i] == keys[j] and (label[i] == label[j] or sum(int(x).bit_count() for x in check[i] ^ check[j]) <= 10)

    i, j = simhash.spanned(keys, label, check, 10)
    assert all(near(*p) and label[p[0]] != label[p[1]] for p in zip(i, j, strict=True))
    same = {(a, b) for a in range(300) for b in range(300) if keys[a] == keys[b] and label[a] == label[b]} | set(zip(i.tolist(), j.tolist(), strict=True))
    assert brute_components(range(300), near) == brute_components(range(300), lambda a, b: (a, b) in same or (b, a) in same)
    labels = len({(k, x) for k, x in zip(keys.tolist(), label.tolist(), strict=True)})
    assert len(i) == labels - len(set(brute_components(range(300), near).values()))


@pytest.mark.parametrize("held", [10, 10**6])
def test_all_pairs_are_named_or_their_rows_told(monkeypatch, held):
    monkeypatch.setattr(simhash, "PAIRS", held)
    rng = np.random.default_rng(19)
    keys, label, check = rng.integers(0, 5, 300), rng.integers(0, 60, 300), rng.integers(0, 1 << 16, (300, 2), dtype=np.uint64)
    by = np.lexsort((label, keys))
    keys, label, check = keys[by], label[by], check[by]
    want = {(a, b) for a in range(300) for b in range(a, 300) if keys[a] == keys[b] and label[a] != label[b] and sum(int(x).bit_count() for x in check[a] ^ check[b]) <= 10}
    for each in (0, 0.3, 1000):
        *some, (rows, _) = simhash.named(keys, label, check, 10, each)
        got = {p for a, b in some for p in zip(a.tolist(), b.tolist(), strict=True)}
        assert got <= want and {x for p in want - got for x in p} <= set(rows.tolist())
        assert (got == want and not len(rows)) == (each == 1000)


@pytest.mark.parametrize("each", [8, 0.3])
def test_a_refused_pair_hides_no_similar_one(spark, monkeypatch, each):
    """The signatures of 0 and 2 are nearer to that of 1, whose text is another, than to each other."""
    monkeypatch.setattr(simhash, "EACH", each, raising=False)
    rng = random.Random(5)
    base, other = (" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(2))
    docs = kept(spark.createDataFrame([(0, base), (1, other), (2, base + " more")], "row long, text string"), "docs")
    check = 8 * (simhash.WORDS - 2 * simhash.CHECK_WORDS)
    sigs = [bytes(check) + (bytes([c] * 4) + bytes(12)) * 2 + bytes(16) for c in (0, 1, 3)]
    nodes = kept(spark.createDataFrame(list(enumerate(map(bytearray, sigs))), "node long, sig binary"), "nodes")
    sketches = kept(spark.createDataFrame([(i, bytearray(simhash.sketch(np.arange(1, 9, dtype=np.uint64) << np.uint64(56)))) for i in range(3)], "node long, sketch binary"), "sketches")
    found = simhash.similar_roots(nodes, sketches, docs, "text", 5, "row").collect()
    assert {r.node: r.root for r in found} == {0: 0, 1: 1, 2: 0}


def one_word_apart(n, rng, size=60):
    """n texts that differ from one text in a word or two each, every tenth from the text before it: similar to few, near to all."""
    base, out = [f"w{rng.randrange(5000)}" for _ in range(size)], []
    for i in range(n):
        w = out[-1].split() if i % 10 == 9 else list(base)
        for at in rng.sample(range(5, size - 5), 1 if i % 10 == 9 else 2):
            w[at] = f"new{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def similar_components(texts):
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    return brute_components(range(len(texts)), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))


@pytest.mark.parametrize("part_bytes", [8 << 20, 20_000])
def test_a_crowd_of_near_texts_makes_no_row_for_each_pair(spark, monkeypatch, part_bytes):
    """No table that is kept has more than a few rows for each text, and groups are those of brute force, in one tile or many."""
    monkeypatch.setattr(simhash, "PART_BYTES", part_bytes, raising=False)
    counts = []

    def counted(df, *args, **named):
        out = kept(df, *args, **named)
        counts.append(out.count())
        return out

    monkeypatch.setattr(simhash, "kept", counted)
    texts = one_word_apart(400, random.Random(31))
    want = set(similar_components(texts).values())
    assert 250 < len(want) < 400
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_similar(docs).collect()} == want
    assert max(counts) <= 10 * len(texts)


def test_alike_compares_every_pair_of_a_tile():
    texts = one_word_apart(150, random.Random(32)) + one_word_apart(60, random.Random(33), 300) + ["", "a b", "a b c d e f"]
    sets = [simhash.shingle_set(t, 5) for t in texts]
    sketches = np.stack([np.frombuffer(simhash.sketch(h), np.uint8) for h in sets])
    part = np.arange(len(texts)) % 3
    whole = similar_components(texts)

    def similar(a, b):
        return 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))

    i, j = simhash.alike(part, sketches, sets, True)
    assert all(similar(*p) for p in zip(i, j, strict=True)) and len(i) == len(texts) - len(set(whole.values()))
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    assert brute_components(range(len(texts)), lambda a, b: (a, b) in found or (b, a) in found) == whole
    i, j = simhash.alike(part, sketches, sets, False)
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    assert brute_components(range(len(texts)), lambda a, b: (a, b) in found or (b, a) in found) == brute_components(range(len(texts)), lambda a, b: part[a] != part[b] and similar(a, b))


def test_groups_of_all_sizes_are_connected():
    """Groups compared by shifts, many together and one by one."""
    rng = np.random.default_rng(41)
    for size in (5, 60, 300):
        keys, check = np.repeat(np.arange(4), size), rng.integers(0, 1 << 10, (4 * size, 2), dtype=np.uint64)
        root = simhash.connected(keys, check, 3)
        want = brute_components(range(4 * size), lambda a, b: keys[a] == keys[b] and sum(int(x).bit_count() for x in check[a] ^ check[b]) <= 3)
        assert root.tolist() == [want[a] for a in range(4 * size)]


def test_blocks_take_turns_and_none_is_left_out(spark, monkeypatch):
    """Pairs that are equal in one block and its check words only, for each block; at most a quarter of the keys of all are shuffled at once."""
    turns, links = [], simhash._links

    def looked(nodes, keyed, *args):
        turns.append(keyed(np.zeros((1, simhash.WORDS + 2), np.uint64))[1] >> simhash.BLOCK_BITS)
        return links(nodes, keyed, *args)

    monkeypatch.setattr(simhash, "_links", looked)
    rng, sigs, first = np.random.default_rng(47), [], simhash.WORDS - 2 * simhash.CHECK_WORDS
    for block in range(simhash.BLOCKS):
        equal = np.zeros(64 * simhash.WORDS, bool)
        at = np.arange(simhash.BLOCK_BITS)
        equal[simhash.BLOCK_BITS * block + at if block < simhash.RUNS else simhash.RUNS * at + block - simhash.RUNS] = True
        word = block * simhash.BLOCK_BITS // 64
        other = word < first + simhash.CHECK_WORDS if first <= word < simhash.WORDS else block % 2
        equal[64 * (first + simhash.CHECK_WORDS * other) :][: 64 * simhash.CHECK_WORDS] = True
        x = rng.integers(0, 2, len(equal)) > 0
        sigs += [bytearray(np.packbits(bits).tobytes() + bytes(16)) for bits in (x, np.where(equal, x, ~x))]
    nodes = kept(spark.createDataFrame(list(enumerate(sigs)), "node long, sig binary"), "nodes")
    found = simhash.similar_links(nodes).collect()
    assert sorted((r.a, r.b) for r in found) == [(2 * b, 2 * b + 1) for b in range(simhash.BLOCKS)]
    assert sorted(np.concatenate(turns).tolist()) == list(range(simhash.BLOCKS))
    assert max(map(len, turns)) <= simhash.BLOCKS // 4


def test_links_that_are_known_are_not_found_again(spark):
    """50 signatures that are equal in all blocks give 49 links, not as many in each turn."""
    sig = bytearray(np.random.default_rng(53).bytes(8 * simhash.WORDS + 16))
    nodes = kept(spark.createDataFrame([(i, sig) for i in range(50)], "node long, sig binary"), "nodes")
    assert sorted((r.a, r.b) for r in simhash.similar_links(nodes).collect()) == [(0, i) for i in range(1, 50)]


def test_keys_hold_little_of_what_is_not_similar():
    """Of 0.8 all but one in 1,000 meet, and two signatures at random share a key with a chance of 1 in 400: at 3,000,000 texts a key holds 46."""
    rng = np.random.default_rng(23)
    x, other = rng.integers(0, 1 << 64, (2, 4000, simhash.WORDS), dtype=np.uint64)
    differ = rng.random((4000, 64 * simhash.WORDS)) < np.arccos(1.6 / 1.8) / np.pi
    met = []
    for y in (x ^ np.packbits(differ, axis=1).view(">u8").astype(np.uint64), other):
        (row, key, check), (row_, key_, check_) = simhash.keys_of_signatures(x), simhash.keys_of_signatures(y)
        assert (row == row_).all()
        near = np.bitwise_count(check ^ check_).sum(1) <= simhash.CHECK_BITS
        met.append((len(np.unique(row[(key == key_) & near])), int((key == key_).sum())))
    assert met[0][0] >= 3996 and met[1][0] == 0 and met[1][1] <= 4000 * simhash.BLOCKS / 2**16 * 2
    assert len(key) == 4000 * simhash.BLOCKS


def test_sketches_leave_out_what_is_clearly_less_similar():
    rng = np.random.default_rng(12)
    for size in (3, 30, 200, 2000):
        whole = rng.integers(0, 1 << 63, (400, size), dtype=np.uint64) * np.uint64(2)
        for share, least, most in ((0.9, 1, 1), (0.82, 0.98, 1), (0.3, 0, {3: 1, 30: 1}.get(size, 0.02))):
            cut = round(size * (1 - share) / 2)
            x, y = whole[:, : size - cut], whole[:, cut:]
            similarity = (size - 2 * cut) / size
            if similarity < 0.8 and least:
                continue
            sketches = [np.stack([np.frombuffer(simhash.sketch(np.unique(h)), np.uint8) for h in z]) for z in (x, y)]
            assert least <= simhash.may_be_similar(*sketches).mean() <= most
    assert simhash.sketch(np.empty(0, np.uint64)) == bytes(256)


def test_bitmaps_mark_rows(spark):
    rows = spark.range(0, 200_000, 1, 5).withColumn("row", F.monotonically_increasing_id())
    numbers = rows.filter("id % 3 = 0").selectExpr("row", "id % 2 AS odd")
    found, (third, odd) = marked(rows, "row", numbers, "row", F.lit(True), F.col("odd") == 1)
    got = found.select("id", third.alias("third"), odd.alias("odd")).agg(F.count_if(F.col("third") == (F.col("id") % 3 == 0)), F.count_if(F.col("odd") == (F.col("id") % 6 == 3))).first()
    assert tuple(got) == (200_000, 200_000)
    none, (never,) = marked(rows, "row", numbers.limit(0), "row", F.lit(True))
    assert none.filter(never).count() == 0 and none.count() == 200_000


def variant(text, rng, share):
    w = text.split()
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_similar_documents_go_and_others_stay(spark):
    rng = random.Random(8)
    rows, group = [], {}
    for g in range(60):
        text = " ".join(f"w{rng.randrange(5000)}" for _ in range(300))
        for c in range(3):
            group[len(rows)] = g
            rows.append((len(rows), variant(text, rng, 0.012) if c else text))
    single = [(1000 + i, " ".join(f"w{rng.randrange(5000)}" for _ in range(200))) for i in range(200)]
    stay = {r.doc_id for r in simhash.drop_similar(spark.createDataFrame(rows + single, "doc_id long, text string")).collect()}
    assert {i for i, _ in single} <= stay
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    close = [(a, b) for a in group for b in group if a < b and group[a] == group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert close and sum(a in stay and b in stay for a, b in close) <= 0.02 * len(close)
    assert {group[i] for i in stay if i < 1000} == set(range(60))


def test_similar_decides_by_the_sets(spark):
    """Texts of similarity 0.55 to 0.78 all stay; groups are those of brute force; rows need no doc_id of their own."""
    rng = random.Random(11)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts.append(base)
        for share in (0.004, 0.012, 0.03, 0.04, 0.05):
            texts.append(variant(" ".join(base), rng, share).split())
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = brute_components(range(len(texts)), lambda a, b: a // 6 == b // 6 and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    stay = {r.doc_id for r in simhash.drop_similar(docs).collect()}
    want = set(root.values())
    assert want <= stay and len(stay - want) <= 0.02 * len(texts)
    blank = docs.selectExpr("IF(doc_id % 2 = 0, NULL, 7) AS doc_id", "text")
    assert len(want) <= simhash.drop_similar(blank).count() <= len(want) + 0.02 * len(texts)
    short = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e f"), (3, "A b c d e")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_similar(short).collect()) == [1, 2]


def test_simhash_odd(odd, empty):
    got = simhash.fingerprint_groups(odd).collect()
    assert len(got) == odd.count() and simhash.fingerprint_groups(empty).count() == 0
    assert {(r.fingerprint, r.component_id) for r in got if r.doc_id in (3, 4, 5)} == {("0" * 16, 3)}
    out = simhash.drop_similar(odd)
    assert out.columns == odd.columns and simhash.drop_similar(empty).count() == 0
    assert {1, 3, 6, 8, 9} <= {r.doc_id for r in out.select("doc_id").collect()}


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 200)] + [(500, 501 + i) for i in range(300)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501 + i: 500 for i in range(300)}


# ---------------------------------------------------------------- op7


def test_urls(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.org/es/x", "https://a.b.example.org/en/123?q#f", "ftp://org/x", "x://org", "http://notexample.org/es/", "http://u@fr.com:80/fr/", "http://shop.com/fr/a", "http://com/de/", "a://b://c.org/", "http://é.ORG/ü"]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    listed = [r.asDict() for r in url_filter.judge(pages, url_filter.RULES).orderBy("page_id").collect()]
    assert [r["rule"] for r in listed] == [None, None, None, "example.org/es/", "example.org/en/1", "org/", None, "org/", None, "com/fr/", "com/de/", None, "org/"]
    assert [r["verdict"] for r in listed].count("block") == 3
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    for most in (100, 1):
        again = [r.asDict() for r in url_filter.judge(pages, rules, max_rules=most).select(*url_filter.judge(pages, url_filter.RULES).columns).orderBy("page_id").collect()]
        assert again == listed
    assert url_filter.judge(pages.limit(0), url_filter.RULES).count() == 0
    many = [(f"h{i % 50}.{t}", f"/{'abc'[i % 3]}{i % 7}", "block" if i % 2 else "allow") for i in range(300) for t in ("com", "org")]
    asked = spark.createDataFrame([(i, f"http://x.h{i % 60}.{'com' if i % 2 else 'org'}/{'abc'[i % 3]}{i % 11}/y") for i in range(500)], "page_id long, url string")
    one, two = (sorted(map(tuple, url_filter.judge(asked, many, max_rules=m).collect())) for m in (10**6, 10))
    assert one == two and len({r[-1] for r in one}) == 2


# ---------------------------------------------------------------- op8


def area(y, p):
    good, bad = p[y == 1], p[y == 0]
    return ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2) if len(good) and len(bad) else 1.0


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.judged(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in rows if r.held_out]
    y, p = np.array([r.quality for r in held]), np.array([r.score for r in held])
    assert area(y, p) > 0.97 and (p[y == 1] >= 0.3).mean() > 0.97


def slow_statistics(text):
    """Each statistic from its meaning, character by character and word by word."""
    data = (text or "").encode()
    if not data:
        return [0.0] * 32
    n, char = len(data), collections.Counter(data)
    share = lambda test: sum(c for b, c in char.items() if test(b)) / n
    among = lambda chars: share(lambda b: chr(b) in chars and b < 128)
    named = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;|!?#$%*&"
    out = [math.log(1 + n), among("abcdefghijklmnopqrstuvwxyz"), among("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), among("0123456789"), among(" \t"), among("\n\r"), among("."), among(",;"), among("|"), among("!?"), among("#$%"), among("*&")]
    out += [share(lambda b: 32 < b < 127 and chr(b) not in named), share(lambda b: b > 127), -sum(c / n * math.log2(c / n) for c in char.values())]
    ws, lines = re.findall(rb"[^\x20\x09-\x0D]+", data), [x for x in re.split(rb"\n", data) if re.search(rb"[^\x20\x09-\x0D]", x)]
    if not ws:
        return [*out, *[0.0] * 13, len(zlib.compress(data, 1)) / n, 0.0, 0.0, 0.0]
    m, count, size = len(ws), collections.Counter(ws), [len(w) for w in ws]
    deviation = lambda x: math.sqrt(sum(v * v for v in x) / len(x) - (sum(x) / len(x)) ** 2)
    top, wide, signs = sorted(count.values())[::-1], [len(x) for x in lines], b"!?#$%*&|@~^="
    out += [math.log(1 + m), sum(size) / m, deviation(size), len(count) / m, top[0] / m, sum(top[:10]) / m]
    out += [len(lines) / m, len(set(lines)) / len(lines), deviation(wide) / (1 + sum(wide) / len(wide)), sum(x.rstrip()[-1] in signs for x in lines) / len(lines)]
    out += [sum(w[-1] in signs for w in ws) / m, sum(w.istitle() for w in ws) / m, sum(w.isupper() for w in ws) / m, len(zlib.compress(data, 1)) / n]
    pairs = [(a, b) for a, b in zip(ws, ws[1:])]
    return [*out, sum(x > 14 for x in size) / m, sum(x == 1 for x in size) / m, 1 - len(set(pairs)) / len(pairs) if pairs else 0.0]


def slow_quality(rows, marks):
    """Scores in one piece: standardised statistics, cosines, ridge by least squares, and the least-squares increasing fit by its min-max formula."""
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    f = {k: np.array(slow_statistics(t), np.float32).astype(float) for k, (_, t) in enumerate(rows)}
    train = [(k, marks[i]) for k, (i, _) in enumerate(rows) if i in marks and crc(i)]
    x, y = np.array([f[k] for k, _ in train]), np.array([v for _, v in train], float)
    fit = np.array([crc(rows[k][0]) != 1 for k, _ in train])
    mean, spread = x.mean(0), np.sqrt((x * x).mean(0) - x.mean(0) ** 2) + 1e-6
    rng = np.random.default_rng(quality.SEED)
    w, b = rng.standard_normal((32, quality.FEATURES)) / quality.WIDTH, rng.uniform(0, 2 * np.pi, quality.FEATURES)
    features = lambda v: np.c_[np.cos(np.clip((v - mean) / spread, -5, 5) @ w + b) * math.sqrt(2 / quality.FEATURES), np.ones(len(v))]
    z, d = features(x[fit]), quality.FEATURES + 1
    ridge = math.sqrt(quality.RIDGE * fit.sum() / d)
    weights = np.linalg.lstsq(np.r_[z, ridge * np.eye(d)], np.r_[y[fit], np.zeros(d)], rcond=None)[0]
    bins = collections.defaultdict(list)
    for v, good in zip(features(x[~fit]) @ weights, y[~fit]):
        bins[math.floor(min(max(v, -0.5), 1.5) * 1000)].append(good)
    at = sorted(bins)
    n, g = np.array([len(bins[k]) for k in at]), np.array([sum(bins[k]) for k in at])
    level = [max(min(g[a : z + 1].sum() / n[a : z + 1].sum() for z in range(k, len(at))) for a in range(k + 1)) for k in range(len(at))]
    blocks = collections.defaultdict(list)
    for k, v in enumerate(level):
        blocks[round(v, 12)].append(k)
    xs = [sum((at[k] + 0.5) / 1000 * n[k] for k in ks) / n[ks].sum() for ks in blocks.values()]
    return [float(np.interp((features(f[k][None]) @ weights)[0], xs, list(blocks))) for k in range(len(rows))]


def test_quality_equals_brute(spark, odd, marks):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    for docs, labels in ((docs, labels), (odd.select("doc_id", "text"), marks)):
        rows = [tuple(r) for r in docs.collect()]
        good = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id is not None}
        want = collections.defaultdict(list)
        for (i, _), v in zip(rows, slow_quality(rows, good)):
            want[str(i)].append(v)
        got = collections.defaultdict(list)
        for r in quality.judged(docs, labels).collect():
            got[str(r.doc_id)].append(r.score)
        assert got.keys() == want.keys()
        assert max(abs(a - b) for i in want for a, b in zip(sorted(got[i]), sorted(want[i]), strict=True)) < 1e-3
    stay = {r.doc_id for r in quality.keep_good(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).collect()}
    again = quality.judged(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).filter("predicted = 1").collect()
    assert stay == {r.doc_id for r in again}


def test_quality_learns_from_a_bounded_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    n = quality.labelled(docs, labels).count()
    assert n == docs.join(labels.filter("quality IS NOT NULL"), "doc_id").filter(quality.fold("doc_id", 5) != 0).count()
    assert 0.5 * 100 < quality.labelled(docs, labels, max_train=100).count() < 1.6 * 100
    hot = docs.selectExpr("IF(doc_id % 3 = 0, (SELECT min(doc_id) FROM VALUES (1), (2) AS t(doc_id)), doc_id) AS doc_id", "text")
    assert 0.5 * 100 < quality.labelled(hot, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), max_train=100).count() < 1.6 * 100
    assert quality.judged(docs, labels, max_train=100).count() == docs.count()


def test_monotone():
    rng = np.random.default_rng(0)
    x, n = np.arange(50.0), rng.integers(1, 9, 50)
    good = rng.binomial(n, np.linspace(0.1, 0.9, 50))
    xs, ys = quality.monotone(x, good, n)
    assert (np.diff(ys) > 0).all() and (np.diff(xs) > 0).all() and ys.min() >= 0 and ys.max() <= 1


def test_quality_odd(spark, odd, empty, marks):
    got = quality.judged(odd, marks).collect()
    assert len(got) == odd.count() and len({r.score for r in got if r.doc_id in (3, 4)}) == 1
    assert quality.judged(empty, marks).count() == 0 and {r.score for r in quality.judged(odd, marks.limit(0)).collect()} == {0.5}
    assert quality.keep_good(odd, marks).columns == odd.columns and quality.keep_good(empty, marks).count() == 0


# ---------------------------------------------------------------- op9


def test_token_histogram(spark, small, duck):
    with open(token_counts.VOCABULARY, "rb") as f:
        bpe = token_counts.encoding(f.read(), token_counts.PATTERN)
    n = sorted(len(bpe.encode_ordinary(t or "")) for _, t in texts(duck))
    got = QUERIES["op9_token_counts"](spark, small)
    rows = got.orderBy("n_tokens").collect()
    assert [(r.n_tokens, r.docs) for r in rows] == sorted(collections.Counter(n).items())
    for r in rows:
        assert (r.docs_from, r.tokens_from, r.truncated) == (sum(x >= r.n_tokens for x in n), sum(x for x in n if x >= r.n_tokens), sum(min(x, r.n_tokens) for x in n))
        assert r.quantile == pytest.approx(sum(x <= r.n_tokens for x in n) / len(n))
    limits = [0, 1, 17, 100, 2048, 10**7]
    assert {r.limit: r.truncated for r in token_counts.at_limits(got, limits).collect()} == {x: sum(min(v, x) for v in n) for x in limits}
    for r in token_counts.at_quantiles(got, [0.0, 0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == min(v for v in n if sum(x <= v for x in n) >= r.q * len(n))


def test_token_counts_odd(odd, empty):
    rows = token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(odd))).collect()
    assert sum(r.docs for r in rows) == odd.count() and min(r.n_tokens for r in rows) == 0
    assert token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(empty))).count() == 0


def test_token_answers_for_many_limits_and_none(spark):
    rng = random.Random(1)
    n = [rng.randrange(500) for _ in range(2000)]
    sums = kept(token_counts.suffix_sums(token_counts.histogram(spark.createDataFrame([(x,) for x in n], "n_tokens long"))), "sums")
    assert {r.limit: r.truncated for r in token_counts.at_limits(sums, range(0, 600, 4)).collect()} == {x: sum(min(v, x) for v in n) for x in range(0, 600, 4)}
    by = sorted(n)
    assert {r.q: r.n_tokens for r in token_counts.at_quantiles(sums, [i / 150 for i in range(151)]).collect()} == {q: by[max(math.ceil(q * len(n) - 1e-9), 1) - 1] for q in (i / 150 for i in range(151))}
    none = sums.limit(0)
    assert [tuple(r) for r in token_counts.at_limits(none, [5]).collect()] == [(5, 0)] and token_counts.at_quantiles(none, [0.5]).count() == 0
    assert token_counts.at_limits(sums, []).count() == token_counts.at_quantiles(sums, []).count() == 0


# ---------------------------------------------------------------- op10

SAMPLES = ["", " ", "  a  b ", "日本ﬁ\tx\ny", "<s> </s> <unk> <0x0A>", "▁▁x ▁", "😀" * 3, "a" * 500, "ünï ç", "x\u0000y", "tabs\t\tand  runs    of spaces\n\n", "1234567890 3.14"]


def test_pieces_as_sentencepiece():
    with open(sentence_pieces.MODEL, "rb") as f:
        data = f.read()
    own, other = sentence_pieces.Pieces(data), sentence_pieces.reference(data)
    ids = own.encode(SAMPLES)
    assert ids == other.encode(SAMPLES) == [e.ids for e in own.whole.encode_batch(SAMPLES, add_special_tokens=False)]
    assert [own.decode(i) for i in ids] == [other.decode(i) for i in ids] == [own.whole.decode(i, skip_special_tokens=False) for i in ids]
    assert own.model.kind == sentence_pieces.BPE and own.model.byte_fallback


def field(number, kind, value):
    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    return varint(number << 3 | kind) + (varint(value) if kind == 0 else value if kind == 5 else varint(len(value)) + value)


def test_unigram_model():
    """A hand-made unigram model with squeezed spaces and byte fallback."""
    import struct

    names = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{i:02X}>", 0, 6) for i in range(256)), ("▁", -3, 1), ("▁he", -4, 1), ("llo", -4.5, 1), ("▁hello", -6, 1), ("h", -7, 1), ("e", -7, 1), ("l", -7.5, 1), ("o", -7.25, 1), ("ell", -5.5, 1)]
    data = b"".join(field(1, 2, field(1, 2, n.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, k)) for n, s, k in names)
    data += field(2, 2, field(3, 0, 1) + field(35, 0, 1)) + field(3, 2, field(3, 0, 1) + field(4, 0, 1) + field(5, 0, 1))
    own, other = sentence_pieces.Pieces(data), sentence_pieces.reference(data)
    samples = ["hello", "  hello   hello ", "hell ohé", "", "ooo lle"]
    assert own.encode(samples) == other.encode(samples)


def test_sentencepiece_query(spark, small, duck):
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    got = {r.doc_id: r for r in QUERIES["op10_sentencepiece"](spark, small).collect()}
    for i, t in texts(duck):
        assert got[i].ids == other.encode(t or "") and got[i].n_ids == len(got[i].ids) and got[i].round_trip and got[i].parity in (None, True)


def test_sentencepiece_odd(odd, empty):
    coded = sentence_pieces.encoded(odd, verified=1)
    rows = coded.collect()
    assert len(rows) == odd.count() and all(r.parity and r.round_trip for r in rows) and [r.ids for r in rows if r.doc_id == 3] == [[]]
    assert sentence_pieces.encoded(empty).count() == 0
    back = sentence_pieces.decoded(coded.drop("text")).collect()
    assert sorted(r.text for r in back) == sorted(r.text or "" for r in odd.collect())


def test_sentencepiece_verifies_every_text(spark, small):
    rows = QUERIES["op10_sentencepiece"](spark, small).select("parity").collect()
    assert rows and all(r.parity is True for r in rows)


def test_sentencepiece_parity_finds_a_wrong_unit():
    with open(sentence_pieces.MODEL, "rb") as f:
        data = f.read()
    own, other = sentence_pieces.Pieces(data), sentence_pieces.reference(data)
    texts = [*SAMPLES, "a ", "a  ", " ", "  a", "▁", "a▁b"]
    ids, same, back = own.verified(texts, other)
    assert all(same) and [i.tolist() for i in ids] == other.encode(texts)
    assert back == [own.decode(i.tolist()) == t for i, t in zip(ids, texts)] and not all(back)

    class Broken:
        def encode_batch_fast(self, units, **_):
            return [type("E", (), {"ids": [5] if "wrong" in u else e.ids}) for u, e in zip(units, whole.encode_batch_fast(units, add_special_tokens=False), strict=True)]

    own, whole = sentence_pieces.Pieces(data), own.units
    own.units = Broken()
    texts = ["all fine", "one wrong word", "fine again", "wrong"]
    ids, same, back = own.verified(texts, other)
    assert all(back) and same == [True, False, True, False] and [i.tolist() for i in ids] == other.encode(texts)


# ---------------------------------------------------------------- plans


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_operators_run_no_python(spark, small):
    for name in ("op4_exact_dedup", "op5_mixing"):
        assert not re.search("Python|Pandas|Arrow", plan_of(QUERIES[name](spark, small)))


def test_scans_read_only_what_is_needed(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan_of(QUERIES["op7_url_filter"](spark, small))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan_of(exact_dedup.digests(docs))
    assert "ReadSchema: struct<text:string>" in plan_of(token_counts.lengths(docs))


def test_no_cross_or_nested_loop_joins(spark, small):
    for name in ("op3_language_model", "op4_exact_dedup", "op5_mixing", "op6_simhash", "op8_quality"):
        assert not re.search("Cartesian|NestedLoop", plan_of(QUERIES[name](spark, small)))
