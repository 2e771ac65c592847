"""Media columns: FLAC streams, written and read in batches.

Many frames are decoded at once. A seek table gives the byte offset of every frame, so each frame is
a lane; all lanes take one Rice code and one predictor step per sample, as vectors over the lanes.
Without a seek table a stream is one lane that goes from frame to frame. Header CRC-8, frame CRC-16
and the MD5 of the samples are verified; a wrong one raises BadStream.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, ranges, ship, table, task, whole

#: Samples a frame, samples a batch, seek points a table holds at most, bytes a payload is a multiple of.
FRAME, BATCH, MOST_POINTS, UNIT = 1024, 1 << 21, 900_000, 64
#: Fixed values of the format.
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}
BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10


class BadStream(ValueError):
    """A stream that is not FLAC, is cut short, or fails a checksum."""


@lru_cache(4)
def _powers(poly: int, bits: int, length: int) -> np.ndarray:
    """(length, 256): the checksum of a byte followed by 0, 1, ... zero bytes."""
    mask, top = (1 << bits) - 1, 1 << (bits - 1)
    one = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        one = np.where(one & top, one << 1 ^ poly, one << 1) & mask
    out = np.empty((length, 256), np.uint16)
    row = one
    for i in range(length):
        out[i] = row
        row = one[row >> (bits - 8)] ^ (row << 8 & mask)
    return out


def checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, poly: int, bits: int) -> np.ndarray:
    """The checksum (from 0, most significant bit first) of each part of data."""
    longest = int(lengths.max(initial=1))
    powers = _powers(poly, bits, 1 << (longest - 1).bit_length() if longest > 1 else 1)
    at = np.repeat(np.cumsum(lengths) - lengths, lengths)
    i = np.arange(len(at)) - at
    after = np.repeat(lengths, lengths) - 1 - i
    return np.bitwise_xor.reduceat(powers.ravel()[(after << 8) + data[np.repeat(starts, lengths) + i]], np.cumsum(lengths) - lengths)


def crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return checksums(data, starts, lengths, 0x8005, 16)


def crc8(data: bytes) -> int:
    return int(checksums(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]), 0x07, 8)[0])


@lru_cache(1)
def _crc8_table() -> list[int]:
    return _powers(0x07, 8, 1)[0].tolist()


def _crc8(data: bytes) -> int:
    c, t = 0, _crc8_table()
    for b in data:
        c = t[c ^ b]
    return c


def coded_number(n: int) -> bytes:
    """A frame number as the format writes it: like UTF-8, up to 36 bits."""
    if n < 128:
        return bytes([n])
    tail = []
    room = 6
    while n >= 1 << room:
        tail.append(128 | n & 63)
        n >>= 6
        room -= 1
    return bytes([(0xFF << (room + 1) & 0xFF) | n, *reversed(tail)])


# ---------------------------------------------------------------- writing


def _zigzag(e: np.ndarray) -> np.ndarray:
    return (e << 1) ^ (e >> 63)


def encode_batch(payloads: list[bytes], frame: int = FRAME) -> list[bytes]:
    """A FLAC stream (one channel of 8-bit samples, byte minus 128) for each payload.

    Each frame takes the cheapest of: verbatim, constant, fixed predictors of order 0 and 1, and a linear
    predictor of order 2 fitted to the frame. Every stream has a seek point for each frame. Frames are
    made about BATCH samples at a time, so a long payload needs no more memory than many short ones.
    """
    if not all(payloads):
        raise ValueError("a payload needs a sample at least")
    most = max(BATCH // frame, 1) * frame
    pieces = [(i, at) for i, p in enumerate(payloads) for at in range(0, len(p), most)]
    parts: list[list[bytes]] = [[] for _ in payloads]
    sizes: list[list[np.ndarray]] = [[] for _ in payloads]
    for span in ranges([min(most, len(payloads[i]) - at) for i, at in pieces], most):
        chosen = pieces[span]
        made = _frames([payloads[i][at : at + most] for i, at in chosen], [at // frame for _, at in chosen], frame)
        for (i, _), (data, lengths) in zip(chosen, made, strict=True):
            parts[i].append(data)
            sizes[i].append(lengths)
    return [_stream(p, b"".join(d), np.concatenate(n), frame) for p, d, n in zip(payloads, parts, sizes, strict=True)]


def _stream(payload: bytes, data: bytes, lengths: np.ndarray, frame: int) -> bytes:
    """Stream information, seek table and frames."""
    many, digest = len(lengths), hashlib.md5((np.frombuffer(payload, np.uint8) - np.uint8(128)).tobytes()).digest()
    biggest, step = frame if many > 1 else max(16, len(payload)), -(-many // MOST_POINTS)
    info = struct.pack(">HH", biggest, biggest) + int(lengths.min()).to_bytes(3, "big") + int(lengths.max()).to_bytes(3, "big") + (8000 << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + digest
    number = np.arange(0, many, step)
    points = np.zeros(len(number), [("s", ">u8"), ("o", ">u8"), ("n", ">u2")])
    points["s"], points["o"], points["n"] = number * frame, (np.cumsum(lengths) - lengths)[::step], np.minimum(frame, len(payload) - number * frame)
    return b"fLaC" + b"\x00\x00\x00\x22" + info + b"\x83" + (18 * len(points)).to_bytes(3, "big") + points.tobytes() + data


def _frames(payloads: list[bytes], numbers: list[int], frame: int) -> list[tuple[bytes, np.ndarray]]:
    """The frames of each payload, numbered from numbers on, and their lengths."""
    x = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int64) - 128
    size = np.array([len(p) for p in payloads])
    frames = -(-size // frame)
    place_of = np.arange(frames.sum()) - np.repeat(np.cumsum(frames) - frames, frames)
    number = place_of + np.repeat(numbers, frames)
    start = np.repeat(np.cumsum(size) - size, frames) + place_of * frame
    n = np.minimum(frame, np.repeat(np.cumsum(size), frames) - start)
    f, total = len(start), len(x)
    of = np.repeat(np.arange(f), n)
    place = np.arange(total) - start[of]

    one = np.r_[0, x[:-1]]
    two = np.r_[0, 0, x[:-2]]
    # linear predictor of order 2 from the frame's autocorrelation, in steps of 1/64
    a1 = np.where(place >= 1, one, 0)
    a2 = np.where(place >= 2, two, 0)
    r0, r1, r2 = (np.add.reduceat(x * a, start).astype(np.float64) for a in (x, a1, a2))
    det = np.maximum(r0 * r0 - r1 * r1, 1e-9)
    c1 = np.clip(np.rint(64 * r1 * (r0 - r2) / det), -128, 127).astype(np.int64)
    c2 = np.clip(np.rint(64 * (r0 * r2 - r1 * r1) / det), -128, 127).astype(np.int64)
    guesses = [(0, x), (1, x - a1), (2, x - ((c1[of] * one + c2[of] * two) >> 6))]
    best = 8.0 * n
    kind, k, u = np.full(f, -1), np.zeros(f, np.int64), np.zeros(total, np.int64)
    for order, e in guesses:
        z = _zigzag(e)
        z[place < order] = 0
        s = np.add.reduceat(z, start)
        m = np.maximum(n - order, 1)
        kk = np.clip(np.floor(np.log2(np.maximum(s / m, 1))).astype(np.int64), 0, 8)
        extra = 10 + 8 * order + (25 if order == 2 else 0)
        cost = m * (kk + 1) + (s >> kk) + extra
        better = (cost < best) & (n > order)
        best, kind, k = np.where(better, cost, best), np.where(better, order, kind), np.where(better, kk, k)
        pick = better[of]
        u[pick] = z[pick]
    flat = np.minimum.reduceat(x, start) == np.maximum.reduceat(x, start)
    kind = np.where(flat, -2, kind)

    order = np.maximum(kind, 0)
    coded = (place >= order[of]) & (kind[of] != -2)
    raw = kind[of] == -1
    kf = k[of]
    q = np.where(raw, 0, u >> kf)
    width = np.where(raw, 8, kf + 1)
    value = np.where(raw, x & 255, (1 << kf) | u & ((1 << kf) - 1))
    long = np.where(coded, q + width, 0)
    bits = np.add.reduceat(long, start)
    heads = []
    for i in range(f):
        head = b"\xff\xf8\x74\x02" + coded_number(int(number[i])) + struct.pack(">H", int(n[i]) - 1)
        head += bytes([_crc8(head)])
        kd, at = int(kind[i]), int(start[i])
        if kd == -2:
            sub, w = int(x[at]) & 255, 16
        elif kd == -1:
            sub, w = 2, 8
        else:
            sub, w = (8 + kd if kd < 2 else 33) << 1, 8
            for j in range(kd):
                sub, w = sub << 8 | int(x[at + j]) & 255, w + 8
            if kd == 2:  # 8-bit coefficients, shift 6
                sub, w = ((sub << 9 | 7 << 5 | 6) << 8 | int(c1[i]) & 255) << 8 | int(c2[i]) & 255, w + 25
            sub, w = sub << 10 | int(k[i]), w + 10
        heads.append((head + (sub << -w % 8).to_bytes((w + 7) // 8, "big"), len(head) * 8 + w))
    first = np.array([w for _, w in heads])
    length = -(-(first + bits) // 8) + 2
    offset = np.cumsum(length) - length
    before = np.cumsum(long) - long
    pos = (offset * 8 + first)[of] + before - before[start][of] + q
    pos, value, width = pos[coded], value[coded], width[coded]
    word = value << (24 - (pos & 7) - width)
    byte = pos >> 3
    size_all = int(length.sum()) + 4
    out = np.zeros(size_all)
    for j in range(2 if len(width) and width.max() <= 9 else 3):
        out += np.bincount(byte + j, word >> (16 - 8 * j) & 255, size_all)
    out = out.astype(np.uint8)
    joined = np.frombuffer(b"".join(h for h, _ in heads), np.uint8)
    spans = np.array([len(h) for h, _ in heads])
    out[np.repeat(offset, spans) + np.arange(len(joined)) - np.repeat(np.cumsum(spans) - spans, spans)] |= joined
    crc = crc16(out, offset, length - 2)
    out[offset + length - 2], out[offset + length - 1] = crc >> 8, crc & 255

    data, ends = out.tobytes(), np.cumsum(frames)
    return [(data[offset[z - m] : offset[z - 1] + length[z - 1]], length[z - m : z]) for m, z in zip(frames.tolist(), ends.tolist(), strict=True)]


# ---------------------------------------------------------------- reading


class Bits:
    """Single bit fields of a stream, for headers."""

    def __init__(self, data: bytes | memoryview, bit: int):
        self.data, self.at = data, bit

    def take(self, n: int) -> int:
        if not n:
            return 0
        a, z = self.at >> 3, (self.at + n + 7) >> 3
        part = self.data[a:z]
        if len(part) < z - a:
            raise BadStream("cut short")
        self.at += n
        return int.from_bytes(part, "big") >> (8 * z - self.at) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def zeros(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def stream_info(data: bytes) -> dict:
    """What the metadata blocks say: rate, channels, bits, samples, md5, frames (offset of the first), points."""
    if data[:4] != b"fLaC":
        raise BadStream("not a FLAC stream")
    at, out = 4, {"points": None}
    while True:
        if at + 4 > len(data):
            raise BadStream("cut short")
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind & 127 == 0:
            word = int.from_bytes(body[10:18], "big")
            out |= {"block": int.from_bytes(body[2:4], "big"), "rate": word >> 44, "channels": (word >> 41 & 7) + 1, "bits": (word >> 36 & 31) + 1, "samples": word & (1 << 36) - 1, "md5": body[18:34]}
        elif kind & 127 == 3:
            p = np.frombuffer(body, [("s", ">u8"), ("o", ">u8"), ("n", ">u2")])
            out["points"] = p[p["s"] != 0xFFFFFFFFFFFFFFFF]
        at += 4 + size
        if kind & 128:
            break
    if "md5" not in out:
        raise BadStream("no stream information")
    return out | {"frames": at}


def frame_header(data: bytes, at: int, info: dict) -> dict:
    """The frame header at a byte offset, its CRC-8 verified: n (samples), channels mode, bits, number, body (bit offset)."""
    h = data[at : at + 16]
    if len(h) < 6 or h[0] != 0xFF or h[1] & 0xFE != 0xF8:
        raise BadStream("no frame where one is due")
    size, rate, mode, bits = h[2] >> 4, h[2] & 15, h[3] >> 4, h[3] >> 1 & 7
    p, lead = 5, h[4]
    if lead >= 0xC0:
        more = 8 - (lead ^ 0xFF).bit_length() - 1
        number = lead & ((1 << (6 - more)) - 1)
        for b in h[5 : 5 + more]:
            number = number << 6 | b & 63
        p += more
    else:
        number = lead
    if size in (6, 7):
        n = int.from_bytes(h[p : p + size - 5], "big") + 1
        p += size - 5
    else:
        n = BLOCK_SIZES.get(size, 0)
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if p >= len(h) or _crc8(h[:p]) != h[p]:
        raise BadStream("a frame header's checksum is wrong")
    return {"n": n, "mode": mode, "bits": SAMPLE_BITS.get(bits, info["bits"]), "number": number, "variable": h[1] & 1, "body": (at + p + 1) * 8}


def decode_batch(streams: list[bytes]) -> list[np.ndarray]:
    """The samples of each stream, (samples, channels) as int32 or (samples,) for one channel; all checksums verified."""
    if not streams:
        return []
    data = b"".join(streams) + bytes(16)
    buf = np.frombuffer(data, np.uint8)
    bases = np.cumsum([0, *map(len, streams)])
    infos, lanes, outs = [], [], []
    for s, (stream, base) in enumerate(zip(streams, bases.tolist(), strict=False)):
        info = stream_info(stream)
        infos.append(info)
        outs.append(np.zeros((info["samples"], info["channels"]), np.int32))
        points, first = info["points"], base + info["frames"]
        if points is None or not len(points) or points["s"][0]:
            lanes.append([s, first, 0, info["samples"]])
        else:
            ends = [*points["s"][1:].tolist(), info["samples"]]
            lanes += [[s, first + o, a, z] for o, a, z in zip(points["o"].tolist(), points["s"].tolist(), ends, strict=True)]
    waiting, lanes = [x for x in lanes if x[2] < x[3]], []
    while waiting or lanes:
        room = BATCH - sum(infos[x[0]]["block"] for x in lanes)
        while waiting and (room > 0 or not lanes):  # about BATCH samples at a time
            lanes.append(waiting.pop())
            room -= infos[lanes[-1][0]]["block"]
        heads = [frame_header(data, at, infos[s]) for s, at, _, _ in lanes]
        if any(not h["n"] or a + h["n"] > z for h, (_, _, a, z) in zip(heads, lanes, strict=True)):
            raise BadStream("frames and seek points disagree")
        channels = [infos[s]["channels"] for s, *_ in lanes]
        bit = np.array([h["body"] for h in heads])
        got: list[list[np.ndarray]] = [[] for _ in lanes]
        for c in range(max(channels)):
            on = [i for i, m in enumerate(channels) if c < m]
            wide = [heads[i]["bits"] + ((heads[i]["mode"], c) in ((LEFT_SIDE, 1), (SIDE_RIGHT, 0), (MID_SIDE, 1))) for i in on]
            rows, ends = subframes(data, buf, bit[on], np.array([heads[i]["n"] for i in on]), wide)
            bit[on] = ends
            for i, row in zip(on, rows, strict=True):
                got[i].append(row)
        end = (bit + 7) >> 3
        start = np.array([at for _, at, _, _ in lanes])
        limit = bases[[s + 1 for s, *_ in lanes]]
        if (end + 2 > limit).any():
            raise BadStream("cut short")
        if (crc16(buf, start, end - start) != buf[end].astype(np.uint16) << 8 | buf[end + 1]).any():
            raise BadStream("a frame's checksum is wrong")
        rest = []
        for (s, _, a, z), h, parts, e in zip(lanes, heads, got, end.tolist(), strict=True):
            if h["mode"] == LEFT_SIDE:
                parts = [parts[0], parts[0] - parts[1]]
            elif h["mode"] == SIDE_RIGHT:
                parts = [parts[0] + parts[1], parts[1]]
            elif h["mode"] == MID_SIDE:
                twice = parts[0] * 2 + (parts[1] & 1)
                parts = [(twice + parts[1]) >> 1, (twice - parts[1]) >> 1]
            for c, part in enumerate(parts):
                outs[s][a : a + h["n"], c] = part
            if a + h["n"] < z:
                rest.append([s, e + 2, a + h["n"], z])
        lanes = rest
    for info, out in zip(infos, outs, strict=True):
        size = (info["bits"] + 7) // 8
        raw = out.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :size].tobytes() if size > 1 else out.astype(np.int8).tobytes()
        if info["md5"] != bytes(16) and hashlib.md5(raw).digest() != info["md5"]:
            raise BadStream("the samples' checksum is wrong")
    return [o[:, 0] if o.shape[1] == 1 else o for o in outs]


@lru_cache(1)
def _leading() -> np.ndarray:
    """Leading zeros of each 16-bit word; 16 for zero."""
    i = np.arange(1, 1 << 16)
    return np.r_[16, 15 - np.floor(np.log2(i)).astype(np.int64)].astype(np.uint64)


def subframes(data: bytes, buf: np.ndarray, bit: np.ndarray, n: np.ndarray, wide: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """The samples of one subframe per lane, and the bit after each."""
    many = len(n)
    order, shift, k, raw, wasted = (np.zeros(many, np.int64) for _ in range(5))
    share = n.copy()  # samples of a partition
    param = np.zeros(many, np.int64)  # bits of a partition's parameter, 0: no residual
    coefficients: list[tuple[int, ...]] = []
    at = bit.copy()
    values = np.zeros((int(n.max(initial=0)), many), np.int64)
    by = np.argsort(-n, kind="stable")
    lane_of = np.empty(many, np.int64)
    lane_of[by] = np.arange(many)
    for i in range(many):
        b, j = Bits(data, int(bit[i])), lane_of[i]
        kind = b.take(8)
        if kind & 128:
            raise BadStream("a subframe's header is wrong")
        if kind & 1:
            wasted[i] = b.zeros() + 1
        kind, w = kind >> 1 & 63, wide[i] - int(wasted[i])
        if kind == 0:
            coefficients.append((1,))
            order[i], values[0, j] = 1, b.signed(w)
        elif kind == 1:
            coefficients.append(())
            raw[i] = w
        elif 8 <= kind <= 12 or kind >= 32:
            order[i] = kind - 8 if kind < 32 else kind - 31
            if order[i] > n[i]:
                raise BadStream("a predictor is longer than its frame")
            for t in range(order[i]):
                values[t, j] = b.signed(w)
            if kind < 32:
                coefficients.append(FIXED[kind - 8])
            else:
                precision = b.take(4) + 1
                shift[i] = b.signed(5)
                coefficients.append(tuple(b.signed(precision) for _ in range(kind - 31)))
            param[i], parts = b.take(2) + 4, b.take(4)
            if param[i] > 5 or n[i] % (1 << parts):
                raise BadStream("a residual's coding is unknown")
            share[i] = n[i] >> parts
        else:
            raise BadStream("a subframe's kind is unknown")
        at[i] = b.at
    p, ns, ords, shares = at[by].astype(np.uint64), n[by], order[by], share[by]
    params, ks, raws = param[by], k[by].astype(np.uint64), raw[by].astype(np.uint64)
    longest = max(map(len, coefficients), default=0)
    c = np.zeros((longest, many), np.int64)
    for i, co in enumerate(coefficients):
        c[: len(co), lane_of[i]] = co
    shifts = shift[by]
    window = np.ndarray(len(buf) - 8, ">u8", buf, strides=(1,))
    leading, most = _leading(), np.uint64(len(buf) - 9)
    turns = np.unique(shares[params > 0]).tolist()
    plain = not (raws > 0).any()
    one, c3, c7, c48, c63, c64 = map(np.uint64, (1, 3, 7, 48, 63, 64))

    def bits(where: np.ndarray) -> np.ndarray:
        return window[np.minimum(where >> c3, most).astype(np.int64)].astype(np.uint64) << (where & c7)

    constant = (params == 0) & (raws == 0)
    busy = not constant.any()
    live = np.searchsorted(-ns, -np.arange(1, len(values) + 1), side="right")
    first_order, last_order = int(ords.min(initial=0)), int(ords.max(initial=0))
    for t in range(len(values)):
        m = live[t]
        if t == 0 or any(t % s == 0 for s in turns):
            new = np.flatnonzero((params[:m] > 0) & (t % np.maximum(shares[:m], 1) == 0))
            if len(new):
                x = bits(p[new])
                pb = params[new].astype(np.uint64)
                got = x >> (c64 - pb)
                escape = got == (one << pb) - one
                ks[new], raws[new] = got, 0
                p[new] += pb
                if escape.any():
                    e = new[escape]
                    raws[e] = (x[escape] << pb[escape]) >> np.uint64(59)
                    p[e] += np.uint64(5)
                    zero = e[raws[e] == 0]
                    raws[zero] = c64  # a partition of zeros
                plain = not (raws > 0).any()
        row = values[t, :m]
        if t < last_order:
            todo = np.flatnonzero((ords[:m] <= t) & ~constant[:m])
            if not len(todo):
                continue
        else:
            todo = slice(0, m) if busy else np.flatnonzero(~constant[:m])
        pp, kk = p[todo], ks[todo]
        x = bits(pp)
        q = leading[(x >> c48).astype(np.int64)]
        slow = q == 16
        if plain:
            rare = slow
        else:
            rw = raws[todo]
            rare = slow & (rw == 0)
        if rare.any():
            r = np.flatnonzero(rare)
            q[r] = 0
            while len(r):
                z = leading[(bits(pp[r] + q[r]) >> c48).astype(np.int64)]
                q[r] += z
                if (pp[r] + q[r] > np.uint64(8 * len(buf))).any():
                    raise BadStream("cut short")
                r = r[z == 16]
            x = np.where(rare, bits(pp + q), x << q)
        else:
            x = x << q
        low = ((x << one) >> one) >> (c63 - kk)
        u = ((q << kk) | low).astype(np.int64)
        e = (u >> 1) ^ -(u & 1)
        step = q + one + kk
        if not plain:
            x = bits(pp)
            w = np.where(rw == c64, 0, rw).astype(np.uint64)
            v = ((x >> one) >> (c63 - w)).astype(np.int64)
            v = np.where(w > 0, v - ((v >> np.maximum(w.astype(np.int64) - 1, 0)) << w.astype(np.int64)), 0)
            e, step = np.where(rw > 0, v, e), np.where(rw > 0, w, step)
        p[todo] = pp + step
        row[todo] = e
        if longest and t:
            guess = c[0, :m] * values[t - 1, :m]
            for j in range(1, min(longest, t)):
                guess += c[j, :m] * values[t - 1 - j, :m]
            guess >>= shifts[:m]
            if t < last_order:
                guess[ords[:m] > t] = 0
            row += guess
    if constant.any():
        lanes = np.flatnonzero(constant)
        values[:, lanes] = values[0, lanes]
    ends = np.empty(many, np.int64)
    ends[by] = p.astype(np.int64)
    return [values[: n[i], lane_of[i]] << wasted[i] for i in range(many)], ends


# ---------------------------------------------------------------- columns


def payload(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def with_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with a binary column of FLAC streams of the padded UTF-8 text; null and empty texts give one of UNIT zero bytes. A column of that name is replaced."""
    ship(docs.sparkSession)
    docs = docs.drop(media)
    names, where = [*docs.columns, media], docs.columns.index(text)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column(where), "")
            for part in ranges(pc.binary_length(column).to_pylist(), BATCH):
                data = [payload(t.as_buffer().to_pybytes()) for t in column[part]]
                yield pa.RecordBatch.from_arrays([*batch.slice(part.start, len(data)).columns, pa.array(encode_batch(data), pa.binary())], names)

    return docs.mapInArrow(run, docs.select("*", F.lit(None).cast("binary").alias(media)).schema)


def pcm_blocks(media: DataFrame, key: str | Sequence[str] = "doc_id", column: str = "media", samples: int = 4096) -> DataFrame:
    """The key columns, block, sample_offset, n_samples, pcm: the decoded samples of each stream in blocks that can be sought by offset.

    pcm is little-endian, signed, in as many whole bytes as a sample needs, channels interleaved. The
    blocks of a stream follow each other. All checksums are verified. Null streams give no rows.
    """
    ship(media.sparkSession)
    keys = [key] if isinstance(key, str) else list(key)
    rows = media.select(*keys, F.col(column).alias("pcm")).filter(F.col("pcm").isNotNull())

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = batch.column(len(keys))
            for part in ranges(pc.binary_length(streams).to_pylist(), BATCH):
                got: list[list] = [[], [], [], [], []]
                data = [s.as_buffer().to_pybytes() for s in streams[part]]
                for i, (stream, x) in enumerate(zip(data, decode_batch(data), strict=True), part.start):
                    size = (stream_info(stream)["bits"] + 7) // 8
                    for b, at in enumerate(range(0, len(x), samples)):
                        piece = np.ascontiguousarray(x[at : at + samples]).astype("<i4")
                        values = i, b, at, len(piece), piece.view(np.uint8).reshape(-1, 4)[:, :size].tobytes()
                        for column_, value in zip(got, values, strict=True):
                            column_.append(value)
                of = pa.array(got[0], pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(of) for c in batch.columns[: len(keys)]), *(pa.array(g, pa.int64()) for g in got[1:4]), pa.array(got[4], pa.binary())], names)

    names = [*keys, "block", "sample_offset", "n_samples", "pcm"]
    nothing = F.lit(None)
    return rows.mapInArrow(run, rows.select(*keys, *(nothing.cast("long").alias(n) for n in names[len(keys) : -1]), nothing.cast("binary").alias("pcm")).schema)


def feature(x: np.ndarray) -> str:
    """A description of samples: their number, mean, root mean square, share of sign changes of the centred signal, largest step."""
    y = x.astype(np.float64)
    c = y - y.mean()
    step = np.abs(np.diff(x)).max(initial=0)
    return f"n={len(x)};mean={y.mean():.4f};rms={np.sqrt((y * y).mean()):.4f};zcr={float((c[1:] * c[:-1] < 0).mean()) if len(x) > 1 else 0:.4f};step={step}"


#: What is known of a stored stream, and what its blocks give.
STORED, DIGESTS = ["doc_id", "n_bytes", "media_bytes", "media_sha256"], ["payload_bytes", "payload_sha256", "tail_crc32", "feature", "blocks"]


def digested(blocks: DataFrame, key: Sequence[str]) -> DataFrame:
    """The key columns and DIGESTS of every stream of 8-bit samples, from its blocks as pcm_blocks gives them, one stream at a time."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = bytearray(), None  # the stream's samples so far, and its first row

        def done() -> tuple:
            x = np.frombuffer(held, np.int8)
            back = (x.view(np.uint8) ^ 128).tobytes()
            return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), feature(x.astype(np.int32)), count

        count = 0
        for batch in batches:
            rows, out = [], []
            for i, (block, at, pcm) in enumerate(zip(*(batch.column(n) for n in ("block", "sample_offset", "pcm")), strict=True)):
                if block.as_py() == 0:
                    if first is not None:
                        rows.append(first)
                        out.append(done())
                    held, first, count = bytearray(), batch.select(list(key)).slice(i, 1), 0
                if at.as_py() != len(held):
                    raise BadStream("a block is missing")
                held += pcm.as_buffer()
                count += 1
            if out:
                yield batch_of(rows, out)
        if first is not None:
            yield batch_of([first], [done()])

    def batch_of(rows: list[pa.RecordBatch], out: list[tuple]) -> pa.RecordBatch:
        keys = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([*keys.columns, *(pa.array(c) for c in zip(*out, strict=True))], [*key, *DIGESTS])

    shape = blocks.select(*key, *(F.lit(None).cast(t).alias(n) for n, t in zip(DIGESTS, ("long", "string", "long", "string", "long"), strict=True))).schema
    return blocks.mapInArrow(run, shape)


def stored_and_read(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """STORED and DIGESTS of every whole text: stored as a FLAC stream in a table of media, read back from there as PCM blocks.

    Null texts are empty; equal texts give equal values; repeated rows stay; no rows in, no rows out.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), whole(docs[text]).alias("text"))
    media = kept(with_media(rows.withColumn("n_bytes", F.octet_length("text").cast("long"))).drop("text"), "media", codec="zstd")  # a tenth less than the usual codec
    media = media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return digested(pcm_blocks(media, STORED), STORED)


def op1_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_and_read(table(spark, sf_dir, "documents"))
