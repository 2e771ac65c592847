"""SimHash near-duplicates with anchor points from a covering code.

The anchors are codewords of the perfect binary Golay code of length 23: every 23-bit word lies
within the covering radius 3 of one codeword. A fingerprint is sent to every anchor within the
covering radius plus the link threshold, so two fingerprints that link meet at the anchor nearest
to either. Fingerprints are compared per anchor only, and an anchor gives spanning links of what is
connected there, never all pairs.

fingerprint_links joins 64-bit fingerprints exactly: two blocks of 23 bits make the anchor, and a
threshold t is shared by the blocks (t1 + t2 <= t), about 61 anchors a fingerprint at t = 2. Crowded
anchors, found on a sample, are split by the 18 bits that are left: in three parts of 6 bits, of
which fingerprints within 2 bits have one in common. What still meets in numbers at one anchor is
linked in time in proportion to it, as fingerprints within 2 bits have a neighbour in common.
similar_links serves similarity 0.8, where an anchor of 12 bits would hold too many of millions of
texts: signatures meet where one of 160 blocks of 16 bits is equal, which holds one in 65,536 of what
is not similar, and 128 bits of other blocks leave out what is far apart. The blocks take turns, AT_ONCE
of them shuffled at a time, so that disk holds those and no more. Such links make clusters, and
within a cluster the sets of shingles decide on all pairs of texts that are not connected yet. They are
compared where their sets lie, a cluster in tiles of two bounded parts, and only what connects comes
out: no table has a row for each pair. A sketch of 256 bytes leaves out what is clearly less similar.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh, kept, marked, numbered, ship, table, task, whole
from .components import components

GOLAY = 0b110001110101  # generator polynomial of the [23, 12, 7] code
BITS, RADIUS = 23, 3
#: Signature of similar_links: words, the last 2 * CHECK_WORDS of which are check words too, CHECK_WORDS for each parity of the block; most differing
#: check bits of a candidate (at 0.8 they are 19.4 on average with a deviation of 4.1). Blocks: all bits in runs of BLOCK_BITS, then once more at even distances.
WORDS, CHECK_WORDS, CHECK_BITS, BLOCK_BITS = 20, 2, 32, 16
RUNS = 64 * WORDS // BLOCK_BITS
BLOCKS = 2 * RUNS
#: Blocks whose keys are on disk at a time.
AT_ONCE = 40
#: Shingles hashed at a time, rows compared at a time, largest group compared by shifts, and one by one; points of neighbours sorted at a time.
CHUNK, ROWS, SHIFTED, SINGLY, POINTS = 1 << 16, 200_000, 24, 2048, 1 << 23
#: Pairs held until they are named, or those left out that connect nothing new; largest group of signatures whose pairs are looked at in all, many groups together.
PAIRS, SPANNED = 1_000_000, 256
#: A part of a cluster has about so many bytes of sets and so many texts at most; clusters of more than LEAST_PART texts have up to MORE_PARTS parts even so, for more tasks.
PART_BYTES, PART_ROWS, LEAST_PART, MORE_PARTS = 8 << 20, 4096, 512, 8
#: An anchor is crowded with more than so many fingerprints, or one in so many of all; one fingerprint in so many is looked at, and no more than so many.
CROWD, CROWD_SHARE, LOOKED_AT, LOOKED_AT_MOST = 200_000, 50_000, 16, 1_000_000

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: str, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles in order, repeats included, CHUNK at a time; fewer words than shingle: one of all; none: nothing."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return
    joined, ends = b" ".join(w), [n + i for i, n in enumerate(accumulate(map(len, w)))]
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[shingle - 1 :] or ends[-1:]
    for at in range(0, len(last), CHUNK):
        yield np.frombuffer(b"".join([xxhash.xxh64_digest(joined[s:e], 42) for s, e in zip(starts[at : at + CHUNK], last[at : at + CHUNK], strict=False)]), ">u8")


def ones(octets: np.ndarray) -> np.ndarray:
    """How often each bit is set in (n, k) bytes: (k, 8)."""
    k = octets.shape[1]
    if len(octets) < 64:
        return np.unpackbits(octets, axis=1).sum(0, dtype=np.int64).reshape(-1, 8)
    seen = np.bincount((octets + (np.arange(k, dtype=np.int64) << 8)).ravel(), minlength=256 * k)
    return seen.reshape(-1, 256) @ _BYTE_BITS


def fingerprint(text: str, shingle: int) -> bytes:
    """SimHash of 64 bits, big-endian: a bit is set if it is in over half the shingles' hashes; zero without words."""
    n, counts = 0, np.zeros((8, 8), np.int64)
    for h in shingle_hashes(text, shingle):
        n, counts = n + len(h), counts + ones(h.view(np.uint8).reshape(-1, 8))
    return np.packbits(counts * 2 > n, axis=1).tobytes()


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The distinct hashes of the shingles, sorted."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, shingle)]).astype(np.uint64))


def sketch(h: np.ndarray) -> bytes:
    """A byte (1 to 255, 0: none) for the smallest hash of a set with each first byte."""
    h = np.r_[h, np.uint64(0)]
    first = np.searchsorted(h[:-1], np.arange(256, dtype=np.uint64) << np.uint64(56))
    some = np.r_[np.diff(first) > 0, first[-1] < len(h) - 1]
    return np.where(some, h[first] % np.uint64(255) + np.uint64(1), 0).astype(np.uint8).tobytes()


def may_be_similar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of sketches (n, 256) may be of sets with similarity 0.8, but for four deviations of the estimate."""
    either = ((x > 0) | (y > 0)).sum(1)
    return (x == y).sum(1) - (256 - either) >= 0.8 * either - 4 * np.sqrt(0.16 * either)


def signature(h: np.ndarray, words: int) -> bytes:
    """SimHash of words * 64 bits of a set of shingles, then 16 bytes that tell sets apart, then its sketch; where as many hashes have a bit as have not, that of the smallest hash counts.

    Repeats do not count and ties are fair, so that short texts and texts of repeated lines are not near others by chance.
    """
    if not len(h):
        return bytes(8 * words + 16 + 256)
    counts = np.zeros((8 * words, 8), np.int64)
    for at in range(0, len(h), CHUNK // 8):
        octets = mixed_words(h[at : at + CHUNK // 8], words).astype(">u8").view(np.uint8).reshape(-1, 8 * words)
        if not at:
            first = np.unpackbits(octets[0]).reshape(-1, 8)
        counts += ones(octets)
    return np.packbits(counts * 2 + first > len(h), axis=1).tobytes() + xxhash.xxh3_128_digest(h.tobytes()) + sketch(h)


def mixed_words(h: np.ndarray, words: int) -> np.ndarray:
    """(n, words): the hash, then words - 1 finalisations of it after adding multiples of an odd constant."""
    out = np.empty((len(h), words), np.uint64)
    out[:, 0] = h
    for j in range(1, words):
        x = h + np.uint64(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, j] = x ^ (x >> np.uint64(31))
    return out


def signatures(docs: DataFrame, make: Callable[[str], bytes], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, sig (binary, made from the text) of every row; null texts are empty."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = [make(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig, pa.binary())], ["doc_id", "sig"])

    ship(docs.sparkSession)
    rows = docs.select(docs[doc_id].alias("doc_id"), whole(docs[text]).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, sig binary")


@lru_cache
def covering() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of weight up to 5 sorted by syndrome and weight, the first of each syndrome, and how many of weight up to 3, 4, 5 it has."""
    patterns = np.array([sum(1 << i for i in c) for w in range(RADIUS + 3) for c in combinations(range(BITS), w)], np.int64)
    s, weight = syndromes(patterns), np.bitwise_count(patterns).astype(np.int64)
    order = np.lexsort((weight, s))
    many = np.stack([np.bincount(s[weight <= RADIUS + t], minlength=2048) for t in range(3)])
    return patterns[order], np.concatenate([[0], np.cumsum(many[2])[:-1]]), many


@lru_cache
def _high() -> np.ndarray:
    out = np.arange(4096, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GOLAY << (bit - 11)), out)
    return out


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    return _high()[words >> 11] ^ (words & 2047)


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of counts its index so often, and 0, 1, ... within."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def near(words: np.ndarray, extra: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors within the covering radius plus extra of each word: row, anchor (12 bits), distance."""
    patterns, first, many = covering()
    s = syndromes(words)
    row, k = ragged(many[extra, s])
    e = patterns[first[s[row]] + k]
    return row, (words[row] ^ e) >> 11, np.bitwise_count(e).astype(np.int64)


def anchors_of_fingerprints(fp: np.ndarray, threshold: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """row, anchor (24 bits) for every anchor of 64-bit fingerprints; threshold 0 to 2."""
    a, b = (fp >> np.uint64(41)).astype(np.int64), (fp >> np.uint64(18) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    row, left, distance = near(a, threshold)
    again, right, _ = near(b[row], threshold - np.maximum(distance - RADIUS, 0))
    return row[again], left[again] << 12 | right


def keys_of_signatures(sig: np.ndarray, blocks: range = range(BLOCKS)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, key (block and its bits) of signatures, (n, WORDS) words, for some of the blocks, and the check words to compare, which a run is no part of."""
    octets = sig.astype(">u8").view(np.uint8).reshape(len(sig), -1)
    spread = np.unpackbits(octets, axis=1).reshape(len(sig), BLOCK_BITS, RUNS).transpose(0, 2, 1)
    bits = np.concatenate([octets.reshape(len(sig), RUNS, -1), np.packbits(spread, axis=2)], axis=1).view(">u2")[:, blocks, 0]
    row, block = np.repeat(np.arange(len(sig)), len(blocks)), np.tile(np.array(blocks, np.int64), len(sig))
    first, word = WORDS - 2 * CHECK_WORDS, block * BLOCK_BITS // 64
    other = np.where((first <= word) & (word < WORDS), word < first + CHECK_WORDS, block % 2)
    return row, block << BLOCK_BITS | bits.ravel().astype(np.int64), sig[row[:, None], first + CHECK_WORDS * other[:, None] + np.arange(CHECK_WORDS)]


def united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label (the smallest known row of each row's component) after linking rows i and j."""
    i, j = label[i], label[j]
    while len(i):
        on = i != j
        i, j = i[on], j[on]
        m = np.minimum(label[i], label[j])
        np.minimum.at(label, i, m)
        np.minimum.at(label, j, m)
        label = label[label]
        i, j = label[i], label[j]
    while (label[label] != label).any():
        label = label[label]
    return label


def connected(keys: np.ndarray, check: np.ndarray, most: int) -> np.ndarray:
    """The root of each row: rows with equal keys (sorted) whose check words differ in at most `most` bits belong together."""
    n = len(keys)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if n else np.array([], np.int64)
    length = np.diff(np.r_[starts, n])
    label = np.arange(n)
    small = np.repeat(length <= SHIFTED, length)
    room = np.repeat(starts + length, length) - np.arange(n)  # rows of the group from here on
    left, right = [], []
    for shift in range(1, min(SHIFTED, int(length.max(initial=1)))):
        i = np.flatnonzero(small & (room > shift))
        if not len(i):
            break
        i = i[np.bitwise_count(check[i] ^ check[i + shift]).sum(1) <= most]
        left.append(i)
        right.append(i + shift)
    if left:
        label = united(label, np.concatenate(left), np.concatenate(right))
    few = SPANNED if check.shape[1] > 1 else SHIFTED
    rows = np.flatnonzero(np.repeat((length > SHIFTED) & (length <= few), length))
    if len(rows):
        i, j = spanned(keys[rows], np.arange(len(rows)), check[rows], most)
        label = united(label, rows[i], rows[j])
    for at, size in zip(starts[length > few], length[length > few], strict=True):
        group = check[at : at + size]
        label[at : at + size] = at + (neighbours(group[:, 0], most) if size > SINGLY and group.shape[1] == 1 and most <= 2 else flood(group, most))
    return label


def forest(root: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """root after linking rows i and j, and the pairs, nearest (d) first, that link what was not linked."""
    by = np.argsort(d, kind="stable")
    i, j = i[by], j[by]
    used = [np.empty((2, 0), np.int64)]
    while len(i):
        a, b = root[i], root[j]
        on = a != b
        i, j, a, b = i[on], j[on], a[on], b[on]
        high, first = np.unique(np.maximum(a, b), return_index=True)
        used.append(np.stack([i[first], j[first]]))
        root = root.copy()
        root[high] = np.minimum(a, b)[first]
        while (root[root] != root).any():
            root = root[root]
    return root, *np.concatenate(used, axis=1)


def named(keys: np.ndarray, label: np.ndarray, check: np.ndarray, most: int, each: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Pairs (rows, rows) of different labels that share a key and differ in at most `most` bits; at last (rows, None), the rows of pairs left out.

    Rows are sorted by key, then label. All pairs of a key come out up to `each` for each of its
    rows; of more, those that connect its labels, near ones first.
    """
    n = len(keys)
    edge, own = keys[1:] != keys[:-1], (keys[1:] != keys[:-1]) | (label[1:] != label[:-1])
    end, start, behind = (np.r_[0, np.flatnonzero(x) + 1, n] if n else np.zeros(2, np.int64) for x in (edge, own, own))
    size = np.diff(end)
    group, end = np.repeat(np.arange(len(size)), size), np.repeat(end[1:], size)
    root, behind = np.repeat(start[:-1], np.diff(start)), np.repeat(behind[1:], np.diff(behind))
    count, left_out = np.zeros(len(size), np.int64), np.zeros(n, bool)

    def many(rows: np.ndarray) -> np.ndarray:
        return count[group[rows]] > each * size[group[rows]]

    i, shift = np.flatnonzero(behind < end), 0
    left, right, far, held = [], [], [], 0
    while len(i):
        j = behind[i] + shift
        d = np.bitwise_count(check[i] ^ check[j]).sum(1)
        hit = d <= most
        a, b, d = i[hit], j[hit], d[hit]
        np.add.at(count, group[a], 1)
        some = many(a)
        left_out[a[some]] = left_out[b[some]] = True
        on = ~some | (root[a] != root[b])
        left.append(a[on])
        right.append(b[on])
        far.append(d[on])
        held += len(left[-1])
        shift += 1
        i = i[behind[i] + shift < end[i]]
        if held > PAIRS or not len(i):
            a, b, d = np.concatenate(left), np.concatenate(right), np.concatenate(far)
            some = many(a)
            left_out[a[some]] = left_out[b[some]] = True
            yield a[~some], b[~some]
            root, *linked = forest(root, a[some], b[some], d[some])
            yield tuple(linked)
            left, right, far, held = [], [], [], 0
    yield np.flatnonzero(left_out), None


def spanned(keys: np.ndarray, label: np.ndarray, check: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of named that connect the labels of each key, and no others: fewer than rows."""
    pairs = [np.stack([a, b]) for a, b in named(keys, label, check, most, 0) if b is not None]
    return tuple(np.concatenate([np.empty((2, 0), np.int64), *pairs], axis=1))


def flood(check: np.ndarray, most: int) -> np.ndarray:
    """The root of each row of one large group; every row is compared with the rows not yet reached."""
    root, rest = np.arange(len(check)), np.arange(len(check))
    cols = [np.ascontiguousarray(check[:, k]) for k in range(check.shape[1])]
    while len(rest):
        first, rest = rest[0], rest[1:]
        todo = [first]
        while todo and len(rest):
            x = todo.pop()
            d = np.bitwise_count(cols[0][rest] ^ cols[0][x]).astype(np.int64)
            for c in cols[1:]:
                d += np.bitwise_count(c[rest] ^ c[x])
            hit = d <= most
            got = rest[hit]
            if len(got):
                root[got] = first
                todo.extend(got.tolist())
                rest = rest[~hit]
    return root


def neighbours(fp: np.ndarray, most: int) -> np.ndarray:
    """The root of each of a large group of 64-bit fingerprints linked at up to `most` (0 to 2) differing bits.

    Fingerprints differ in at most 2 bits if a point is within 1 bit of both. The points are sorted
    a class of low bits at a time, so memory stays near POINTS however many there are.
    """
    label, n = np.arange(len(fp)), len(fp)
    k = max(0, (n * 65 // POINTS).bit_length())
    low = (fp & np.uint64((1 << k) - 1)).astype(np.int64)
    order = np.argsort(low, kind="stable")
    at = np.searchsorted(low[order], np.arange((1 << k) + 1))
    for c in range(1 << k):
        points, rows = [fp[x := order[at[c] : at[c + 1]]]], [x]
        for bit in range(64 if most else 0):
            d = c ^ (1 << bit) if bit < k else c
            rows.append(order[at[d] : at[d + 1]])
            points.append(fp[rows[-1]] ^ np.uint64(1 << bit))
        p, r, centre = np.concatenate(points), np.concatenate(rows), np.zeros(sum(map(len, rows)), bool)
        centre[: len(rows[0])] = True
        by = np.lexsort((~centre, p))
        p, r, centre = p[by], r[by], centre[by]
        if most == 2:
            i = np.flatnonzero(p[1:] == p[:-1])
            label = united(label, r[i], r[i + 1])
        else:  # 1: the point must be one of the two itself
            first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            head = np.repeat(first, np.diff(np.r_[first, len(p)]))
            i = np.flatnonzero(centre[head])
            label = united(label, r[i], r[head[i]])
    return label


def _links(nodes: DataFrame, keyed: Callable, words: int, most: int) -> DataFrame:
    """a, b: links that connect what nodes (node long, sig binary) that meet at a key and differ in at most `most` bits connect.

    keyed gives the row, the key and the deciding words of signatures. What the keys compared at a
    time connect is linked to the smallest node of it, often the same, so links are few more than nodes.
    """
    ship(nodes.sparkSession)

    @task
    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), ">u8").astype(np.uint64).reshape(part.num_rows, -1)
                row, key, deciding = keyed(sig)
                yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0).take(pa.array(row)), *(pa.array(deciding[:, k].view(np.int64)) for k in range(words))], names)

    @task
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def links(cols: list[np.ndarray]) -> pa.RecordBatch:
            root = connected(cols[0], np.stack(cols[2:], 1).view(np.uint64), most)
            b = np.flatnonzero(root != np.arange(len(root)))
            known, at = np.unique(np.stack([cols[1][root[b]], cols[1][b]]), return_inverse=True)
            root = united(np.arange(len(known)), *at.reshape(2, -1))
            b = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(known[root[b]]), pa.array(known[b])], ["a", "b"])

        count, room = 0, ROWS
        for batch in batches:
            held.append([np.asarray(c) for c in batch.columns])
            count += batch.num_rows
            if count >= room:
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on
                if cut:
                    yield links([c[:cut] for c in cols])
                    cols = [c[cut:] for c in cols]
                held, count = [cols], len(cols[0])
                room = count + ROWS
        if held:
            yield links([np.concatenate(c) for c in zip(*held, strict=True)])

    names = ["key", "node", *(f"w{k}" for k in range(words))]
    sent = nodes.mapInArrow(replicate, ", ".join(f"{n} long" for n in names))
    return sent.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long").distinct()


def crowded(nodes: DataFrame, threshold: int, crowd: int | None = None) -> np.ndarray:
    """The crowded anchors of fingerprints, sorted: at most about 3 million, as each has its share of the anchors of a bounded sample."""
    ship(nodes.sparkSession)
    n = nodes.count()
    limit = crowd or max(CROWD, n // CROWD_SHARE)
    if n <= limit:
        return np.empty(0, np.int64)
    one_in = max(LOOKED_AT, n // LOOKED_AT_MOST) if crowd is None else 1

    @task
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u8").astype(np.uint64)
            for at in range(0, len(sig), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(anchors_of_fingerprints(sig[at : at + 2000], threshold)[1])], ["key"])

    sample = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(one_in)) == 0).select("sig").mapInArrow(keys, "key long")
    found = sample.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * one_in > limit).select("key")
    return np.sort(np.array([r.key for r in found.collect()], np.int64))


def split_anchors(fp: np.ndarray, threshold: int, crowds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """row, key of fingerprints: an anchor and 0, or for crowded anchors one key for each part (1 to 3) and 6 bits of the 18 that anchors leave over."""
    row, anchor = anchors_of_fingerprints(fp, threshold)
    many = np.isin(anchor, crowds) if len(crowds) else np.zeros(len(anchor), bool)
    rows, keys = [row[~many]], [anchor[~many] << 8]
    rest = (fp[row[many]] & np.uint64(0x3FFFF)).astype(np.int64)
    for part in range(3):
        rows.append(row[many])
        keys.append(anchor[many] << 8 | (part + 1) << 6 | rest >> 6 * part & 63)
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint_links(nodes: DataFrame, threshold: int = 2, crowd: int | None = None) -> DataFrame:
    """a, b: links that connect what differs in at most threshold (0 to 2) bits. nodes: distinct node, and sig of 8 bytes. crowd: fingerprints from which on an anchor is split."""
    crowds = nodes.sparkSession.sparkContext.broadcast(crowded(nodes, threshold, crowd))

    def keyed(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, key = split_anchors(sig[:, 0], threshold, crowds.value)
        return row, key, sig[row]

    return _links(nodes, keyed, 1, threshold)


def similar_links(nodes: DataFrame) -> DataFrame:
    """a, b: links that connect all nodes (node, sig) that are equal in one of the blocks and differ in at most CHECK_BITS check bits; kept.

    What a turn of blocks connects is one node in the next, so links that are known are not found again.
    """
    found, sent = (), nodes
    for at in range(0, BLOCKS, AT_ONCE):
        blocks = range(at, min(at + AT_ONCE, BLOCKS))
        if found:
            sent = nodes.join(components(found[0], "a", "b"), "node", "left").select(F.coalesce("root", "node").alias("node"), "sig")
        links = _links(sent, lambda sig, blocks=blocks: keys_of_signatures(sig[:, :WORDS], blocks), CHECK_WORDS, CHECK_BITS)
        found = (kept(links.unionByName(found[0]) if found else links, "found", found),)
    return found[0]


def alike(part: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray], within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect the rows of different parts (within: of any) whose sets have similarity 0.8 or more.

    Every pair of rows not connected yet is compared: sizes and sketches leave out what is clearly less similar, the sets decide.
    """
    size = np.array([len(h) for h in sets], np.int64)
    known, ids = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True)
    start, shared, root = np.cumsum(size) - size, np.zeros(len(known), bool), np.arange(len(sets))
    left, right = [], []
    for i in range(len(sets) - 1):
        j = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & (within | (part[i + 1 :] != part[i])))
        j = j[5 * np.minimum(size[i], size[j]) >= 4 * np.maximum(size[i], size[j])]
        j = j[may_be_similar(sketches[i], sketches[j])]
        if not len(j):
            continue
        own = ids[start[i] : start[i] + size[i]]
        shared[own] = True
        row, k = ragged(size[j])
        both = np.bincount(row[shared[ids[start[j][row] + k]]], minlength=len(j))
        shared[own] = False
        j = j[(both > 0) & (5 * both >= 4 * (size[i] + size[j] - both))]
        roots, first = np.unique(root[j], return_index=True)
        left += [i] * len(first)
        right += j[first].tolist()
        root[np.isin(root, roots)] = root[i]
    return np.array(left, np.int64), np.array(right, np.int64)


def confirmed(links: DataFrame, sketches: DataFrame, docs: DataFrame, text: str, shingle: int, row: str) -> DataFrame:
    """a, b: links that connect what has sets of shingles of similarity 0.8 or more, of all pairs of row numbers that links (a, b) connect, directly or along a chain.

    What links connect is a cluster. It is cut into parts, and every two parts meet in a tile, where all
    pairs are compared; so a set is sent as often as its cluster has parts, however many pairs there are.
    """

    @task
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in some.column(1)], pa.binary())], ["node", "h"])

    @task
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ([x.as_py() for x in r] for batch in batches for r in zip(*batch.columns, strict=True))
        for (_, low, high), tile in groupby(rows, lambda r: r[:3]):
            part, node, sketch, h = zip(*(r[3:] for r in tile), strict=True)
            i, j = alike(np.array(part), np.frombuffer(b"".join(sketch), np.uint8).reshape(-1, 256), [np.frombuffer(x, np.uint64) for x in h], low == high)
            nodes = np.array(node, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[j])], ["a", "b"])

    def only(rows: DataFrame, members: DataFrame) -> DataFrame:
        found, (member,) = marked(rows, "node", members, "node", F.lit(True))
        return found.filter(member).select(*rows.columns)

    roots = components(links, "a", "b")
    members = kept(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "members")
    have = kept(only(docs.select(F.col(row).alias("node"), whole(docs[text]).alias("text")), members).mapInArrow(sets, "node long, h binary"), "sets")
    sized = kept(members.join(have.select("node", F.length("h").alias("bytes")), "node"), "sized", (members,))
    n, parts = F.count(F.lit(1)), F.ceil(F.sum("bytes") / PART_BYTES)
    clusters = sized.groupBy("root").agg(F.greatest(parts, F.ceil(n / PART_ROWS), F.least(F.ceil(n / LEAST_PART), F.lit(MORE_PARTS))).cast("int").alias("parts"))
    dealt = sized.join(clusters, "root").select("node", "root", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    tiles = dealt.select("root", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node").join(only(sketches, sized), "node").join(have, "node")
    tiles = tiles.select("root", "low", "high", "part", "node", "sketch", "h").repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    return kept(tiles.mapInArrow(compare, "a long, b long"), "confirmed", (have, sized))


def similar_roots(nodes: DataFrame, sketches: DataFrame, docs: DataFrame, text: str, shingle: int, row: str) -> DataFrame:
    """node, root: the smallest node of each component of similarity 0.8, for every node; what meets at no block is compared where a chain of others leads to it."""
    links = similar_links(nodes)
    pairs = confirmed(links, sketches, docs, text, shingle, row)
    discard(links)
    roots = components(pairs, "a", "b")
    discard(pairs)
    return nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def fingerprint_groups(docs: DataFrame, shingle: int = 3, threshold: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id reachable, for every row of docs.

    Equal fingerprints are one node, so copies cost nothing further. Null and empty texts have
    fingerprint zero. A null doc_id is grouped like any row and never a component_id, unless its
    component has no other. Repeated rows stay repeated; no rows in, no rows out.
    """
    rows = kept(signatures(docs, lambda t: fingerprint(t, shingle), text, doc_id).select("doc_id", F.conv(F.hex("sig"), 16, -10).cast("long").alias("node"), "sig"), "fingerprints")
    nodes = kept(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.any_value("sig").alias("sig")), "nodes")
    roots = components(fingerprint_links(nodes.select("node", "sig"), threshold), "a", "b")
    placed = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(ids, "root").select("node", "component_id")
    return rows.join(named, "node").select("doc_id", F.lower(F.hex("sig")).alias("fingerprint"), "component_id")


def drop_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5) -> DataFrame:
    """docs with one row, that of the smallest doc_id (null last), of each group linked by similarity of 0.8 or more; columns as they were.

    Similarity is that of the sets of five-word shingles, compared in full for all candidates that
    SimHash signatures name. doc_id may be null or repeated.
    """
    docs_, row = numbered(docs)
    name = fresh("__key", row, *docs.columns)
    key = F.struct(docs_[doc_id].isNull().alias("n"), docs_[doc_id].alias("i"), F.col(row).alias("r"))
    rows = kept(signatures(docs_.withColumn(name, key), lambda t: signature(shingle_set(t, shingle), WORDS), text, name), "signatures")
    nodes = kept(rows.groupBy("sig").agg(F.min("doc_id").alias("best")).select(F.col("best.r").alias("node"), F.substring("sig", 1, 8 * WORDS + 16).alias("sig"), F.substring("sig", 8 * WORDS + 17, 256).alias("sketch"), "best"), "nodes", (rows,))
    roots = similar_roots(nodes.select("node", "sig"), nodes.select("node", "sketch"), docs_, text, shingle, row)
    stay = kept(nodes.select("node", "best").join(roots, "node").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.r").alias("row")), "stay", (nodes,))
    found, (stays,) = marked(docs_, row, stay, "row", F.lit(True))
    return found.filter(stays).select(*docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_groups(table(spark, sf_dir, "documents"))
