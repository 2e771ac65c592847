"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised to levels (powers of BASE); an n-gram is put in the
filter once for each level up to its own. A probe asks for level 1, 2, ... until one is missing, and
the last level found stands for the count. The filter's size follows the number of entries, so the
rate of false positives does not grow with the corpus.

Texts are tokenised once, into chunks: the hashes of a chunk's words, and a number for each token.
A chunk's distinct n-grams and their counts go to buckets of the hash range; a bucket's task adds
them up exactly, makes its slice of the filter, and answers each chunk with the exact counts of its
words, which the base score takes. Where the filter is sure to fit in MAX_FILTER bytes (it has at
most a byte for each byte of text and three for each row) it is broadcast and probed by the tasks that
score; a larger one is probed slice by slice where it is made, and the levels go back with the counts.
Both ways give the same scores.

Words are told apart by 64-bit hashes, pairs by as many bits as 6 bytes and their bucket hold. How
many buckets there are follows from the bytes of text alone, so scores do not depend on how the
rows lie in files and partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, ranges, ship, table, task, whole
from .quality import fold

BASE, PROBES, BITS_PER_ENTRY, MAX_FILTER = 1.5, 4, 8, 64 << 20
#: Bytes of text to a bucket of the hash range, and the fewest and most buckets, as powers of two.
BUCKET_BYTES, BUCKET_BITS = 3 << 19, (8, 18)
#: Characters of a chunk.
CHUNK = 1 << 21
#: Weight of the word's own probability against the pair's count.
SMOOTHING = 200.0
END = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of a public hash: every bit of x reaches every bit."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def pair(first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
    """The hash of a pair of words, whose lowest bits are 0 where 6 bytes and the bucket do not hold them."""
    rest = max(0, 16 - (buckets - 1).bit_length())
    return mix(first * _U(0x9E3779B97F4A7C15) + (second ^ (second >> _U(31)))) >> _U(rest) << _U(rest)


def short(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Pairs without the bits that their bucket tells: 6 bytes each."""
    return (keys << _U((buckets - 1).bit_length())).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]


def long(data: bytes, bucket: int, buckets: int) -> np.ndarray:
    """Pairs back from their 6 bytes and their bucket."""
    b, full = (buckets - 1).bit_length(), np.zeros((len(data) // 6, 8), np.uint8)
    full[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return full.view(">u8").ravel().astype(np.uint64) >> _U(b) | _U(bucket << (64 - b))


def planes(counts: np.ndarray, size: int = 4) -> bytes:
    """Counts of `size` bytes as their lowest bytes, then the next, and so on: mostly zeros, which compress away."""
    return counts.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes()


def unplaned(data: bytes, size: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(f"<u{size}").ravel().astype(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, and 1 more for each factor of BASE."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def expected(most: int = 120) -> np.ndarray:
    """The middle of the counts that a level stands for; 0 for level 0."""
    lo, hi = np.ceil(BASE ** np.arange(most) - 1e-9), np.ceil(BASE ** np.arange(1, most + 1) - 1e-9) - 1
    return np.r_[0.0, (lo + np.maximum(hi, lo)) / 2]


def places(keys: np.ndarray, level: np.ndarray | int, probe: int, bits: np.ndarray) -> np.ndarray:
    """The bit within its slice that a probe of a key at a level asks for."""
    x = mix(keys + _U(0xD6E8FEB86659FD93) * np.asarray(level, np.uint64))
    return ((x & _U(0xFFFFFFFF)) + _U(probe) * (x >> _U(32) | _U(1))) % bits


class Filter:
    """Slices of bits, one for each bucket of the hash range."""

    def __init__(self, bits: np.ndarray, first: np.ndarray, size: np.ndarray):
        self.bits, self.first, self.size = bits, first.astype(np.uint64), size.astype(np.uint64)
        self.shift = _U(64 - (len(size) - 1).bit_length()) if len(size) > 1 else None

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The last level of each key that is found, asking for one after the other."""
        out = np.zeros(len(keys), np.int64)
        bucket = (keys >> self.shift).astype(np.int64) if self.shift is not None else np.zeros(len(keys), np.int64)
        first, size = self.first[bucket], self.size[bucket]
        at = np.flatnonzero(size > 0)
        level = 0
        while len(at) and level < 118:
            level += 1
            for probe in range(PROBES):
                where = first[at] + places(keys[at], level, probe, size[at])
                at = at[(self.bits[(where >> _U(3)).astype(np.int64)] >> (where & _U(7)).astype(np.uint8)) & 1 > 0]
                if not len(at):
                    break
            out[at] = level
        return out


def slice_of(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, int]:
    """The filter slice of a bucket's n-grams, and its bits; as large as its entries ask for."""
    level = levels(counts)
    entries = int(level.sum())
    size = max(64, entries * BITS_PER_ENTRY // 64 * 64) if entries else 0
    out = np.zeros(size, np.bool_)
    for j in range(1, int(level.max(initial=0)) + 1):
        on = keys[level >= j]
        for probe in range(PROBES):
            out[places(on, j, probe, np.full(len(on), size, np.uint64)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes(), size


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    if not len(k):
        return k, c
    order = np.argsort(k)
    k, c = k[order], c[order]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[start], np.add.reduceat(c, start)


def buckets_for(size: int) -> int:
    """How many buckets texts of so many bytes are counted in: a power of two."""
    return 1 << min(max((max(size, 1) // BUCKET_BYTES).bit_length(), BUCKET_BITS[0]), BUCKET_BITS[1])


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted keys, and the end."""
    return np.r_[np.searchsorted(keys, np.arange(buckets, dtype=np.uint64) << _U(64 - (buckets - 1).bit_length())), len(keys)]


class Numbers(dict):
    """Word to its number, in the order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def tokenised(rows: DataFrame) -> DataFrame:
    """Chunks of about CHUNK characters of rows (row, doc_id, text, held_out): chunk, the rows' doc_id, held_out and n (tokens) as lists, the hashes of the chunk's words, most frequent first, and a number for each token."""
    shape = f"chunk long, doc_id array<{rows.schema['doc_id'].dataType.simpleString()}>, held_out array<boolean>, n array<long>, words binary, ids binary"
    names = ["chunk", "doc_id", "held_out", "n", "words", "ids"]

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for span in ranges(pc.utf8_length(batch.column(2)).to_pylist(), CHUNK):
                row, doc_id, text, held_out = batch.slice(span.start, span.stop - span.start).columns
                numbers = Numbers({b"": 0})  # no word is empty; this is the end
                texts = [words_of(t.as_py()) for t in text]
                for t in texts:
                    t.append(b"")
                n = np.fromiter(map(len, texts), np.int64, len(texts))
                ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), np.int64, int(n.sum()))
                words = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
                words[0] = END
                order = np.argsort(-np.bincount(ids, minlength=len(words)), kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (doc_id, held_out, pa.array(n))]
                yield pa.RecordBatch.from_arrays([row.slice(0, 1), *lists, pa.array([words[order].tobytes()], pa.binary()), pa.array([planes(place[ids])], pa.binary())], names)

    return rows.mapInArrow(run, shape)


class Chunk:
    """The tokens of a chunk: words (hashes), ids (a number for each token), n (tokens of each row), pairs (a hash for each token and the one before)."""

    def __init__(self, words: bytes, ids: bytes, n: np.ndarray, buckets: int):
        self.words, self.ids, self.n = np.frombuffer(words, np.uint64), unplaned(ids), n
        h = self.words[self.ids]
        self.pairs = pair(np.r_[END, h[:-1]], h, buckets)  # the last token of a row is the end
        self.order = np.argsort(self.words, kind="stable")


def counted(chunks: DataFrame, buckets: int, sliced: bool) -> DataFrame:
    """For each bucket a row without chunk: bits (unless sliced) and size of its slice, tokens and kinds of training words; and for each chunk that has n-grams there: the exact counts of its words and, if sliced, the levels of its words and pairs, in the order of the hashes."""
    names = ["bucket", "chunk", "k1", "c1", "k2", "c2"]
    out = {"bucket": pa.int32(), "chunk": pa.int64(), "bits": pa.binary(), "size": pa.int64(), "tokens": pa.int64(), "kinds": pa.int64(), "counts": pa.binary(), "words_at": pa.binary(), "pairs_at": pa.binary()}

    @task
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, held_out, n, words, ids in zip(*batch.columns, strict=True):
                n = np.asarray(n.values)
                c = Chunk(words.as_py(), ids.as_py(), n, buckets)
                train = np.repeat(~np.asarray(held_out.values.to_numpy(zero_copy_only=False), bool), n)
                k1, c1 = c.words[c.order], np.bincount(c.ids[train], minlength=len(c.words))[c.order]
                k2, c2 = np.unique(c.pairs[train], return_counts=True)
                if sliced:
                    keys = np.union1d(k2, c.pairs[~train])
                    times = np.zeros(len(keys), np.int64)
                    times[np.searchsorted(keys, k2)] = c2
                    k2, c2 = keys, times
                a1, a2, k2 = cuts(k1, buckets), cuts(k2, buckets), short(k2, buckets)
                some = np.flatnonzero((np.diff(a1) > 0) | (np.diff(a2) > 0)).tolist()
                parts = [[make(x[a[i] : a[i + 1]]) for i in some] for x, a, make in ((k1, a1, np.ndarray.tobytes), (c1, a1, planes), (k2, a2, np.ndarray.tobytes), (c2, a2, planes))]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([chunk.as_py()] * len(some), pa.int64()), *(pa.array(p, pa.binary()) for p in parts)], names)

    @task
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> pa.RecordBatch:
            asked, k1, c1, k2, c2 = zip(*held, strict=True)
            (w, wc), (p, pc_) = summed(k1, c1), summed(k2, c2)
            known, seen = wc > 0, pc_ > 0
            bits, size = slice_of(np.r_[w[known], p[seen]], np.r_[wc[known], pc_[seen]])
            rows: list[tuple] = [(at, None, None if sliced else bits, size, int(wc.sum()), int(known.sum()), None, None, None)]
            probed = Filter(np.frombuffer(bits, np.uint8), np.array([0]), np.array([size]))
            levels_ = [x.astype(np.uint8) for x in (probed.level(w), probed.level(p))] if sliced else None
            for chunk, words, pairs in zip(asked, k1, k2, strict=True):
                i = np.searchsorted(w, words)
                answers = (levels_[0][i].tobytes(), levels_[1][np.searchsorted(p, pairs)].tobytes()) if sliced else (None, None)
                rows.append((at, chunk, None, None, None, None, planes(wc[i], 8), *answers))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.values(), strict=True)], list(out))

        for batch in batches:
            for i in range(batch.num_rows):  # one at a time, as a batch is large
                bucket, chunk, k1, c1, k2, c2 = (c[i].as_py() for c in batch.columns)
                if bucket != at:
                    if at is not None:
                        yield done()
                    at, held = bucket, []
                held.append((chunk, np.frombuffer(k1, np.uint64), unplaned(c1), long(k2, bucket, buckets), unplaned(c2)))
        if at is not None:
            yield done()

    sent = chunks.select("chunk", "held_out", "n", "words", "ids").mapInArrow(gather, "bucket int, chunk long, k1 binary, c1 binary, k2 binary, c2 binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(merge, "bucket int, chunk long, bits binary, size long, tokens long, kinds long, counts binary, words_at binary, pairs_at binary")


def gathered(parts: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The filter's bits, and where each bucket's slice begins and how long it is; slices come one partition at a time."""
    size = np.zeros(buckets, np.int64)
    for r in parts.select("bucket", "size").collect():
        size[r.bucket] = r.size
    first = np.cumsum(size) - size
    bits = np.zeros(int(size.sum()) // 8, np.uint8)
    for r in parts.select("bucket", "bits").toLocalIterator():
        bits[first[r.bucket] // 8 : (first[r.bucket] + size[r.bucket]) // 8] = np.frombuffer(r.bits, np.uint8)
    return bits, first, size


def scored(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_filter: int = MAX_FILTER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Rows whose crc32 of doc_id mod 10 is 0 are held out of training; a null doc_id counts as empty
    text. Null texts are empty: one token, the end. Repeated rows are trained on as often as they
    occur. Without training rows every count is 0. No rows in, no rows out.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[doc_id].alias("doc_id"), whole(docs[text]).alias("text"), (fold(docs[doc_id], 10) == 0).alias("held_out"))
    size, count = (x or 0 for x in rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first())
    buckets, sliced = buckets_for(size), size + 3 * count > max_filter
    chunks = kept(tokenised(rows), "chunks")
    parts = kept(counted(chunks, buckets, sliced), "counts")
    slices = parts.filter("chunk IS NULL")
    N, V = (x or 0 for x in slices.agg(F.sum("tokens"), F.sum("kinds")).first())
    whole_filter = None if sliced else spark.sparkContext.broadcast(gathered(slices, buckets))
    total = N + 0.1 * (V + 1)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def score(row: dict[str, pa.Scalar], answers: list[tuple[bytes, bytes, bytes]], probed: Filter | None) -> pa.RecordBatch:
        c = Chunk(row["words"].as_py(), row["ids"].as_py(), np.asarray(row["n"].values), buckets)
        k2, which = np.unique(c.pairs, return_inverse=True)
        if probed:
            level, pair_level = probed.level(c.words), probed.level(k2)
        else:
            level, pair_level = np.empty(len(c.words), np.int64), np.frombuffer(b"".join(a[2] for a in answers), np.uint8)
            level[c.order] = np.frombuffer(b"".join(a[1] for a in answers), np.uint8)
        exact = np.empty(len(c.words), np.int64)
        exact[c.order] = np.concatenate([unplaned(a[0], 8) for a in answers])
        mean = expected()
        guess = mean[level]
        own = (guess + 0.1) / total
        starts = np.cumsum(c.n) - c.n
        g = guess[c.ids]
        before = np.r_[guess[c.words == END][0], g[:-1]]
        both = np.minimum(mean[pair_level[which]], np.minimum(g, before))
        logs = np.log10((both + SMOOTHING * own[c.ids]) / (before + SMOOTHING))
        add = np.add.reduceat
        columns = c.n, add((exact > 0).astype(np.int64)[c.ids], starts), add(np.log10((exact + 0.1) / total)[c.ids], starts), add(logs, starts)
        return pa.RecordBatch.from_arrays([row["doc_id"].values, row["held_out"].values, *map(pa.array, columns)], names)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probed, row, answers = whole_filter and Filter(*whole_filter.value), None, []
        for batch in batches:
            kinds = batch.column(1).to_pylist()
            for i, bucket in enumerate(kinds):
                if bucket >= 0:
                    answers.append(tuple(batch.column(j)[i].as_py() for j in (2, 3, 4)))
                    continue
                if row:
                    yield score(row, answers, probed)
                row, answers = {n: batch.column(n)[i] for n in ("doc_id", "held_out", "n", "words", "ids")}, []
        if row:
            yield score(row, answers, probed)

    texts = chunks.withColumn("bucket", F.lit(-1))
    answers = parts.filter("chunk IS NOT NULL").select("chunk", "bucket", "counts", "words_at", "pairs_at")
    both = answers.unionByName(texts, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "bucket")
    out = both.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(N).cast("long").alias("train_tokens"), "base_score", "score")


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
