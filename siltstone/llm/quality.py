"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

A document becomes a short vector of statistics of its whole text. Standardised, they go through
random Fourier features, which approximate a Gaussian kernel. Each task sums its share of the
normal equations; the sums (a few partitions, FEATURES squared) meet on the driver, which solves
the ridge system. Scores of rows kept out of the fit are put in bins and made monotone
(pool adjacent violators), which gives the calibration.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, ship, table, task, whole

#: Random features, their kernel's width in standard deviations, the ridge, the seed.
FEATURES, WIDTH, RIDGE, SEED = 512, 6.0, 1e-3, 7
#: The classifier is fitted on at most so many labelled rows, picked by hash, in so many partitions.
MAX_TRAIN, PARTS = 200_000, 16
#: Bins of raw scores for the calibration; the score from which a document is predicted good.
BINS, GOOD = 2000, 0.3
#: Rows scored at a time.
SCORED = 1000

STATISTICS = (
    "log bytes", "lower", "upper", "digits", "space", "line ends", "full stops", "commas", "bars", "exclamations", "hash dollar percent", "stars and ampersands", "other signs", "beyond ASCII", "entropy",
    "log words", "word length", "word length spread", "distinct words", "top word", "top ten words", "lines per word", "distinct lines", "line length spread", "lines ending in signs", "words ending in signs", "title words", "upper words", "compressed", "long words", "one-letter words", "repeated word pairs",
)

_CLASSES = np.zeros((256, 13))
for _k, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",;", b"|", b"!?", b"#$%", b"*&")):
    _CLASSES[list(_set), _k] = 1
_CLASSES[[b for b in range(33, 127) if not _CLASSES[b].any()], 11] = 1
_CLASSES[128:, 12] = 1
SIGNS = b"!?#$%*&|@~^="


def statistics(text: str) -> np.ndarray:
    """The vector of STATISTICS of one text; all zero for the empty text."""
    data = text.encode("utf-8", "surrogatepass")
    out = np.zeros(len(STATISTICS))
    n = len(data)
    if not n:
        return out
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = seen[seen > 0] / n
    out[0], out[1:14], out[14] = math.log1p(n), seen @ _CLASSES / n, -(share * np.log2(share)).sum()
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    m = len(words)
    if m:
        length = np.fromiter(map(len, words), np.int64, m)
        count = Counter(words)
        top = [c for _, c in count.most_common(10)]
        pairs = m - 1
        out[15:21] = math.log1p(m), length.mean(), length.std(), len(count) / m, top[0] / m, sum(top) / m
        rows = np.fromiter(map(len, lines), np.int64, len(lines))
        out[21:25] = len(lines) / m, len(set(lines)) / len(lines), rows.std() / (1 + rows.mean()), sum(x.rstrip()[-1] in SIGNS for x in lines) / len(lines)
        out[25:28] = sum(w[-1] in SIGNS for w in words) / m, sum(map(bytes.istitle, words)) / m, sum(map(bytes.isupper, words)) / m
        out[29:32] = (length > 14).mean(), (length == 1).mean(), 1 - len(set(zip(words, words[1:], strict=False))) / pairs if pairs else 0
    out[28] = len(zlib.compress(data, 1)) / n
    return out


def described(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with f, the statistics of their text, in place of the text."""
    names, where = [c for c in rows.columns if c != text], rows.columns.index(text)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.concatenate([np.empty(0), *(statistics(t.as_py() or "") for t in batch.column(where))]).astype(np.float32)
            f = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(STATISTICS)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), f], [*names, "f"])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, rows.drop(text).withColumn("f", F.lit(None).cast("array<float>")).schema)


def fold(doc_id: str | Column, of: int) -> Column:
    """crc32 of doc_id as text, modulo `of`; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit("")).cast("binary")) % of


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    xs: np.ndarray
    ys: np.ndarray

    def features(self, f: np.ndarray) -> np.ndarray:
        """Random Fourier features of statistics, with a constant."""
        rng = np.random.default_rng(SEED)
        w, b = rng.standard_normal((f.shape[1], FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)
        x = np.clip((f - self.mean) / self.spread, -5, 5)
        return np.hstack([np.cos(x @ w + b) * math.sqrt(2 / FEATURES), np.ones((len(f), 1))])

    def raw(self, f: np.ndarray) -> np.ndarray:
        return self.features(f) @ self.weights

    def score(self, f: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(f), self.xs, self.ys), 0, 1)

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        """The score of each text, described one at a time; null is empty."""
        f = np.array([statistics(t.as_py() or "") for t in texts], np.float32).reshape(-1, len(STATISTICS))
        return np.concatenate([np.empty(0), *(self.score(f[at : at + SCORED].astype(np.float64)) for at in range(0, len(f), SCORED))])


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, len(STATISTICS))


def monotone(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins sorted by x: centres and shares of good, not decreasing."""
    blocks: list[list[float]] = []
    for a, g, c in zip(x, good, n, strict=True):
        blocks.append([a * c, g, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def labelled(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_train: int = MAX_TRAIN) -> DataFrame:
    """y, fold and f of the labelled rows of docs outside the held-out fold, about max_train at most.

    Null labels and rows without doc_id are left out; of several labels of a doc_id the largest
    counts. Labels are picked by hash, so those broadcast are bounded, and only their texts are read
    whole; of many rows of one doc_id a share is picked by their numbers.
    """
    marks = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y")).withColumn("fold", fold("doc_id", 5)).filter("fold != 0")
    marks = kept(marks, "marks")

    def picked(df: DataFrame, key: str) -> DataFrame:
        n = df.count()
        return df.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * max_train / n)) if n > max_train else df

    rows = docs.select(docs[doc_id].alias("doc_id"), whole(docs[text]).alias("text")).join(F.broadcast(picked(marks, "doc_id")), "doc_id").select("text", "y", "fold")
    return picked(kept(described(rows).withColumn("row", F.monotonically_increasing_id()), "train", (marks,)), "row")


def fit(train: DataFrame) -> Model:
    """Learn from rows of y, fold and f: those of fold 1 calibrate, the others fit.

    Without labels of both kinds every score is the share of good labels, or one half.
    """
    n, good = train.agg(F.count(F.lit(1)), F.sum("y")).first()
    flat = Model(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), np.zeros(FEATURES + 1), np.array([0.0]), np.array([good / n if n else 0.5]))
    if not n or not 0 < good < n:
        return flat
    rows = train.coalesce(PARTS)

    def sums(make):
        @task
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = make(matrix(batch.column(0)), np.asarray(batch.column(1), np.float64))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        return run

    def gathered(df: DataFrame, make) -> np.ndarray:
        return sum(np.frombuffer(r[0], np.float64) for r in df.select("f", "y").mapInArrow(sums(make), "sums binary").collect())

    width = len(STATISTICS)
    moments = gathered(rows, lambda f, y: np.r_[len(f), f.sum(0), (f * f).sum(0)])
    mean = moments[1 : 1 + width] / moments[0]
    model = Model(mean, np.sqrt(np.maximum(moments[1 + width :] / moments[0] - mean**2, 0)) + 1e-6, flat.weights, flat.xs, flat.ys)

    def normal(f: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(f)
        return np.r_[(z.T @ z).ravel(), z.T @ y, len(f)]

    equations = gathered(rows.filter("fold != 1"), normal)
    d = FEATURES + 1
    if np.ndim(equations) == 0:
        return flat
    a, b, m = equations[: d * d].reshape(d, d), equations[d * d : -1], equations[-1]
    model.weights = np.linalg.solve(a + RIDGE * m / d * np.eye(d), b)

    @task
    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.floor(np.clip(model.raw(matrix(batch.column(0))), -0.5, 1.5) * (BINS / 2)).astype(np.int64) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], ["bin", "y"])

    bins = rows.filter("fold = 1").select("f", "y").mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.sum("y"), F.count(F.lit(1))).collect()
    if bins:
        bins = np.array(sorted(bins), np.float64)
        model.xs, model.ys = monotone((bins[:, 0] + 0.5) / (BINS / 2), bins[:, 1], bins[:, 2])
    else:
        model.xs, model.ys = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", good: float = GOOD, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from `good` on) for every row of docs.

    The score depends on the text alone; null and empty texts have the same. Repeated rows get
    equal scores. An empty table gives no rows; other columns of docs are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled(docs, labels, text, doc_id, max_train=max_train)))

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.of_texts(batch.column(1)))], ["doc_id", "score"])

    rows = docs.select(docs[doc_id].alias("doc_id"), whole(docs[text]).alias("text"))
    scores = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scores.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= good).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", good: float = GOOD, max_train: int = MAX_TRAIN) -> DataFrame:
    """docs without the rows predicted bad; columns as they were. The texts are scored where they are, so no text is shuffled."""
    train = labelled(docs, labels, text, doc_id, max_train=max_train)
    model, where = docs.sparkSession.sparkContext.broadcast(fit(train)), docs.columns.index(text)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.value.of_texts(batch.column(where)) >= good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
