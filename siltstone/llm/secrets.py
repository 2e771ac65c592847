"""Secret scan: fixed patterns, and a randomness test battery for tokens that no pattern names.

A candidate is a run of at least MIN_TOKEN characters of common encodings; its encoding is the
smallest alphabet that holds it. Every candidate is tested and gets a p-value of being ordinary
text: the larger of how rarely text of that length and encoding comes out as uniform (chi-squared)
and changes its kind of character as often (runs), and 1 where the battery rejects randomness
itself: chi-squared uniformity over the alphabet, runs about the alphabet's middle, serial
correlation of neighbours. The larger of two p-values is one too, however they depend on each
other, and so is one raised to 1 for some tokens. False discoveries are controlled by Benjamini-Hochberg within each stratum of
encoding and length, over all candidates of the whole corpus, those with p-value 1 included:
p-values are counted in fixed bins, so only a small histogram reaches the driver.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, ship, table, task, whole

KINDS = ("assign", "access", "hex", "random")
#: The base patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api")

MIN_TOKEN = 20
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}" % MIN_TOKEN)
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (DIGITS + "abcdef", DIGITS + "ABCDEF", UPPER + "234567", DIGITS + LOWER, UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_")
LENGTHS = (20, 24, 32, 48, 64)  # where strata of length begin
#: Randomness is rejected below ALPHA; the false-discovery rate; how often ordinary text changes its kind of character; bins of -log10 p to a unit, and the largest.
ALPHA, RATE, CHANGES, BIN, TOP = 1e-3, 0.01, 0.12, 20, 60
#: Letters of ordinary text, in per mille.
LETTERS = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (127, 91, 82, 75, 70, 67, 63, 61, 60, 43, 40, 28, 28, 24, 24, 22, 20, 20, 19, 15, 10, 8, 2, 2, 1, 1), strict=True))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base patterns, sorted; code points, end exclusive."""
    low, out = text.encode("utf-8", "surrogatepass").lower(), []
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if max(map(len, text.split()), default=0) >= HEX_LEAST:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def _normal_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def chi_squared_tail(x: float, df: int) -> float:
    """P(chi-squared with df degrees > x), by the cube-root normal approximation."""
    return _normal_tail(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


@lru_cache(4096)
def binomial_tail(n: int, least: int, p: float) -> float:
    """P(binomial(n, p) >= least); for long tokens Chernoff's bound, which is larger."""
    if least <= n * p:
        return 1.0
    if n > 1000:
        x = least / n
        return math.exp(-n * (x * math.log(x / p) + ((1 - x) * math.log((1 - x) / (1 - p)) if x < 1 else 0)))
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(least, n + 1)]
    return min(1.0, sum(math.exp(v) for v in logs))


@lru_cache
def textual(encoding: int) -> float:
    """How far ordinary text is from uniform over the alphabet: the noncentrality of chi-squared per character."""
    alphabet = ENCODINGS[encoding]
    weight = np.array([LETTERS.get(c.lower(), 0) if c.isalpha() else 0 for c in alphabet], float)
    if encoding > 3:
        weight[[c.isupper() for c in alphabet]] *= 0.05
    weight += weight.sum() * 0.02 / len(alphabet)
    p = weight / weight.sum()
    return float((p * p).sum() * len(alphabet) - 1)


def looks_random(v: np.ndarray, m: int, x2: float) -> bool:
    """Whether none of the three tests rejects that characters (places in an alphabet of m) are random; x2: their chi-squared."""
    n = len(v)
    if chi_squared_tail(x2, m - 1) < ALPHA:
        return False
    side = v * 2 >= m
    runs, a = 1 + int((side[1:] != side[:-1]).sum()), int(side.sum())
    if not 0 < a < n:
        return False
    mean = 1 + 2 * a * (n - a) / n
    if 2 * _normal_tail(abs(runs - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))) < ALPHA:
        return False
    d = v - (m - 1) / 2
    return 2 * _normal_tail(abs(float((d[1:] * d[:-1]).sum())) / ((m * m - 1) / 12 * math.sqrt(n - 1))) >= ALPHA


def evidence(token: str) -> tuple[int, float] | None:
    """(stratum, -log10 p of being ordinary text) of a token; 0 where the battery rejects that it is random; None for no encoding."""
    used = set(token)
    encoding = next((i for i, a in enumerate(ENCODINGS) if used <= set(a)), None)
    if encoding is None:
        return None
    alphabet, n = ENCODINGS[encoding], len(token)
    m, place = len(alphabet), {c: i for i, c in enumerate(alphabet)}
    stratum = encoding * len(LENGTHS) + sum(n >= at for at in LENGTHS) - 1
    v = np.array([place[c] for c in token])
    x2 = float(((np.bincount(v, minlength=m) - n / m) ** 2).sum() * m / n)
    if not looks_random(v, m, x2):
        return stratum, 0.0
    far = n * textual(encoding)
    uniform = _normal_tail((m - 1 + far - x2) / math.sqrt(2 * (m - 1 + 2 * far)))
    kind = [0 if c.isdigit() else 1 if c.islower() else 2 for c in token if c.isalnum()]  # text separates its words with the other characters
    changes = binomial_tail(max(len(kind) - 1, 0), sum(a != b for a, b in zip(kind, kind[1:], strict=False)), CHANGES)
    return stratum, max(0.0, -math.log10(max(uniform, changes, 1e-300)))


def candidates(text: str, taken: list[tuple[int, int, int]]) -> tuple[list[dict], dict[int, int]]:
    """Tokens that do not touch a base span (taken, sorted) and may be discovered: start, end, stratum, bin; and how many others of each stratum were tested."""
    if max(map(len, text.split()), default=0) < MIN_TOKEN:
        return [], {}
    out, others, k, reach = [], Counter(), 0, 0
    for t in TOKEN.finditer(text):
        a, z = t.span()
        while k < len(taken) and taken[k][0] < z:
            reach = max(reach, taken[k][2])
            k += 1
        if reach > a:
            continue
        if got := evidence(t[0]):
            at = int(min(got[1], TOP) * BIN)
            if at:
                out.append({"start": a, "end": z, "stratum": got[0], "bin": at})
            else:
                others[got[0]] += 1
    return out, others


SCANNED = "n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:long,kind:int,end:long>>, found array<struct<start:long,end:long,stratum:int,bin:int>>, others array<struct<stratum:int,n:long>>"


def scanned(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select(docs[doc_id].alias("doc_id"), whole(docs[text]).alias("text"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    token = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("bin", pa.int32())]))
    tested = pa.list_(pa.struct([("stratum", pa.int32()), ("n", pa.int64())]))

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for t in batch.column(1):
                t = t.as_py()
                spans = base_spans(t)
                kinds = [k for _, k, _ in spans]
                found, others = candidates(t, spans)
                values = kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(written(spans).encode()).hexdigest(), [{"start": a, "kind": k, "end": z} for a, k, z in spans], found, [{"stratum": s, "n": n} for s, n in others.items()]
                for c, x in zip(cols, values, strict=True):
                    c.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span, token, tested]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "found", "others"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCANNED}")


def thresholds(scan: DataFrame, rate: float = RATE) -> list[int]:
    """The least bin discovered in each stratum, by Benjamini-Hochberg over all its candidates; beyond the last bin where none is. A bin counts with its largest p-value."""
    tokens = scan.select(F.explode("found").alias("t")).groupBy("t.stratum", "t.bin").agg(F.count(F.lit(1)).alias("n"))
    others = scan.select(F.explode("others").alias("t")).groupBy("t.stratum").agg(F.sum("t.n").alias("n")).select("stratum", F.lit(0).alias("bin"), "n")
    counts = tokens.unionByName(others).collect()
    least = []
    for s in range(len(ENCODINGS) * len(LENGTHS)):
        n = np.zeros(TOP * BIN + 1)
        for r in counts:
            if r["stratum"] == s:
                n[r["bin"]] = r["n"]
        above = np.cumsum(n[::-1])[::-1]
        p = 10.0 ** -(np.arange(len(n)) / BIN)
        ok = np.flatnonzero((above > 0) & (p < 1) & (p * n.sum() <= rate * above))
        least.append(int(ok[0]) if len(ok) else len(n))
    return least


def secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for every row of docs.

    spans: kind:start:end, by start, then kind as in KINDS, comma-joined; empty where nothing is
    found. Null texts are empty; equal texts have equal spans; repeated rows stay and count as
    candidates of their own; no rows in, no rows out.
    """
    scan = kept(scanned(docs, text, doc_id), "scan")
    least = F.array(*map(F.lit, thresholds(scan, rate)))

    def as_span(c: Column) -> Column:
        return F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end"))

    chosen = F.transform(F.filter("found", lambda c: c["bin"] >= F.element_at(least, c["stratum"] + 1)), as_span)
    names = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform(F.array_sort(F.concat("base", chosen)), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    return scan.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), F.size(chosen).cast("long").alias("n_random"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
