"""FNV-1a and Hamming distance as column expressions, and SimHash of whole texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import types

#: 64-bit FNV-1a. The prime is 2**40 + 435, so a product needs 32-bit halves only.
OFFSET_HIGH, OFFSET_LOW, PRIME_LOW, MASK = 0xCBF29CE4, 0x84222325, 435, 0xFFFFFFFF
#: An ideograph, a kana or hangul character alone; else two letters or more.
TOKEN = r"\p{IsIdeographic}|[\x{3040}-\x{30FF}\x{AC00}-\x{D7FF}]|\p{L}{2,}"
PYTHON_TOKEN = r"\p{Ideographic}|[\u3040-\u30FF\uAC00-\uD7FF]|\p{L}{2,}"
MEMORY = 500_000


def _step(hi: Column, lo: Column, unit: Column) -> tuple[Column, Column]:
    lo = lo.bitwiseXOR(unit)
    low = lo * PRIME_LOW
    high = hi * PRIME_LOW + F.shiftright(low, 32) + F.shiftleft(lo, 8)
    return high.bitwiseAND(F.lit(MASK)), low.bitwiseAND(F.lit(MASK))


def fnv64(word: Column) -> Column:
    """FNV-1a over the UTF-16 units of a string, as a signed long."""

    def add(acc: Column, ch: Column) -> Column:
        point = F.ascii(ch).cast("long")
        pair = F.ascii(ch) > 0xFFFF
        first = F.when(pair, F.shiftright(point - 0x10000, 10) + 0xD800).otherwise(point)
        hi, lo = _step(acc["hi"], acc["lo"], first)
        hi2, lo2 = _step(hi, lo, (point - 0x10000).bitwiseAND(F.lit(1023)) + 0xDC00)
        return F.struct(F.when(pair, hi2).otherwise(hi).alias("hi"), F.when(pair, lo2).otherwise(lo).alias("lo"))

    start = F.struct(F.lit(OFFSET_HIGH).cast("long").alias("hi"), F.lit(OFFSET_LOW).cast("long").alias("lo"))
    chars = F.filter(F.split(word, ""), lambda c: c != "")
    return F.aggregate(chars, start, add, lambda a: F.shiftleft(a["hi"], 32).bitwiseOR(a["lo"]))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _fnv(word: str) -> int:
    h, data = OFFSET_HIGH << 32 | OFFSET_LOW, word.encode("utf-16-le", "surrogatepass")
    for low, high in zip(data[::2], data[1::2], strict=True):
        h = (h ^ (high << 8 | low)) * ((1 << 40) + PRIME_LOW) & 0xFFFFFFFFFFFFFFFF
    return h


@F.pandas_udf(types.of("string"))
def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """SimHash of a text's tokens, occurrences counted, as 16 hex digits; zeros without tokens.

    A row is hashed where it is: counting words by joins instead would shuffle every token. Hashes
    of words are remembered, up to MEMORY of them.
    """
    import regex

    find, known = regex.compile(PYTHON_TOKEN).findall, {}

    def one(text: str | None) -> str:
        counts = Counter(find((text or "").lower()))
        if not counts:
            return "0" * 16
        if len(known) > MEMORY:
            known.clear()
        for w in counts:
            if w not in known:
                known[w] = _fnv(w)
        h = np.fromiter(map(known.__getitem__, counts), ">u8", len(counts))
        n = np.fromiter(counts.values(), np.int64, len(counts))
        ones = n @ np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
        return np.packbits(2 * ones > n.sum()).tobytes().hex()

    for s in texts:
        yield s.map(one)


def as_long(hex16: Column) -> Column:
    return F.conv(hex16, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes of 16 hex digits."""
    return F.bit_count(as_long(a).bitwiseXOR(as_long(b)))
