"""What the corpus operators share: reading tables, the word rule, row numbers, ranges of rows."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, kept, shared_folder, ship

__all__ = ["LOWER", "SPACES", "UPPER", "WORD", "discard", "fresh", "kept", "marked", "numbered", "ranges", "release", "shared_folder", "ship", "table", "task", "whole"]

#: White space is space and U+0009 to U+000D; words are what lies between.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of bitmaps that are broadcast.
MOST_BITS = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The whole text as a string; null counts as empty."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))


@functools.lru_cache(1)
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Give memory that is not in use back to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, which gives the memory of its batches back to the system when it ends: workers live on for other tasks."""

    @functools.wraps(run)
    def whole_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole_task


def fresh(name: str, *taken: str) -> str:
    """name, with underscores added until no column is called so."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a column that numbers its rows, written so that it stays the same, and that column's name; doc_id may be null or repeated."""
    name = fresh("__row", *df.columns)
    return kept(df.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def marked(rows: DataFrame, row: str, numbers: DataFrame, number: str, *conditions: Column) -> tuple[DataFrame, list[Column]]:
    """rows beside bitmaps of the numbers, one for each condition, and the columns that tell whether the bit of a row is set.

    Rows meet bitmaps of 32768 numbers each, an eighth of a byte for a row. Up to MOST_BITS bytes of
    them are broadcast, so rows are answered where they are and what they hold is not shuffled; more
    are joined by the bucket.
    """
    bucket, names = fresh("__bucket", *rows.columns), [fresh(f"__bits{i}", *rows.columns) for i in range(len(conditions))]
    bits = numbers.groupBy(F.bitmap_bucket_number(number).alias(bucket)).agg(*(F.bitmap_construct_agg(F.when(c, F.bitmap_bit_position(number))).alias(n) for c, n in zip(conditions, names, strict=True)))
    bits = kept(bits, "bits")
    if bits.count() * 4096 * len(names) <= MOST_BITS:
        bits = F.broadcast(bits)
    at = F.bitmap_bit_position(F.col(row))

    def is_set(name: str) -> Column:
        octet = F.conv(F.hex(F.substr(F.col(name), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.floor(octet / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1, F.lit(False))

    found = rows.withColumn(bucket, F.bitmap_bucket_number(F.col(row))).join(bits, bucket, "left")
    return found, [is_set(n) for n in names]


def ranges(sizes: list[int], most: int) -> Iterator[slice]:
    """Ranges of rows of about `most` in all; a larger row is a range of its own."""
    a = total = 0
    for i, s in enumerate(sizes):
        if total and total + s > most:
            yield slice(a, i)
            a, total = i, 0
        total += s
    if sizes:
        yield slice(a, len(sizes))
