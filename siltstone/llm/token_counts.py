"""Exact token counts from a length histogram.

Every whole text is encoded once; documents are then counted by encoded length with map-side
aggregation, so what is shuffled is one row per distinct length and task. Suffix sums over the
histogram answer totals, quantiles and truncated totals for every context limit exactly.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, ship, table, task, whole

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level BPE of VOCABULARY splits texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct lengths that one window looks at, and limits or quantiles answered in one pass.
BLOCK, ASKED = 64, 100


@lru_cache(2)
def encoding(ranks: bytes, pattern: str):
    import tiktoken

    pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=pairs, special_tokens={})


def lengths(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """n_tokens of every row's whole text; null and empty texts have 0. The vocabulary file is read on the driver and broadcast (under 2 MB)."""
    ship(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(ranks.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe.encode_ordinary(t.as_py())) for t in batch.column(0)], pa.int64())], ["n_tokens"])

    return docs.select(whole(docs[text]).alias("text")).mapInArrow(run, "n_tokens long")


def histogram(counts: DataFrame, length: str = "n_tokens") -> DataFrame:
    """n_tokens, docs: how many documents have each length."""
    return counts.groupBy(F.col(length).alias("n_tokens")).agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length L that occurs: docs, tokens, docs_from and tokens_from (of documents of L or more), truncated (all tokens when every document is cut at L), quantile (share of documents of L or fewer).

    Sums run within blocks of lengths and then over the blocks, so no task sees all lengths. No rows in, no rows out.
    """
    h = hist.withColumns({"tokens": F.col("n_tokens") * F.col("docs"), "block": F.floor(F.col("n_tokens") / BLOCK)})
    blocks = h.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    after, everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t"), F.sum("d").over(everything).alias("all_docs"), F.sum("t").over(everything).alias("all_tokens"))
    from_here = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    s = h.join(blocks, "block").withColumns({"docs_from": F.sum("docs").over(from_here) + F.col("d"), "tokens_from": F.sum("tokens").over(from_here) + F.col("t")})
    return s.select("n_tokens", "docs", "tokens", "docs_from", "tokens_from", (F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated"), ((F.col("all_docs") - F.col("docs_from") + F.col("docs")) / F.col("all_docs")).alias("quantile"))


def _answers(sums: DataFrame, asked: list, answer: Callable[[float], Column], row: Callable[[float, Column], Column]) -> DataFrame:
    """One row for each of asked, in one pass over the histogram for every ASKED of them: each is an aggregate, so nothing is joined."""
    out = None
    for at in range(0, len(asked), ASKED):
        part = asked[at : at + ASKED]
        found = sums.agg(F.sum("tokens").alias("all_tokens"), *(answer(x).alias(f"s{i}") for i, x in enumerate(part)))
        rows = found.select(F.explode(F.array(*(row(x, F.col(f"s{i}")) for i, x in enumerate(part)))).alias("r")).select("r.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def at_limits(sums: DataFrame, limits: Iterable[int]) -> DataFrame:
    """limit, truncated: all tokens when every document is cut at the limit, for any limits, from the suffix sums. Without documents 0."""
    asked = sorted({int(x) for x in limits})
    if not asked:
        return sums.sparkSession.createDataFrame([], "limit long, truncated long")

    def row(limit: int, s: Column) -> Column:
        cut = F.col("all_tokens") - F.coalesce(s["tokens_from"], F.lit(0)) + F.lit(limit) * F.coalesce(s["docs_from"], F.lit(0))
        return F.struct(F.lit(limit).cast("long").alias("limit"), F.coalesce(cut, F.lit(0)).cast("long").alias("truncated"))

    return _answers(sums, asked, lambda x: F.min(F.when(F.col("n_tokens") >= x, F.struct("n_tokens", "docs_from", "tokens_from"))), row)


def at_quantiles(sums: DataFrame, quantiles: Iterable[float]) -> DataFrame:
    """q, n_tokens: the least length that at least a share q of the documents do not exceed; no rows without documents."""
    asked = sorted({float(q) for q in quantiles})
    if not asked:
        return sums.sparkSession.createDataFrame([], "q double, n_tokens long")
    found = _answers(sums, asked, lambda q: F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))), lambda q, s: F.struct(F.lit(q).alias("q"), s.alias("n_tokens")))
    return found.filter("n_tokens IS NOT NULL")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(kept(histogram(lengths(table(spark, sf_dir, "documents"))), "histogram"))
