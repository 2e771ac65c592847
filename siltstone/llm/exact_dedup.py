"""Exact deduplication with a heavy-hitter split; DataFrame functions only.

Texts are equal when identical after white space is deleted. One pass over the texts makes a
digest table. Misra-Gries sketches over it (Spark's approx_top_k, a frequent-items sketch of that
family whose state never exceeds `tracked` counters), merged shard by shard, name candidates
for frequent digests; an exact aggregation over the candidates verifies their size and winner. The
verified table has at most `heavy` rows by construction, so it is broadcast, and rows of frequent
digests are answered on the map side. The other digests go through an ordinary shuffle, where a
group has less than one in `heavy` of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, kept, marked, numbered, table, whole

#: Frequent digests broadcast at most, counters of a sketch, shards that sketches are merged in.
HEAVY, TRACKED, SHARDS = 2048, 8192, 64


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """doc_id, row (its number), text_sha256 of the text without white space, points (code points of the original)."""
    t = whole(docs[text])
    number = docs[row] if row else F.monotonically_increasing_id()
    return docs.select(docs[doc_id].alias("doc_id"), number.alias("row"), F.sha2(F.translate(t, SPACES, ""), 256).alias("text_sha256"), F.length(t).cast("long").alias("points"))


def frequent(rows: DataFrame, heavy: int, tracked: int) -> DataFrame:
    """The verified frequent digests: text_sha256, keep_id, keep_row, group_size; at most `heavy` rows.

    A sketch for each partition of the numbering is merged into one of SHARDS; what each of those
    names is added up. A digest with more than its share of all rows has it in some shard too.
    """
    shard = F.shiftright("row", 33) % SHARDS
    sketches = rows.groupBy(shard.alias("shard")).agg(F.expr(f"approx_top_k_accumulate(text_sha256, {int(tracked)})").alias("sketch"))
    each = sketches.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {int(heavy)})")).alias("top")).filter("top.count > 1")
    named = each.groupBy(F.col("top.item").alias("text_sha256")).agg(F.sum("top.count").alias("n")).orderBy(F.desc("n"), "text_sha256").limit(int(heavy)).select("text_sha256")
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("row").alias("r")))
    exact = rows.join(F.broadcast(named), "text_sha256").groupBy("text_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    return exact.filter("group_size > 1").select("text_sha256", F.col("best.i").alias("keep_id"), F.col("best.r").alias("keep_row"), "group_size")


def placed(docs: DataFrame, text: str, doc_id: str, heavy: int = HEAVY, tracked: int = TRACKED, row: str | None = None) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """doc_id, row, keep_id, keep_row (the row that stays), group_size, text_sha256 for every row of docs; and the kept tables it reads."""
    rows = kept(digests(docs, text, doc_id, row), "digests")
    top = kept(frequent(rows, heavy, tracked), "frequent")
    known = rows.join(F.broadcast(top), "text_sha256")
    group = Window.partitionBy("text_sha256")
    first = group.orderBy(F.desc("points"), F.asc_nulls_last("doc_id"), "row")
    rest = rows.join(F.broadcast(top.select("text_sha256")), "text_sha256", "left_anti").withColumns({
        "keep_id": F.first("doc_id").over(first), "keep_row": F.first("row").over(first), "group_size": F.count(F.lit(1)).over(group),
    })
    return known.unionByName(rest), (rows, top)


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points, then the smallest doc_id, stays; a null
    doc_id comes last. Null texts are empty texts and equal to texts of white space only. Repeated
    rows of one doc_id count in group_size and share the verdict. An empty table gives no rows;
    further columns are ignored.
    """
    all_rows, _ = placed(docs, text, doc_id, heavy, tracked)
    return all_rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with exactly one row of each set of equal texts, whatever their doc_id; columns as they were.

    Rows are told apart by a number of their own, so null and repeated doc_ids, of equal or unequal
    texts, neither lose a text nor keep it twice. An empty table gives no rows.
    """
    rows, row = numbered(docs)
    all_rows, parts = placed(rows, text, doc_id, row=row)
    gone = kept(all_rows.filter("row != keep_row").select("row"), "gone", parts)
    found, (goes,) = marked(rows, row, gone, "row", F.lit(True))
    return found.filter(~goes).select(*docs.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS points FROM documents
), k AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id ASC NULLS LAST) AS keep_id FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM k
"""
