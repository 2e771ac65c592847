"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

Every document of a source has the same expected number of copies e = target / size of the
source, so the prefix sum of expected copies up to the r-th document is r * e. With one offset u in
[0, 1) per source, a document is taken once for each integer crossed between (r - 1) * e + u and
r * e + u. Documents are ranked by size class, then by bucket, then by size, so that the words
taken follow the target closely and not only the number of documents.

A prefix sum over sources (targets) runs over one row per source. The rank needs no sort of a whole source: rows fall into cells (source, size class, bucket); a
cell's rows before it come from a prefix sum over cell counts, and a rank inside the cell from a
window over the cell. The number of buckets follows the number of rows, so cells stay small even
where one source or one size holds most rows. Cells and sources are counted first with map-side
aggregation, and only the counts meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, kept, marked, numbered, table, whole

#: Rows that a cell of a source with all rows in one size class would have, and the most buckets.
CELL_ROWS, MOST_BUCKETS = 2000, 65536
KEY = ["no_source", "src"]


def sizes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", row: str | None = None) -> DataFrame:
    """doc_id, row (its number), the source as a non-null key, size in words (0 for null)."""
    number = docs[row] if row else F.monotonically_increasing_id()
    return docs.select(docs[doc_id].alias("doc_id"), number.alias("row"), docs[source].isNull().alias("no_source"), F.coalesce(docs[source].cast("string"), F.lit("")).alias("src"), F.regexp_count(whole(docs[text]), F.lit(WORD)).cast("long").alias("size"))


def targets(rows: DataFrame, weights: Sequence[int], share: float, cap: int) -> DataFrame:
    """Per source: source_size, target, e (expected copies of each of its documents), u.

    Targets share `share` times all words by weight and stop at cap times the source; the excess is
    shared again among the rest until none is above. Sorted by cap / weight the stopped sources come
    first, so the level at which the sharing ends follows from prefix sums.
    """
    order, fill = Window.orderBy("no_source", "src"), Window.orderBy(F.col("most") / F.col("weight"), "no_source", "src")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("place") % len(weights) + 1).cast("long")
    s = rows.groupBy(*KEY).agg(F.sum("size").alias("source_size")).withColumn("place", (F.row_number().over(order) - 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    s = s.withColumn("level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    s = s.withColumn("stopped", F.col("most") <= F.col("level") * F.col("weight"))
    s = s.withColumn("end", F.max(F.when(~F.col("stopped"), F.col("level"))).over(everything))
    target = F.when(F.col("stopped"), F.col("most").cast("double")).otherwise(F.col("end") * F.col("weight"))
    s = s.withColumn("target", target)
    offset = F.conv(F.substring(F.md5(F.concat(F.when(F.col("no_source"), F.lit("n")).otherwise(F.lit("s")), F.col("src"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return s.select(*KEY, "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("e"), offset.alias("u"))


def mixture(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (words, repeats counted), copies.

    Sources by code point, null last, take the weights in turn. A source without words has target 0
    and its documents no copies; empty documents take 0 words. Ties in size go by doc_id, null
    first; repeated rows count as rows of their own. An empty table gives no rows.
    """
    return ranked(docs, text, doc_id, source, **how).drop("row")


def ranked(docs: DataFrame, text: str, doc_id: str, source: str, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: int = 2, row: str | None = None) -> DataFrame:
    """The mixture with the number of each row."""
    rows = kept(sizes(docs, text, doc_id, source, row), "sizes")
    buckets = max(1, min(MOST_BUCKETS, -(-rows.count() // CELL_ROWS)))
    bits = F.length(F.bin("size"))
    fine = F.when(F.col("size") < 8, F.col("size")).otherwise(bits * 8 + F.expr("shiftright(size, length(bin(size)) - 4) & 7"))
    bucket = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % buckets
    rows = rows.withColumns({"class": fine.cast("int"), "bucket": bucket.cast("int")})
    cell = [*KEY, "class", "bucket"]
    so_far = Window.partitionBy(*KEY).orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
    cells = cells.join(targets(rows, weights, share, cap), KEY).drop("n")
    placed = rows.join(cells, cell).withColumn("r", F.col("before") + F.row_number().over(Window.partitionBy(*cell).orderBy("size", "doc_id", "row")))
    crossed = F.floor(F.col("r") * F.col("e") + F.col("u")) - F.floor((F.col("r") - 1) * F.col("e") + F.col("u"))
    out = placed.withColumn("copies", F.least(crossed, F.lit(cap).cast("long")))
    return out.select("doc_id", "row", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", cap: int = 2, **how) -> DataFrame:
    """docs with each row as often as the mixture takes it; columns as they were. doc_id may be null or repeated."""
    rows, row = numbered(docs)
    copies = kept(ranked(rows, text, doc_id, source, cap=cap, row=row, **how).filter("copies > 0").select("row", "copies"), "copies")
    found, taken = marked(rows, row, copies, "row", *(F.col("copies") >= n for n in range(1, cap + 1)))
    copy = fresh("__copy", *found.columns)
    return found.withColumn(copy, F.explode(F.filter(F.array(*taken), lambda x: x))).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).drop("copies")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS src,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), n AS (
  SELECT greatest(1, least(65536, (count(*) + 1999) // 2000)) AS buckets FROM d
), c AS (
  SELECT *, CASE WHEN size < 8 THEN size ELSE length(bin(size)) * 8 + ((size >> (length(bin(size)) - 4)) & 7) END AS class,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % (SELECT buckets FROM n) AS bucket FROM d
), s0 AS (
  SELECT no_source, src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY no_source, src) - 1 AS place FROM d GROUP BY no_source, src
), s1 AS (
  SELECT *, [3, 1, 2][place % 3 + 1]::BIGINT AS weight, source_size * 2 AS most FROM s0
), s2 AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE - coalesce(sum(most) OVER b, 0)::BIGINT) / ((sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER b, 0)::BIGINT)::DOUBLE AS level
  FROM s1 WINDOW b AS (ORDER BY most / weight::DOUBLE, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (
  SELECT *, most <= level * weight AS stopped FROM s2
), s4 AS (
  SELECT *, CASE WHEN stopped THEN most::DOUBLE ELSE (max(CASE WHEN NOT stopped THEN level END) OVER ()) * weight END AS target FROM s3
), s AS (
  SELECT no_source, src, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
    ('0x' || substr(md5(CASE WHEN no_source THEN 'n' ELSE 's' END || src), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM s4
), r AS (
  SELECT c.*, row_number() OVER (PARTITION BY no_source, src ORDER BY class, bucket, size, doc_id NULLS FIRST) AS r FROM c
)
SELECT doc_id, size, source_size, target,
  (least(2, floor(r * e + u)::BIGINT - floor((r - 1) * e + u)::BIGINT) * size)::BIGINT AS taken
FROM r JOIN s USING (no_source, src)
"""
