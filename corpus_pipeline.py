"""The corpus pipeline: five stages from raw documents to encoded ones.

Each stage is (spark, docs, sf_dir) -> DataFrame. run() writes every stage's rows as Parquet in the
shared folder and hands the reread table to the next one, as whoever calls the stages must: a stage
begins by deleting what the one before it kept. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import kept, table
from siltstone.llm.exact_dedup import drop_exact
from siltstone.llm.mixing import mixed
from siltstone.llm.quality import keep_good
from siltstone.llm.sentence_pieces import encoded
from siltstone.llm.simhash import drop_similar
from siltstone.session import discard, leftovers


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of texts that are equal but for white space."""
    return drop_exact(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group similar at about 0.8 or more on five-word shingles."""
    return drop_similar(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: none, one or two rows each."""
    return mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids."""
    return encoded(docs)


_left: list[DataFrame] = []


def _stage(run: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """run, after deleting what the stage before kept: its rows are written by now, so nothing reads that any more."""

    @wraps(run)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(*(t for t in _left if t.sparkSession is spark))
        _left.clear()
        with leftovers() as made:
            out = run(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return stage


STAGES = [
    ("quality classifier", _stage(quality_classifier)),
    ("exact dedup", _stage(exact_dedup)),
    ("SimHash near-dedup", _stage(simhash_near_dedup)),
    ("mixing sources to target weights", _stage(mixing_sources)),
    ("SentencePiece encoding and decoding", _stage(sentencepiece)),
]

#: The classifier and SentencePiece are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), ()
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "_"), last)
        last = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
