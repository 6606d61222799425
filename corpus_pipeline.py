"""A corpus through five stages: quality rules, language ID, near-duplicate removal, repeated strings, packing.

Null and empty texts fail the quality rules.  Null and repeated ids stay, with their own texts: near-duplicate removal keeps one row of each
class of texts, that of smallest id (null last).  Columns beyond those of documents pass through unread, whatever their names, up
to packing.  An empty table gives an empty one at every stage, and texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quorum.llm import langid, order_minhash, packing, quality, suffix_dedup
from quorum.llm.common import docs_of, plainly, stored

LEAST_SCORE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the calibrated model."""
    model = quality.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return plainly(lambda d: quality.judged(d, model, keep=tuple(d.columns)).where("kept"), docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with a probability of at least LEAST_SCORE."""
    model = langid.fit(docs)
    return plainly(lambda d: langid.identified(d, model, keep=tuple(d.columns)).where(f"lang_pred <> '{langid.UND}' AND score >= {LEAST_SCORE}"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return order_minhash.one_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that a document of smaller id has."""
    return plainly(suffix_dedup.cleaned, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return packing.pack(stored(packing.pieces(docs)))


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("MinHash near-dedup", near_dedup), ("suffix-array dedup", repeated_strings), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and read again as the next one's docs."""
    docs = docs_of(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
