"""The corpus pipeline: stages applied in turn to ``documents``.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``, and columns
of any other name pass through them unchanged. An empty table gives an empty table with the same columns.
What a stage does with null, empty and repeated rows is stated with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from cadenza.llm.session import cut, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null text is scored as empty. Repeated rows are scored alike and share their fate. Without a positive
    label that may be learned from, all stay; without an id a row is scored like any other.
    """
    return quality.reject_low_quality(docs, table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of alike lines one stays, the first by (doc_id, line number); documents left without any line go.

    Null and blank texts stay as they are, and so do blank lines. Rows of one id, or of none, are documents of
    their own if their texts differ and keep the same lines if they do not; rows without an id come after all
    others. ``n_chars`` follows the text.
    """
    return line_dedup.without_repeated_lines(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents the one of smallest id stays.

    Documents without words are in no group and stay. Of repeated rows of an id one stays. Rows without an id stay.
    """
    return jaccard_join.keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; lesser hits are taken out of the text.

    Null and blank texts are not contaminated. Repeated rows are treated alike. ``n_chars`` follows the text.
    An empty benchmark changes nothing.
    """
    return decontaminate.remove_hits(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of every document that is left, with its place in a sequence.

    Null text counts as empty: one piece, its end. Repeated rows are packed as rows of their own.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenising, learning and component search are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is materialised before the next stage reads it more than once."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
