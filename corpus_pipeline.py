"""The corpus pipeline: quality rules, near-dedup, decontamination, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes
what a stage returns as Parquet and gives the reread table to the next.  All but
the last return the columns of ``documents``.  The folder is the shared one of
``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platewise.llm import decontaminate, near_dedup, packing, pii, quality
from platewise.llm.common import materialize, release, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the likelihood ratio keep.

    Null and empty texts fail the rules and go; very long texts are judged in whole;
    repeated rows are judged one by one; a score equal to the threshold is kept; an
    empty table stays empty; all columns are kept, whatever their names.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the least id.

    Null and empty texts are linked with nothing and stay, as do rows with a null id;
    very long texts are compared in whole; of the rows of one id one stays (see
    ``near_dedup``); an empty table stays empty; all columns are kept.
    """
    return near_dedup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Null and empty texts hold none and stay; very long texts are searched in whole;
    all rows of an id go if one of them holds a passage, rows with a null id by their own
    texts; an empty table, or an empty benchmark, changes nothing; all columns are kept.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and ``n_chars`` renewed.

    Null texts stay null; very long texts are masked in whole; repeated rows stay;
    spans that overlap are masked as one; an empty table stays empty; all columns are kept.
    """
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences.

    A null or empty text is its end token alone; a text longer than a sequence is
    cut; repeated rows are packed one by one; an empty table gives no pieces; other
    columns are left out.
    """
    return packing.piece_digests(packing.pack_documents(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", packed),
]

#: The near-duplicate, decontamination and packing stages are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:  # what the stage before has written
            release(before)
    return docs
