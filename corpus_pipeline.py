"""The corpus pipeline: quality, line dedup, near-duplicates, mixing, packing.

Each stage reads what the one before it wrote. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifflens.llm import line_dedup, mixing, near_documents, packing, quality, queries
from tarifflens.llm.common import alone, cleaned_up, delete, shared_folder, table

#: No SQL: near-duplicate groups, the classifier's training and the packing have no counterpart there; tests hold stages against brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts have a score like any other. Rows that repeat stay or go together; all columns pass
    through under any name; an empty table gives none.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go, of any number of words; every document stays.

    A null text stays null, and n_chars, where there is such a column, counts what is left (null for a null text). A
    line counts as first by doc_id, then by a hash of its text. All other columns pass through under
    any name; an empty table gives none.
    """
    found = alone(lambda: line_dedup.without_lines(docs, least=1))
    return found.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))) if "n_chars" in docs.columns else found


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the least doc_id, then the least text hash.

    Null and empty texts are one group. Rows that repeat id and text come out once; all columns pass through under any
    name; an empty table gives none.
    """
    return alone(lambda: near_documents.drop_similar(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document may stand there up to three times.

    Null and empty texts have no size and go. A null source is a source. Reruns agree, also on ties; all columns pass
    through under any name; an empty table gives none.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of sequences; a null or empty text is its end mark alone. Other columns are not read."""
    return packing.pack(docs, queries.vocabulary_path())


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; results between stages go to the shared folder, and each is deleted once the next is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        with cleaned_up(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            delete(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
