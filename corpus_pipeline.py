"""A corpus pipeline over `documents`: language ID, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and reads all rows that its predecessor kept; all but the last return the columns of
docs. run() writes every stage's rows as Parquet in the shared folder and reads them again for the next, so that a lost executor
repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontam, neardup, langid, packing, pii
from tidelog.llm.common import remove, scratch, shared_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in one of the languages of docs; rejected texts (and null or letterless ones) go."""
    return langid.accepted(docs, langid.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near duplicates, texts at a five-word Jaccard similarity of 0.8 or more, the row with the smallest doc_id."""
    return neardup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of ten words (or a whole shorter item) of `benchmark`."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind in brackets; n_chars follows the text."""
    found = pii.masked(docs, pii.train(docs))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else found


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row in sequences of 1024 tokens; one result row per piece."""
    return packing.harmonic_pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: The stages learn and tokenize, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's own tables, and its input, are removed once its rows are written."""
    rows, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, name)
        with scratch(spark):
            kept = stage(spark, rows, sf_dir)
            kept.write.parquet(path)
        if before:
            remove(spark, before)
        rows, before = spark.read.schema(kept.schema).parquet(path), path
    return rows
