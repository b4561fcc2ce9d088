"""From raw documents to packed training sequences, stage by stage.

Each stage reads what its predecessor kept, whole, and all but the last return the
columns of the documents as they came, whatever their names.

Defined results, by the operators' own rules: a null or blank text is rejected
with the rule ``empty``, so later stages see texts only; a null source counts as
``''``; a null id is kept until it repeats an exact text, is not compared for near
copies, and is drawn and packed as the id null; rows that repeat an id and a text
become one, rows that repeat an id with other texts are one document to the near
duplicates and to the mixture; texts are read whole, and one too long for a
sequence is packed in parts; ties go to the smaller id; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeloom.llm import exact_dedup, mixing, packing, quality_rules, simhash
from treeloom.plans.staging import materialize, release, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places in bins: one row for each part of each document."""
    limits = packing.DOCUMENT_LIMITS
    return packing.pack(packing.document_examples(docs, limits), limits).withColumnRenamed("id", "doc_id")


STAGES = [("quality rules", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("mixing", mix), ("packing", pack)]

#: SimHash groups and packing have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences; what a stage staged goes when its result is written, and that when the next one is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with staged() as own:
            made = stage(spark, docs, sf_dir)
        docs = materialize(made, name.replace(" ", "-"))
        for table in [*own, *([before] if before is not None else [])]:
            release(table)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
