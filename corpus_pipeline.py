"""A corpus from raw documents to packed batches, in five stages.

Toxic documents go, repeated lines are cut, one document of each near-duplicate group stays, documents that hold benchmark items go,
and what is left is packed into batches. Each stage reads what the one before it kept; all but the last return the columns of
``documents``. Learned parts (the toxicity lexicon) use the labels in ``sf_dir``, all of them.

Every stage takes null and empty texts, null identifiers, repeated rows, empty tables and columns of any names; the docstrings below say
what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalloom.llm import decontamination, line_dedup, packing, simhash, toxicity
from evalloom.llm.common import table
from evalloom.plans.staging import spread, staged


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.7. Null and empty texts have no hits and stay; equal texts stay or go together, repeated rows as often as they
    occur. Without labels of both classes a small seed lexicon decides."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def similar_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line (by doc_id, then place) resembles (Jaccard similarity of 0.8 or more). A null text stays null, a
    document without lines left has an empty text; rows that repeat an identifier and its text are one document and change alike."""
    return line_dedup.drop_similar_lines(docs, percent=80)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles have Jaccard similarity of 0.8 or more: that with the smallest doc_id (null comes
    last). Null and empty texts are one group; rows that repeat the kept identifier and text collapse to one."""
    return simhash.drop_near_duplicates(docs, width=5, similarity=0.8)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. Null and empty texts stay; repeated rows stay as often as they occur; without items all stay."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: its bucket, batch and slot. Null and empty texts have no tokens and are packed like others; ties go by doc_id
    (null first); repeated rows each have a place."""
    return packing.pack(docs, buckets=8, token_budget=16_384)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line dedup", similar_lines),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_filter),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next. An empty table gives an empty result."""
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
