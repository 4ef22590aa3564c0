"""A training-data pipeline over ``documents``: five stages, each a DataFrame in and a DataFrame out.

Each stage's result is written as Parquet in the shared folder and read again by the next. All stages
but the last keep the columns of ``documents``, further ones included, whatever their names.

Null and empty texts, and texts without a letter, are no language and go in the first stage. A null id
is an id like others; rows are known by id and text, so of repeated rows one stays. Empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import materialize, table
from docloom.llm.decontaminate import drop_contaminated
from docloom.llm.jaccard_join import keep_one
from docloom.llm.language import reject_unidentified
from docloom.llm.packing import pack_documents
from docloom.llm.secrets import redact_secrets


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language; texts without a letter, and those without a clear winner, go."""
    return reject_unidentified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the least id and, of equal ids, the least text hash."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and the bins they go to."""
    return pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: Language models are no SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
