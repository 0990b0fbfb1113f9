"""A training corpus from ``documents``: quality, near-duplicates, secrets, source mix, packed sequences.

Every stage takes (spark, docs, sf_dir) and all that the stage before kept;
all but the last return the columns of ``documents``. Columns beyond those are
dropped; an empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm import mixing, neardup, packing, quality, secrets
from quorumlake.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    A null or empty text is scored as it is; without labelled rows of both kinds all documents stay; equal rows stay or go together.
    """
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter("predicted = 1").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group.

    Rows with a null text all stay; rows that repeat doc_id and text count once; of a group without doc_ids one row stays.
    """
    return neardup.representatives(docs.select(*COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of each secret in its place.

    A null text stays null; equal rows stay equal; n_chars is that of the new text.
    """
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them whole, and the runs of words that its blocks hold beyond that.

    Documents without words, null texts among them, have nothing to take and go; a null source is one of its own; equal rows are separate documents.
    """
    return mixing.mixed_documents(docs.select(*COLUMNS))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a training sequence.

    A document without words has a row without a bin; very long ones are cut into pieces; equal rows are told apart by ``copy``.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", one_of_each_group),
    ("secrets", without_secrets),
    ("source mix", mixed_sources),
    ("packing", packed_sequences),
]

#: The classifier and the alignment can't be put in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, written(docs) if k else docs, sf_dir)
    return docs
