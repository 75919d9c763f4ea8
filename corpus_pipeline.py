"""A corpus pipeline over ``documents``: toxic documents go, then exact copies, then near copies, and what is left is packed
into training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but the last return rows of
``documents`` with all their columns; the last returns a row for each piece: ``doc_id, piece, start, length, sequence_id,
offset`` and the piece's ids. An empty table runs through to an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, near_dedup, packing, toxicity
from palimpsest.llm.common import settled, table, unused

#: A document is rejected from this score on.
TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of ``sf_dir``, scores below the limit."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    (score,) = unused(docs, "score")
    return toxicity.score(docs, model, out=score).where(F.col(score) < TOXIC_FROM).select(*[f"`{c}`" for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, the one with the smallest id."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are linked at a similarity of 0.8 or more."""
    return near_dedup.keep_one(docs, words=5, percent=80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("packing", pack_sequences)]

#: SQL can express neither the classifier nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        # a stage's own tables, and the rows it read, go once its result is written
        docs = settled(docs, lambda: stage(spark, docs, sf_dir), name)  # noqa: B023
    return STAGES[-1][1](spark, docs, sf_dir)
