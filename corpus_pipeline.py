"""The corpus pipeline: five stages over ``documents``, each a table for the next.

Each stage is a function of ``(spark, docs, sf_dir)`` and works on all that the one before it kept.
All but the last return the columns of the documents; the last adds the token ids.

In every stage null and empty texts are texts without words: they are scored like others, never contaminated, share
one fingerprint (so one of them stays, that of the least id), hold no personal data and encode to no ids.
Repeated rows are judged alike; the near-duplicate stage keeps one of them. A null id is kept by the
near-duplicate stage only where its component has no other. Columns besides ``doc_id`` and ``text`` are
passed on whatever their names. An empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from ratertrail.llm import byte_bpe, decontaminate, pii, simhash, toxicity
from ratertrail.session import cut_lineage

#: Scores of a trained network and a tokenizer's merges have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network finds toxic go; it learns from the labelled documents that aren't held out."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints (shingles of three words, linked at two or fewer differing bits) stays, that of the least id."""
    return simhash.keep_first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in brackets."""
    return pii.mask(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and reread; the last one as it is."""
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
