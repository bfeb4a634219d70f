"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, secrets are redacted, sources
are mixed to their target weights, and what is left is packed into sequences.

Every stage is a function of (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from placeweave.llm import mixing, near_dedup, packing, secrets, toxicity
from placeweave.llm.common import read, settled, tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below their language's threshold."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of 0.8 or more."""
    return near_dedup.deduplicated(docs, 80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece, with its ids and its place."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier of the first stage is no SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all sequences that ``documents`` becomes, stage by stage.

    Each stage reads the table that the one before has written, and that stage's own intermediate tables are deleted as
    soon as its result stands. Null and empty texts pass as documents without words until the mix, which has no words to
    take from them; repeated rows are near-duplicates of each other, and all rows of the id that stays do; null ids are
    kept; further columns, whatever their names, travel along; an empty table gives an empty result.
    """
    docs, before = read(spark, sf_dir, "documents"), tables()
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name, before)
    return STAGES[-1][1](spark, docs, sf_dir)
