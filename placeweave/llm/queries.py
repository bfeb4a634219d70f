"""The corpus operators' registered queries, each over its whole table, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.llm import alignment, conversations, language_model, media, mixing, near_dedup, neighbours, packing, repeats, secrets, sharding, token_counts, toxicity
from placeweave.llm.common import read, saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        return f

    return put


@query("op2_media_signatures")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_as_media(read(spark, sf_dir, "documents"))


@query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return secrets.scan_secrets(docs, with_redacted=False).drop("text")


@query("op4_source_mix")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "source")
    keyed = saved(mixing.with_keys(docs).drop("text"), "keyed")
    return mixing.mix(keyed).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL["op4_source_mix"] = mixing.ORACLE


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), special=True)


@query("op8_byte_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "lang")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "threshold", "rejected")


@query("op7_learned_partitions")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op10_near_duplicates")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), 85)


@query("op9_repeated_passages")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup_substrings(read(spark, sf_dir, "documents"))


@query("op5_edit_aware_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    trees = saved(token_counts.build_trees(docs, path), "trees")
    edited = trees.withColumn("edits", token_counts.sample_edits(F.col("doc_id"), F.col("text")))
    return token_counts.apply_edits(edited, path).select("doc_id", "n_tokens", "n_edits", "n_tokens_edited", "edited_crc32", "recoded_chars")


@query("op11_language_model")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    scored = language_model.score(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(read(spark, sf_dir, "conversations")))


@query("op13_tokenizer_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return alignment.align(read(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


ORACLE_SQL["op9_repeated_passages"] = repeats.ORACLE
ORACLE_SQL["op10_near_duplicates"] = near_dedup.ORACLE
