"""One query per operator over its whole table, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from adjudica.llm import bpe, chat, language, lexical, merkle, minhash, packing, pii, quality, rules, sql, substring, suffix, syncmers
from adjudica.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


@query("op1_byte_level_bpe")
def byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))


@query("op2_substring_dedup", sql.SUBSTRING)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op3_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_syncmer_fingerprints")
def syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.digest(table(spark, sf_dir, "documents"))


@query("op5_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(table(spark, sf_dir, "documents"))


@query("op6_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


@query("op7_chat_formatting")
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digest(chat.windows(turns, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


@query("op8_minhash_near_dedup", sql.NEAR)
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.group(table(spark, sf_dir, "documents"))


@query("op9_packing")
def pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_quality_rules", sql.RULES)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


@query("op11_lexical_search", sql.SEARCH)
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_merkle_manifest", sql.MERKLE)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proven(table(spark, sf_dir, "documents"))


@query("op13_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.train(docs))
