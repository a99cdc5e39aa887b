"""One query per operator over its whole table, and the SQL it is checked against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wxspark.llm import chat, hard_negatives, licenses, merkle, minhash, mixing, packing, quality_rules, secret_ledger, simhash, token_files, topk, toxicity
from wxspark.llm.common import table
from wxspark.llm.oracles import ORACLES  # noqa: F401
from wxspark.session import scratch

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY = 1024
END_ID = 2


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.pieces(table(spark, sf_dir, "documents"), TOKENIZER, CAPACITY, END_ID)
    items = made.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    placed = packing.pack(items, CAPACITY, ["doc_id", "piece", "start", "ids_crc32"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(table(spark, sf_dir, "conversations"))


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.report(table(spark, sf_dir, "documents"), scratch(spark, "ledger"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.components(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return out.select("doc_id", simhash.hexadecimal("fingerprint").alias("fingerprint"), "component_id")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantised(table(spark, sf_dir, "embeddings"), 64), "vec_id % 20 = 0", 20)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(table(spark, sf_dir, "documents"))


def op8_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), folder, TOKENIZER, END_ID)
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.report(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        op1_best_fit_packing, op2_chat_tool_calls, op3_secret_ledger, op4_toxicity, op5_simhash, op6_exact_topk,
        op7_minhash, op8_entropy_mixing, op9_licenses, op10_token_files, op11_quality_rules,
        op12_hard_negatives, op13_merkle_manifest, pipeline,
    )
}

#: Also see corpus_pipeline.ORACLE_SQL. Other queries are tested against brute force in tests/llm.
