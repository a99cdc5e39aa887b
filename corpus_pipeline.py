"""Corpus pipeline: documents become packed token sequences in five stages, each one operator of ``wxspark.llm``.

A stage takes (spark, docs, sf_dir) and works on all rows the stage before kept; its result is written as Parquet and read
again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wxspark.llm import mixing, packing, secret_ledger, simhash, toxicity
from wxspark.llm.common import sheltered, table
from wxspark.llm.queries import CAPACITY, END_ID, TOKENIZER
from wxspark.session import scratch, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; all others stay as they are."""
    labels = table(spark, sf_dir, "labels")
    return sheltered(docs, ("doc_id", "text"), lambda rows: toxicity.scored(rows, labels).where(F.col(toxicity.SCORE) < 0.5))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.one_per_component(docs, shingle=3, radius=3)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets found in a text are replaced by a mark; documents without any stay as they are."""
    found = secret_ledger.findings(secret_ledger.scan(docs, scratch(spark, "ledger")))

    def mask(rows: DataFrame) -> DataFrame:
        rows = secret_ledger.attach(rows, found, into="_secrets")
        # The masked text is a column of its own first: next to an alias "text", the lambdas would read the alias.
        rows = rows.withColumn("_masked", secret_ledger.masked("text", "_secrets"))
        if "n_chars" in rows.columns:
            size = F.when(F.size("_secrets") > 0, F.length("_masked")).otherwise(F.col("n_chars"))
            rows = rows.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
        return rows.withColumn("text", F.col("_masked"))

    return sheltered(docs, ("doc_id", "text", "n_chars"), mask)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated such that the words of each source meet its target."""
    return mixing.copied(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, repeated ones included, with their place in sequences of CAPACITY tokens."""
    made = packing.pieces(docs, TOKENIZER, CAPACITY, END_ID)
    items = made.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    placed = packing.pack(items, CAPACITY, ["doc_id", "piece", "start", "ids_crc32"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Boosted trees, XXH64 and a tokenizer are out of reach for SQL; tests/llm/test_pipeline.py checks stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
