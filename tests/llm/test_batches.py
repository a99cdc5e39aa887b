"""Packing gives Python small batches of text, so that a worker never holds a whole input split, and leaves the session as it was."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wxspark.llm import packing

KEYS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


def _sized(docs):
    """An item of length 1 per row, with the rows and bytes of the batch it came in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([1] * n, pa.int64()), pa.array([n] * n, pa.int64()), pa.array([b.nbytes] * n, pa.int64())], ["doc_id", "length", "rows", "bytes"])

    return docs.mapInArrow(run, "doc_id long, length long, rows long, bytes long")


@pytest.mark.parametrize("n, width", [(3500, 10), (80, 100_000), (3, 5_000_000)])
def test_items_come_in_small_batches(spark, n, width):
    before = [spark.conf.get(k, None) for k in KEYS]
    docs = spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), width).alias("text"))
    placed = packing.pack(_sized(docs), 8, ["doc_id"]).select("doc_id", "sequence_id", "offset", "rows", "bytes").collect()
    assert sorted(r["doc_id"] for r in placed) == list(range(n))
    assert len({(r["sequence_id"], r["offset"]) for r in placed}) == n
    assert max(r["rows"] for r in placed) <= packing.BATCH_ROWS
    assert max(r["bytes"] for r in placed) <= packing.BATCH_BYTES + 2 * width + 20_000
    assert [spark.conf.get(k, None) for k in KEYS] == before


def test_limits_of_the_caller_stay(spark):
    spark.conf.set(KEYS[0], "300")
    try:
        placed = packing.pack(_sized(spark.range(0, 1000, 1, 1).withColumnRenamed("id", "doc_id")), 8, ["doc_id"])
        assert spark.conf.get(KEYS[0]) == "300"
        assert {r["rows"] for r in placed.select("rows").collect()} == {300, 100}
    finally:
        spark.conf.unset(KEYS[0])


def test_limits_go_when_items_fail(spark):
    before = [spark.conf.get(k, None) for k in KEYS]
    with pytest.raises(Exception, match="too odd"):
        packing.pack(spark.range(3).select(F.raise_error(F.lit("too odd")).cast("long").alias("length")), 8, ["length"])
    assert [spark.conf.get(k, None) for k in KEYS] == before
