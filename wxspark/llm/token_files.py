"""Token-id files in a Simple-8b layout, written and read in bulk.

Ids are packed into 64-bit words: four selector bits say how many ids share the other sixty bits and how wide each is. The
last selector is the escape: one id of up to sixty bits. Ids are coded in blocks of 128, so words of all blocks of a
file are found at the same time, and a table of block offsets lets a reader decode all words of one selector with one
array operation.

File: magic, block size, counts of documents, ids, words and blocks (eight-byte integers); document ids, a null
flag per document, ids per document, first word of each block, words. Files lie in ``files`` in ascending document order
(``part-PPPPP-NNNNN.s8b``), the Parquet table ``manifest``, written last, beside it. Names and contents follow
from the input alone and files appear under their name only when whole, so a repeated task writes the same file again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wxspark.llm.tokens import encoded, id_rows

MAGIC = b"WXS8B002"
BLOCK = 128
#: Ids per word by selector; the width of each is sixty divided by it. The last one is the escape.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
#: Bits of all numbers of up to sixteen bits.
WIDTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
#: Blocks packed at once; what they need besides fits into a processor's cache.
PACKED_BLOCKS = 2048
#: Ids after which a task starts its next file.
FILE_IDS = 4_000_000
#: Bytes of text encoded at once, and parts of text a worker remembers.
SLICE_BYTES, REMEMBERED = 8 << 20, 500_000


def bit_widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, 0 for 0."""
    if ids.max(initial=0) < len(WIDTHS):
        return WIDTHS[ids]
    out, left = np.zeros(ids.shape, np.uint8), ids.astype(np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        high = left >> np.uint64(step)
        more = high > 0
        out[more] += step
        left = np.where(more, high, left)
    return out + (left > 0).astype(np.uint8)


def window_maxima(width: np.ndarray) -> dict[int, np.ndarray]:
    """For each count the widest of as many ids from each place of a block on; ``width`` has COUNTS[0] zeros after each block.

    Windows of a power of two come from two of half their length, all others from two overlapping ones.
    """
    size, out, made = 1, {}, width
    for count in sorted(COUNTS):
        while 2 * size <= count:
            made = np.maximum(made[:, :-size], made[:, size:])
            size *= 2
        at = count - size
        out[count] = np.maximum(made[:, :BLOCK], made[:, at : at + BLOCK]) if at else made[:, :BLOCK]
    return out


def pack_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all ids and the first word of each block, with the number of words at the end."""
    parts = [_pack_blocks(ids[i : i + PACKED_BLOCKS * BLOCK]) for i in range(0, len(ids), PACKED_BLOCKS * BLOCK)]
    sizes = np.concatenate([np.zeros(1, np.int64), *[p[1] for p in parts]])
    return np.concatenate([np.empty(0, "<u8"), *[p[0] for p in parts]]).astype("<u8", copy=False), np.cumsum(sizes).astype("<u8")


def _pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of some blocks and the number of words of each block."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    width = np.zeros((blocks, BLOCK + COUNTS[0]), np.uint8)
    padded = np.zeros(blocks * BLOCK, np.uint8)
    padded[:n] = bit_widths(ids)
    width[:, :BLOCK] = padded.reshape(blocks, BLOCK)
    # take[b, p]: how many ids the word that starts at p holds; words of fewer ids are tried first and overwritten.
    take = np.ones((blocks, BLOCK), np.uint8)
    for count, widest in window_maxima(width).items():
        np.copyto(take, count, where=widest <= 60 // count)
    take = take.reshape(-1)
    size = np.full(blocks, BLOCK)
    size[-1] = n - (blocks - 1) * BLOCK
    at = np.arange(blocks) * BLOCK
    end, alive, found = at + size, np.arange(blocks), []
    while len(alive):
        k = take[at]
        found.append((alive, at, k))
        at = at + k
        more = at < end[alive]
        alive, at = alive[more], at[more]
    # The n-th word of a block was found in the n-th step.
    per_block = np.zeros(blocks, np.int64)
    for some, _, _ in found:
        per_block[some] += 1
    start = np.cumsum(per_block) - per_block
    pos, held = np.empty(per_block.sum(), np.int64), np.empty(per_block.sum(), np.uint8)
    for step, (some, places, k) in enumerate(found):
        pos[start[some] + step], held[start[some] + step] = places, k
    room = np.repeat(end, per_block) - pos
    wide = np.zeros(blocks * BLOCK + COUNTS[0], np.uint64)
    wide[:n] = ids
    words = np.zeros(len(pos), np.uint64)
    for selector, count in enumerate(COUNTS):
        # The last word of a block may hold fewer ids; past the block's end stand those of the next one.
        for rows, filled in _by_room(held == count, room, count):
            word = np.full(len(rows), selector << 60, np.uint64)
            for j in range(filled):
                word |= wide[pos[rows] + j] << np.uint64(j * (60 // count))
            words[rows] = word
    return words, per_block


def _by_room(chosen: np.ndarray, room: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, int]]:
    """The chosen words with the number of ids each really holds: ``count`` for nearly all of them."""
    rows = np.flatnonzero(chosen)
    filled = np.minimum(room[rows], count)
    for k in [count] if (filled == count).all() else np.unique(filled).tolist():
        yield rows[filled == k], k


def unpack_words(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids in ``words``."""
    out, starts = np.empty(n, np.uint64), starts.astype(np.int64)
    for b in range(0, len(starts) - 1, PACKED_BLOCKS):
        some = starts[b : b + PACKED_BLOCKS + 1]
        _unpack_blocks(words[some[0] : some[-1]], some - some[0], out[b * BLOCK : (b + PACKED_BLOCKS) * BLOCK])
    return out


def _unpack_blocks(words: np.ndarray, starts: np.ndarray, out: np.ndarray) -> None:
    """The ids of some blocks into ``out``."""
    selector = (words >> np.uint64(60)).astype(np.uint8)
    k = np.array(COUNTS, np.int64)[selector]
    total = np.concatenate([[0], np.cumsum(k)])
    # Where each word's ids go: from its block's first id on. The last word of a block may hold padding.
    block = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    to = block * BLOCK + total[:-1] - total[starts[:-1]][block]
    room = np.minimum((block + 1) * BLOCK, len(out)) - to
    for s, count in enumerate(COUNTS):
        mask = np.uint64((1 << (60 // count)) - 1)
        for rows, filled in _by_room(selector == s, room, count):
            word, first = words[rows], to[rows]
            for j in range(filled):
                out[first + j] = word >> np.uint64(j * (60 // count)) & mask


def to_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, starts = pack_words(ids)
    head = np.array([BLOCK, len(doc_ids), len(ids), len(words), len(starts) - 1], "<i8")
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], "u1")
    return b"".join([MAGIC, head.tobytes(), known.tobytes(), null.tobytes(), lengths.astype("<i8").tobytes(), starts.tobytes(), words.tobytes()])


def from_bytes(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, ids per document, all ids) of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    block, docs, n, words, blocks = np.frombuffer(data, "<i8", 5, 8).tolist()
    if block != BLOCK:
        raise ValueError(f"unknown block size {block}")
    at = 48
    known = np.frombuffer(data, "<i8", docs, at).tolist()
    null = np.frombuffer(data, "u1", docs, at + 8 * docs)
    lengths = np.frombuffer(data, "<i8", docs, at + 9 * docs)
    starts = np.frombuffer(data, "<u8", blocks + 1, at + 17 * docs)
    body = np.frombuffer(data, "<u8", words, at + 17 * docs + 8 * (blocks + 1))
    return [None if z else d for d, z in zip(known, null.tolist())], lengths, unpack_words(body, starts, n)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``docs`` and write them into ``folder``, a shared place that Python and Spark both reach; the manifest.

    Documents go in ascending id order, null ids first, equal ids by a hash of the text and the text; a null text is empty and holds the end id
    alone; other columns are not read. An empty table makes a manifest without rows and no file. Manifest: part, seq, file,
    n_docs, n_ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(f"{folder}/files" if ":/" in folder else os.path.abspath(f"{folder}/files"))
        store.create_dir(base, recursive=True)
        seq, held, owners, size = 0, [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([h[0] for h in held])
            name = f"part-{part:05d}-{seq:05d}.s8b"
            made = f"{base}/_{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(made) as out:
                out.write(to_bytes(owners, np.concatenate([h[1] for h in held]), ids))
            store.move(made, f"{base}/{name}")
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([name]), pa.array([len(owners)], pa.int64()), pa.array([len(ids)], pa.int64())],
                ["part", "seq", "file", "n_docs", "n_ids"],
            )

        for batch in batches:
            names = batch.column(0)
            for row, ids, n in encoded(batch.column(1), tokenizer, end_id, SLICE_BYTES, REMEMBERED):
                held.append((ids, n))
                owners += names.slice(row, len(n)).to_pylist()
                size += len(ids)
                if size >= FILE_IDS:
                    yield flush()
                    seq, held, owners, size = seq + 1, [], [], 0
        if owners:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # The hash spreads rows that share an id, or have none, over tasks.
    rows = rows.withColumn("hash", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")
    made = dealt.mapInArrow(run, "part int, seq int, file string, n_docs long, n_ids long")
    made.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(made.schema).parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in a folder of token files, in no particular row order.

    ``start`` counts the ids of all documents before. Files that the manifest does not name are not read.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    per_part = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of the writer
    parts = per_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.join(parts, "part").select("file", (F.col("part_start") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("file_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                doc_ids, n, ids = from_bytes(content.as_buffer())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()] * len(n)), pa.array(doc_ids, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), id_rows(ids.astype("<u4"), n)],
                    ["file", "doc_id", "at", "n_tokens", "ids"],
                )

    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.s8b").load(f"{folder}/files")
    named = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    docs = named.mapInArrow(run, "file string, doc_id long, at long, n_tokens long, ids binary")
    return docs.join(files, "file").select("doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids")
