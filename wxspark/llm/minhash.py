"""Document fingerprints by MinHash.

A text's shingles are hashed from its words in numpy; each of ``permutations`` universal hash functions a * x + b keeps its
minimum. The share of equal minima of two signatures estimates the Jaccard similarity of their shingles. ``near_duplicates`` joins bands
of signatures in Spark and verifies the meeting pairs by the Jaccard similarity of their shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wxspark.llm.common import connected, spaced, utf8
from wxspark.session import stored

PERMUTATIONS = 64
SHINGLE = 5
SIMILARITY = 0.8
#: Shingles that go through all permutations at once.
CHUNK = 4096


def coefficients(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(42))
    return r.integers(0, 2**63, permutations, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, permutations, np.uint64)


def shingles(text: str | None, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words in lower case, of all words if there are fewer; none without words."""
    from xxhash import xxh3_64_intdigest

    words = spaced(utf8(text)).split(b" ")
    if words == [b""]:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(length, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The signature of hashes ``x``; all ones if there is none. The upper half of each minimum is kept."""
    low = np.full(len(a), 2**64 - 1, np.uint64)
    for i in range(0, len(x), CHUNK):
        np.minimum(low, (x[i : i + CHUNK, None] * a + b).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(">u4")


def likeness(s: np.ndarray, t: np.ndarray) -> float:
    return float((s == t).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many code points of the beginning of ``following``, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def signatures(docs: DataFrame, permutations: int = PERMUTATIONS, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, signature) of every row; null texts are empty, signatures are big-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(permutations)
        for batch in batches:
            sigs = [minima(shingles(t.as_py(), shingle), a, b).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary())], ["doc_id", "signature"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, signature binary")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = 16, permutations: int = PERMUTATIONS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, class_id): rows of equal class are linked by pairs of at least ``similarity``; class_id is a small doc_id's.

    Texts of equal shingle sets form one node. Nodes that agree in a band meet there, and a search runs through each meeting
    place: one node at a time is compared with all nodes not yet reached, those it is close to are reached and take their turn
    later. No link is lost, and as near copies reach each other early, a place never lists all its pairs. doc_id is a long;
    null and empty texts form one class.
    """
    def one_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(permutations)
        for batch in batches:
            sets = [np.unique(shingles(t.as_py(), shingle)) for t in batch.column(1)]
            sigs = [minima(s, a, b).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "signature", "set"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = stored(rows.mapInArrow(one_set, "doc_id long, signature binary, set array<long>"), "shingle_sets")
    # Texts of equal shingle sets share a node, named by a hash of the set.
    keyed = stored(made.select("doc_id", F.xxhash64("set").alias("node"), "signature"), "nodes")
    nodes = stored(keyed.groupBy("node").agg(F.min("signature").alias("signature")), "node_signatures")
    sets = stored(made.groupBy(F.xxhash64("set").alias("node")).agg(F.min("set").alias("set")), "node_sets")
    width = 4 * permutations // bands
    values = [F.struct(F.lit(i).alias("band"), F.xxhash64(F.substring(F.col("signature"), 1 + i * width, width)).alias("value")) for i in range(bands)]
    here = stored(nodes.select("node", F.explode(F.array(*values)).alias("place"), F.lit(0).alias("reached")), "bands")
    found = None
    while True:
        turn = here.groupBy("place").agg(F.min_by("node", F.struct(-F.col("reached"), "node")).alias("head"), F.count("*").alias("n"), F.sum("reached").alias("r"))
        turn = turn.where("n > 1 and r < n").select("place", "head")
        rest = stored(here.join(turn, "place").where("node <> head"), "rest")
        asked = rest.where("reached = 0").select("node", "head").distinct()
        both = asked.join(sets, "node").join(sets.select(F.col("node").alias("head"), F.col("set").alias("head_set")), "head")
        common = F.size(F.array_intersect("set", "head_set"))
        close = common >= similarity * (F.size("set") + F.size("head_set") - common)
        linked = stored(both.where(close).select("node", "head"), "verified")
        if rest.isEmpty():
            break
        good = linked.select(F.col("node").alias("a"), F.col("head").alias("b"))
        found = good if found is None else found.union(good)
        marked = rest.join(linked.withColumn("close", F.lit(1)), ["node", "head"], "left")
        here = stored(marked.select("node", "place", F.greatest("reached", F.coalesce("close", F.lit(0))).alias("reached")), "bands")
    return _classes(keyed, None if found is None else connected(found))


def _classes(keyed: DataFrame, joined: DataFrame | None) -> DataFrame:
    rooted = keyed.select("node").distinct()
    rooted = rooted.withColumn("root", F.col("node")) if joined is None else rooted.join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "rooted")
    least = keyed.groupBy("node").agg(F.min("doc_id").alias("least")).join(rooted, "node").groupBy("root").agg(F.min("least").alias("class_id"))
    by_node = stored(rooted.join(least, "root").select(F.col("node").alias("_node"), "class_id"), "class_ids")
    return keyed.join(by_node, F.col("node") == F.col("_node")).select("doc_id", "class_id")


def report(documents: DataFrame, permutations: int = PERMUTATIONS, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness to each other and to the next document.

    Texts are range-partitioned by doc_id once; a task walks its documents in order and holds two at a time. Its last one
    waits for the first of the next partition that has any; after the very last comes the very first. Null ids come first,
    equal ids by text.
    """

    def digest(text: str, sig: np.ndarray, following: str, next_sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict:
        import hashlib

        changed = edited(text, following)
        changed_sig = minima(shingles(changed, shingle), a, b)
        return {
            "n_chars": len(text),
            "edited_sha256": hashlib.sha256(utf8(changed)).digest(),
            "fingerprint": sig.tobytes(),
            "edited_fingerprint": changed_sig.tobytes(),
            "near_edited": likeness(sig, changed_sig),
            "near_next": likeness(sig, next_sig),
        }

    out = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    names = [c.split()[0] for c in out.split(", ")]
    kinds = {"n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()} | dict.fromkeys(("edited_sha256", "fingerprint", "edited_fingerprint"), pa.binary())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, (a, b) = TaskContext.get().partitionId(), coefficients(permutations)

        def table(rows: list[dict]) -> pa.RecordBatch:
            cols = {"kind": pa.string(), "part": pa.int32(), "doc_id": pa.int64(), **{n: kinds.get(n, pa.string()) for n in names}, "text": pa.string()}
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in cols.items()], list(cols))

        last = None
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sig = minima(shingles(text, shingle), a, b)
                if last is None:
                    rows.append({"kind": "head", "part": part, "doc_id": doc_id, "text": text})
                else:
                    rows.append({"kind": "row", "part": part, "doc_id": last[0], **digest(last[1], last[2], text, sig, a, b)})
                last = (doc_id, text, sig)
            if rows:
                yield table(rows)
        if last is not None:
            yield table([{"kind": "tail", "part": part, "doc_id": last[0], "text": last[1]}])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(permutations)
        for batch in batches:
            rows = [digest(t, minima(shingles(t, shingle), a, b), f, minima(shingles(f, shingle), a, b), a, b) for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names]], ["doc_id", *names])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    walked = stored(dealt.mapInArrow(walk, f"kind string, part int, doc_id long, {out}, text string"), "walked")
    # One head and one tail per partition; only partition numbers are ordered in one place.
    parts = sorted(r[0] for r in walked.where("kind = 'head'").select("part").collect())
    follows = [(p, parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)]
    spark = documents.sparkSession
    order = spark.createDataFrame(follows, "part int, head int")
    tails = walked.where("kind = 'tail'").select("part", "doc_id", "text").join(order, "part")
    heads = walked.where("kind = 'head'").select(F.col("part").alias("head"), F.col("text").alias("following"))
    ends = tails.join(heads, "head").select("doc_id", "text", "following").mapInArrow(close, f"doc_id long, {out}")
    # Hashes lie as bytes in the table between the passes, half as large as their digits.
    shown = [F.lower(F.hex(n)).alias(n) if pa.types.is_binary(kinds.get(n, pa.string())) else F.col(n) for n in names]
    return walked.where("kind = 'row'").select("doc_id", *names).union(ends).select("doc_id", *shown)
