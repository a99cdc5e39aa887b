"""SimHash near duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits meet half-way: some word is within r/2 bits of both. So every
fingerprint emits all its variants within half the radius, equal variants are shuffled together, and pairs that meet are
verified by their bit distance. For an odd r half a bit is over. It is dealt with by leaving out one band of bits at a
time: of three differing bits at least one lies in some band, and with that band left out two remain, one for
either side. A fingerprint then emits, for each band, the words within floor(r/2) bits of its other bits. Fewer bands emit
fewer variants, more bands make chance meetings rarer: with n fingerprints and b bands about
n * b * C(64 - 64/b, r) / 2**(64 - 64/b) of them meet each one by chance.

Equal fingerprints are combined before variants are made, so copies cost nothing. Members of one meeting group are not all
paired: a search from member to member emits one link per newly reached one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wxspark.llm.common import connected, sheltered, spaced, utf8
from wxspark.session import compact, stored

SEED = 42


def shingle_hashes(words: bytes, length: int) -> np.ndarray:
    """XXH64 of every run of ``length`` words of a space-joined text, repeats included; of all words if there are fewer."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.empty(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    if len(gaps) < length - 1:
        return np.array([xxh64_intdigest(words, SEED)], np.uint64)
    starts = [0, *(gaps[: len(gaps) - length + 1] + 1).tolist()]
    ends = [*gaps[length - 1 :].tolist(), len(words)]
    return np.array([xxh64_intdigest(words[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)


def fingerprint(text: str | None, length: int) -> int:
    """A bit is 1 if it is set in over half the shingle hashes; 0 for a text without words. As a signed number."""
    h = shingle_hashes(spaced(utf8(text)), length)
    if not len(h):
        return 0
    bits = np.unpackbits(np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(h)
    return int(np.packbits(ones, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, content, fingerprint) of every row; the fingerprint is a signed 64-bit number, content a hash of the text.

    Null and empty texts have fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], ["doc_id", "content", "fingerprint"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), content(text).alias("content"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, content long, fingerprint long")


def content(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def variants(fp: Column, radius: int, bands: int) -> Column:
    """All meeting places of a fingerprint. Bands of an even radius are not needed, one empty band then does."""
    if radius // 2 > 1:
        raise ValueError("radius up to 3")
    places = []
    widths = [64 // bands + (i < 64 % bands) for i in range(bands)] if radius % 2 else [0]
    if radius % 2 and (bands > 16 or min(widths) < 4):
        raise ValueError("2 to 16 bands")
    at = 0
    for i, w in enumerate(widths):
        # Turn the band to the top, replace it by its number, flip at most radius // 2 of the other bits.
        turned = fp if at == 0 else F.shiftleft(fp, 64 - at).bitwiseOR(F.shiftrightunsigned(fp, at))
        rest = turned.bitwiseAND(F.lit((1 << (64 - w)) - 1 if w else -1)).bitwiseOR(F.lit((i << 60) - (1 << 64 if i >= 8 else 0)))
        places.append(rest)
        if radius // 2:
            places += [rest.bitwiseXOR(F.lit((1 << j) - (1 << 64 if j == 63 else 0))) for j in range(64 - w)]
        at += w
    return F.array(*places)


def chained(members: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links among the distinct fingerprints of one meeting group: as many as are needed to reach all that can be reached."""
    left, a, b = members, [], []
    while len(left) > 1:
        todo, left = [left[:1]], left[1:]
        while todo and len(left):
            x = todo.pop()
            for one in x:
                near = np.bitwise_count(left ^ one) <= radius
                if near.any():
                    reached, left = left[near], left[~near]
                    a.append(np.full(len(reached), one))
                    b.append(reached)
                    todo.append(reached)
                if not len(left):
                    break
    return a, b


def links(fps: DataFrame, radius: int, bands: int = 2) -> DataFrame:
    """(a, b) pairs of distinct fingerprints within ``radius`` bits; enough of them to connect all that are linked.

    ``fps`` has one row per distinct fingerprint.
    """

    def group_links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        two = starts[sizes == 2]
        x, y = fp[two], fp[two + 1]
        near = np.bitwise_count(x ^ y) <= radius
        a, b = [x[near]], [y[near]]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            more = chained(np.unique(fp[s : s + n]), radius)
            a += more[0]
            b += more[1]
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            # The last group may go on in the next batch.
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if whole:
                yield group_links(key[:whole], fp[:whole])
                key, fp = key[whole:], fp[whole:]
        if len(key):
            yield group_links(key, fp)

    met = fps.select(F.explode(variants(F.col("fingerprint"), radius, bands)).alias("place"), "fingerprint")
    dealt = met.repartition("place").sortWithinPartitions("place")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(docs: DataFrame, shingle: int = 3, radius: int = 3, bands: int = 2) -> DataFrame:
    """(doc_id, content, fingerprint, class_fingerprint, component_id), a row per row of ``docs``.

    component_id is the smallest doc_id that links of at most ``radius`` bits reach; null if all of those are null.
    class_fingerprint is the same for all rows of a component and never null. Repeated rows share a component; empty and
    null texts are linked by their fingerprint 0 like any other.
    """
    return _components(docs, shingle, radius, bands)[0]


def _components(docs: DataFrame, shingle: int, radius: int, bands: int) -> tuple[DataFrame, int]:
    """``components`` and the number of its rows."""
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    n = fps.count()
    classes = compact(fps.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), n, "classes")
    joined = connected(links(classes.select("fingerprint"), radius, bands))
    rooted = classes.join(joined, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    rooted = compact(rooted, n, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.select(F.col("fingerprint").alias("_fp"), F.col("root").alias("_root")).join(least.withColumnRenamed("root", "_root"), "_root")
    by_fp = compact(by_fp, n, "by_fingerprint")
    out = fps.join(by_fp, F.col("fingerprint") == F.col("_fp"))
    return out.select("doc_id", "content", "fingerprint", F.col("_root").alias("class_fingerprint"), "component_id"), n


def one_per_component(docs: DataFrame, shingle: int = 3, radius: int = 3, bands: int = 2) -> DataFrame:
    """``docs`` without near duplicates: of each component the row with the smallest doc_id stays.

    If only null ids are there, one of those rows stays; of rows that repeat id and text, one stays. All columns are kept, whatever their names.
    """
    return sheltered(docs, ("doc_id", "text"), lambda rows: _one_per_component(rows, shingle, radius, bands))


def _one_per_component(docs: DataFrame, shingle: int, radius: int, bands: int) -> DataFrame:
    classes, n = _components(docs, shingle, radius, bands)
    classes = compact(classes.select("doc_id", "content", "class_fingerprint"), n, "components")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content")
    best = classes.groupBy("class_fingerprint").agg(F.min(key).alias("best"))
    counted = classes.groupBy("class_fingerprint", "doc_id", "content").agg(F.count("*").alias("n")).alias("c")
    judged = counted.join(best.alias("b"), "class_fingerprint").select(
        F.col("doc_id").alias("_dup_id"), F.col("content").alias("_dup_content"), "n",
        (F.col("b.best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("b.best.content") == F.col("content"))).alias("stays"),
    )
    judged = compact(judged, n, "judged")
    rows = docs.withColumn("_content", content())
    same = F.col("doc_id").eqNullSafe(F.col("_dup_id")) & (F.col("_content") == F.col("_dup_content"))
    kept = rows.join(judged.where("not stays"), same, "left_anti")
    again = judged.where("stays and n > 1")
    if not again.isEmpty():
        once = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "_content"])
        kept = kept.join(again, same, "left_anti").unionByName(once)
    return kept.drop("_content")


def hexadecimal(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
