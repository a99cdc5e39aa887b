"""Hard negatives by inner product, multiplied several candidates at a time.

Components are whole numbers. Shifted by a bias they are not negative, and the components of several candidates stand in separate
fields of one wide integer (Kronecker substitution). One multiplication with an anchor's component then multiplies every field at
once; summed over all components, each field holds one candidate's product as long as no field overflows, which its
width rules out. Unpacking and taking off the biases gives exact scores. Integers of up to 53 bits are kept in
doubles, which hold them exactly and multiply as matrices; wider fields go into Python's own integers.

Candidates lie in blocks of rows, anchors in groups. Each group visits every run of blocks: the anchors of a group are sent to a run once and
stay in memory while the run's blocks stream past. A first pass finds each anchor's positives, a second one its negatives, since their
scores depend on those of the positives; each keeps only the best few rows per run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wxspark.session import stored

#: Rows and bytes of a block, anchors of a group, blocks of a run.
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 20
GROUP_ROWS = 4096
RUN = 16
#: Anchors multiplied at once.
SLICE = 256
#: Bits of a whole number that a double holds exactly, and fields of a wider word.
EXACT_BITS, WIDE_FIELDS = 53, 32
NO_ID = -(2**63)


def bounds(m: np.ndarray) -> tuple[int, int]:
    return (int(m.min()), int(m.max())) if m.size else (0, 0)


def field_bits(dim: int, a: tuple[int, int], c: tuple[int, int]) -> int:
    """Bits of a field that holds any sum of ``dim`` products of components shifted to start at 0."""
    return max(1, (dim * (a[1] - a[0]) * (c[1] - c[0])).bit_length())


def products(anchors: np.ndarray, candidates: np.ndarray, at_most: int | None = None) -> np.ndarray:
    """Exact inner products (int64, or Python integers beyond) of all rows of ``anchors`` with all rows of ``candidates``.

    ``at_most`` bounds the number of fields of a word.
    """
    n, dim = candidates.shape
    a, c = bounds(anchors), bounds(candidates)
    bits = field_bits(dim, a, c)
    fields = min(at_most or WIDE_FIELDS, max(1, EXACT_BITS // bits))
    wide = bits > EXACT_BITS or dim * max(abs(x) for x in (*a, *c)) ** 2 >= 2**62
    kind = object if wide else np.float64
    fields = min(at_most or WIDE_FIELDS, WIDE_FIELDS) if wide else fields
    left, right = anchors.astype(kind) - a[0], candidates.astype(kind) - c[0]
    words = -(-n // fields)
    # Field f of word w holds candidate f * words + w, so that unpacked fields are runs of columns.
    packed = np.zeros((words, dim), kind)
    for f in range(fields):
        part = right[f * words : (f + 1) * words]
        packed[: len(part)] += part * (1 << f * bits if wide else float(2 ** (f * bits)))
    total = left @ packed.T
    total = total if wide else total.astype(np.int64)
    mask, out = (1 << bits) - 1, np.empty((len(anchors), fields * words), object if wide else np.int64)
    for f in range(fields):
        out[:, f * words : (f + 1) * words] = total >> (f * bits) & mask
    # (a - a0)(c - c0) = ac - a0 c - c0 a + a0 c0, summed over all components.
    whole = object if wide else np.int64
    shift = a[0] * candidates.astype(whole).sum(1)[None, :] + c[0] * anchors.astype(whole).sum(1)[:, None] - dim * a[0] * c[0]
    return out[:, :n] + shift


def best_places(scores: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """Per row the places of its k best allowed columns, -1 where there are fewer; ties go to the earlier column."""
    rows, n = scores.shape
    width = min(k, n)
    out = np.full((rows, k), -1)
    if not width:
        return out
    spare = n.bit_length()
    low, high = bounds(scores)
    if scores.dtype == np.int64 and max(abs(low), abs(high)) < 1 << (61 - spare):
        # One number holds the score and, below it, how early the column is.
        key = np.where(ok, (scores << spare) | np.arange(n - 1, -1, -1), np.int64(NO_ID))
        top = np.argpartition(key, n - width, axis=1)[:, n - width :]
        got = np.take_along_axis(key, top, 1)
        order = np.argsort(got, axis=1)[:, ::-1]
        top, got = np.take_along_axis(top, order, 1), np.take_along_axis(got, order, 1)
        out[:, :width] = np.where(got == NO_ID, -1, top)
        return out
    for i in range(rows):
        allowed = np.flatnonzero(ok[i])
        chosen = sorted(allowed.tolist(), key=lambda j: (-int(scores[i, j]), j))[:k]
        out[i, : len(chosen)] = chosen
    return out


def prepared(vectors: DataFrame, scale: float, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v): v = floor(scale x) as longs; rows with a null label, a null vector or a null or non-finite component go.

    Components beyond the range of a long are held at its ends.
    """
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    fine = F.col(vector).isNotNull() & F.col(label).isNotNull()
    fine = fine & F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
    whole = F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("long"))
    return vectors.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), whole.alias("v"))


def narrow(m: np.ndarray) -> np.ndarray:
    low, high = bounds(m)
    for t in ("i1", "<i2", "<i4"):
        if np.iinfo(t).min <= low and high <= np.iinfo(t).max:
            return m.astype(t)
    return m.astype("<i8")


def matrix(data: bytes, width: int, dim: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").reshape(rows, dim).astype(np.int64)


def blocked(rows: DataFrame, is_anchor: str) -> DataFrame:
    """Rows of equal length in blocks, ordered by vec_id within a block; components as narrow as they fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = np.array([NO_ID if i is None else i for i in batch.column(0).to_pylist()], np.int64)
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            ends = np.asarray(batch.column(2).offsets).astype(np.int64)
            flat, ends = batch.column(2).flatten().to_numpy(zero_copy_only=False), ends - ends[0]
            asks = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            dims = np.diff(ends)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                at = at[np.argsort(ids[at], kind="stable")]
                step = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, 8 * d)))
                for s in range(0, len(at), step):
                    some = at[s : s + step]
                    m = narrow(flat[ends[some][:, None] + np.arange(d)])
                    yield pa.RecordBatch.from_pylist([{
                        "dim": d, "block": part << 32 | nth, "n": len(some), "width": m.itemsize, "ids": ids[some].tobytes(), "labels": labels[some].astype("<i8").tobytes(),
                        "m": m.tobytes(), "asked": np.flatnonzero(asks[some]).astype("<i4").tobytes(),
                    }], pa.schema(BLOCKS))
                    nth += 1

    marked = rows.select("vec_id", "label", "v", F.coalesce(F.expr(is_anchor), F.lit(False)).alias("asks"))
    return marked.mapInArrow(run, "dim int, block long, n int, width int, ids binary, labels binary, m binary, asked binary")


BLOCKS = [("dim", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("m", pa.binary()), ("asked", pa.binary())]
ANCHORS = "dim int, block long, place int, vec_id long, label long, m binary, width int"


def anchor_rows(blocks: DataFrame) -> DataFrame:
    """The rows that ask, one by one; (block, place) names a row of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                asked = np.frombuffer(r["asked"], "<i4")
                m = np.frombuffer(r["m"], f"<i{r['width']}").reshape(r["n"], r["dim"])[asked]
                ids, labels = np.frombuffer(r["ids"], "<i8")[asked], np.frombuffer(r["labels"], "<i8")[asked]
                n = len(asked)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, r["dim"], np.int32)), pa.array(np.full(n, r["block"])), pa.array(asked.astype(np.int32)), pa.array(ids), pa.array(labels), pa.array([v.tobytes() for v in m], pa.binary()), pa.array(np.full(n, r["width"], np.int32))],
                    ["dim", "block", "place", "vec_id", "label", "m", "width"],
                )

    return blocks.where(F.octet_length("asked") > 0).mapInArrow(run, ANCHORS)


def visited(blocks: DataFrame, anchors: DataFrame, work) -> DataFrame:
    """``work(anchors, blocks)`` for every pair of a group of anchors and a run of blocks.

    ``anchors`` has the columns of ANCHORS and ``wanted``, an array of scores. Anchors are dealt into groups by a hash and copied
    to each run, blocks into runs and copied to each group: both copies grow with the other side only by its
    number of groups or runs.
    """
    per_dim = blocks.groupBy("dim").agg(F.count("*").alias("b"), F.sum(F.octet_length("asked") / 4).cast("long").alias("a"))
    sizes = per_dim.where("a > 0").select("dim", F.ceil(F.col("b") / RUN).cast("int").alias("runs"), F.ceil(F.col("a") / GROUP_ROWS).cast("int").alias("groups"))
    sizes = stored(sizes, "negatives_sizes")  # one row per vector length
    tasks = sizes.agg(F.sum(F.col("runs").cast("long") * F.col("groups"))).first()[0] or 1

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    nothing = [F.lit(None).cast("array<long>").alias("wanted"), F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("labels"), F.lit(1).alias("n")]
    held = anchors.join(sizes, "dim").withColumn("grp", F.pmod(F.xxhash64("block", "place"), "groups").cast("int")).withColumn("run", every("runs"))
    a = held.select("dim", "grp", "run", F.lit(0).alias("kind"), "block", "place", "vec_id", "label", "m", "width", "wanted", *nothing[1:])
    dealt = blocks.join(sizes, "dim").withColumn("run", F.pmod(F.xxhash64("block"), "runs").cast("int")).withColumn("grp", every("groups"))
    b = dealt.select("dim", "grp", "run", F.lit(1).alias("kind"), "block", F.lit(0).alias("place"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("long").alias("label"), "m", "width", nothing[0], "ids", "labels", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield batch.slice(i, 1).to_pylist()[0]

        here, some, states = None, [], []
        for r in rows():
            key = (r["dim"], r["grp"], r["run"])
            if key != here:
                for s in states:
                    yield s.result()
                here, some, states = key, [], []
            if r["kind"] == 0:
                some.append(r)
                # Anchors that a group holds beyond its share are further slices, so memory follows the slices of one group.
                if len(some) == SLICE:
                    states.append(work(some, key[0]))
                    some = []
                continue
            if some:
                states.append(work(some, key[0]))
                some = []
            m = matrix(r["m"], r["width"], key[0], r["n"])
            ids, labels = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8")
            for s in states:
                s.see(r["block"], m, ids, labels)
        for s in states:
            yield s.result()

    # A fixed number of partitions: there is far more work in a pair than its bytes tell.
    parts = max(1, min(tasks, 20_000))
    few = a.unionByName(b).repartition(parts, "dim", "grp", "run").sortWithinPartitions("dim", "grp", "run", "kind", "block", "place")
    return few.mapInArrow(run, FOUND)


class Best:
    """Best rows seen for every (anchor, slot): scores, ids, blocks and places, best first."""

    def __init__(self, anchors: list[dict], dim: int, slots: int, k: int):
        self.block = np.array([a["block"] for a in anchors], np.int64)
        self.place = np.array([a["place"] for a in anchors], np.int64)
        self.label = np.array([a["label"] for a in anchors], np.int64)
        self.m = np.array([np.frombuffer(a["m"], f"<i{a['width']}") for a in anchors], np.int64).reshape(len(anchors), dim)
        self.wanted = [a["wanted"] or [] for a in anchors]
        self.slots, self.k, self.found = slots, k, {}
        #: Score of the k-th best row so far; a row below it can't be among the best.
        self.floor = np.full((len(anchors), slots), NO_ID)

    def add(self, rows: np.ndarray, slot: int, scores: np.ndarray, ok: np.ndarray, ids: np.ndarray, block: int, cols: np.ndarray) -> None:
        """Allowed scores of the anchors ``rows``; column j is the row ``cols[j]`` of the block."""
        ok = ok & (scores >= self.floor[rows, slot][:, None]).astype(bool)
        some = np.flatnonzero(ok.any(1))
        places = best_places(scores[some], ok[some], self.k)
        for at, i, row in zip(some.tolist(), rows[some].tolist(), places):
            row = row[row >= 0]
            new = [(-s, d, block, p) for s, d, p in zip(scores[at, row].tolist(), ids[cols[row]].tolist(), cols[row].tolist())]
            kept = self.found[i, slot] = sorted(self.found.get((i, slot), []) + new)[: self.k]
            if len(kept) == self.k:
                self.floor[i, slot] = -kept[-1][0]

    def result(self) -> pa.RecordBatch:
        out = [(int(self.block[i]), int(self.place[i]), slot, d, -s, b, p) for (i, slot), rows in self.found.items() for s, d, b, p in rows]
        names = ["block", "place", "slot", "vec_id", "score", "other_block", "other_place"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], names)


FOUND = "block long, place int, slot int, vec_id long, score long, other_block long, other_place int"


class Positives(Best):
    """Best rows of the anchor's label, its own row left out."""

    def see(self, block: int, m: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        # Only rows that share a label meet.
        for label in np.intersect1d(self.label, labels).tolist():
            mine, cols = np.flatnonzero(self.label == label), np.flatnonzero(labels == label)
            ok = ~((self.block[mine] == block)[:, None] & (self.place[mine][:, None] == cols))
            self.add(mine, 0, products(self.m[mine], m[cols]), ok, ids, block, cols)


class Negatives(Best):
    """For each wanted score the best rows of another label whose score lies within two percentages of it."""

    low, high = 50, 95

    def see(self, block: int, m: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        scores = products(self.m, m)
        other = self.label[:, None] != labels
        every, cols = np.arange(len(self.m)), np.arange(len(ids))
        wide = scores.dtype == object or max(map(abs, bounds(scores))) >= 2**56
        per_cent = scores.astype(object) * 100 if wide else scores * 100
        for slot in range(self.slots):
            want = np.array([w[slot] if slot < len(w) else 0 for w in self.wanted], object if wide else np.int64)
            has = np.array([slot < len(w) for w in self.wanted])
            ok = other & (per_cent >= (self.low * want)[:, None]) & (per_cent <= (self.high * want)[:, None]) & has[:, None]
            self.add(every, slot, scores, ok.astype(bool), ids, block, cols)


def mined(rows: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``rows`` (vec_id, label, v).

    Anchors are the rows that meet the SQL condition ``is_anchor``. Positives of an anchor are its best ``positives`` other rows of its
    label; the negatives of a positive are the best ``negatives`` rows of another label whose score times 100 lies between ``low`` and ``high``
    times the positive's. Higher scores come first, ties go to the smaller vec_id; null ids order first, and rows that
    repeat an id are rows of their own, in the order of the table's blocks. Only vectors of equal length meet. Products
    must fit 64 bits. Anchors without positives or positives without negatives give no row; an empty table gives none.
    """
    blocks = stored(blocked(rows, is_anchor), "negatives_blocks")
    anchors = stored(anchor_rows(blocks), "negatives_anchors")
    order = [F.desc("score"), "vec_id", "other_block", "other_place"]
    first = visited(blocks, anchors.withColumn("wanted", F.array().cast("array<long>")), lambda a, d: Positives(a, d, 1, positives))
    ranked = first.withColumn("nth", F.row_number().over(Window.partitionBy("block", "place").orderBy(*order))).where(F.col("nth") <= positives)
    near = stored(ranked.select("block", "place", "nth", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives_positives")
    wanted = near.groupBy("block", "place").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "positive_score"))), lambda x: x["positive_score"]).alias("wanted"))

    def negatives_of(a: list[dict], dim: int) -> Negatives:
        out = Negatives(a, dim, positives, negatives)
        out.low, out.high = low, high
        return out

    second = visited(blocks, anchors.join(wanted, ["block", "place"]), negatives_of)
    by_slot = Window.partitionBy("block", "place", "slot").orderBy(*order)
    hard = second.withColumn("rank", F.row_number().over(by_slot)).where(F.col("rank") <= negatives)
    hard = hard.select("block", "place", (F.col("slot") + 1).alias("nth"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    out = hard.join(near, ["block", "place", "nth"]).join(anchors.select("block", "place", F.col("vec_id").alias("anchor_id")), ["block", "place"])
    return out.select(known("anchor_id"), known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")


def report(vectors: DataFrame) -> DataFrame:
    """Anchors are ids divisible by 50; the label of every seventh id is the next of ten."""
    moved = vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mined(prepared(moved, 256), "vec_id % 50 = 0")
