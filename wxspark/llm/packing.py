"""Best-fit packing of documents into token sequences.

Lengths are whole numbers from 1 to the capacity, so how many sequences hold which lengths follows from the histogram of
lengths alone: at most ``capacity`` rows, whatever the corpus. The plan made from it says "of length s, the items
numbered a to b go into these sequences, so many each"; documents get numbers within their length by a distributed
rank and look their place up. Method:

* items above half the capacity open a sequence each, longest first, and take as partner the longest item above a third
  that still fits; leftover items above a third pair with each other. No sequence holds more than two such items;
* items up to a third go, longest first, into the fullest sequence that still has room for them (best fit), and into new
  sequences when none has.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wxspark.llm.common import salted_ranks
from wxspark.llm.tokens import encoded, id_rows
from wxspark.session import small_batches, stored

#: Rows and bytes of text that a worker gets at once while items are made.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20

#: Columns of a plan row: items of ``size`` numbered ``first`` up to below ``stop`` lie ``each`` per sequence from
#: sequence ``base`` on, the first of them at ``offset``.
PLAN = ("size", "first", "stop", "base", "each", "offset")


class _Plan:
    """Sequences made so far, in groups of equally filled ones."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = dict(counts)
        self.taken: dict[int, int] = defaultdict(int)
        self.capacity = capacity
        self.sequences = 0
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: runs (base, how many sequences)
        self.rows: list[tuple[int, int, int, int, int, int]] = []

    def place(self, size: int, base: int, n: int, each: int, room: int) -> None:
        """Put ``each`` items into every one of ``n`` sequences that have ``room`` left."""
        first = self.taken[size]
        self.rows.append((size, first, first + n * each, base, each, self.capacity - room))
        self.taken[size] += n * each
        self.left[size] -= n * each
        if room > each * size:
            self.gaps[room - each * size].append((base, n))

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Plan rows and number of sequences for ``counts`` items of each length (1 to ``capacity``)."""
    p = _Plan({s: n for s, n in counts.items() if n > 0}, capacity)
    large = sorted((s for s in p.left if 3 * s > capacity), reverse=True)
    for size in large:
        while p.left[size]:
            n = p.left[size]
            mate = next((m for m in large if m <= size and m + size <= capacity and (p.left[m] > 1 if m == size else p.left[m])), None)
            if mate is None:
                p.place(size, p.open(n), n, 1, capacity)
            elif mate == size:
                base = p.open(n // 2)
                p.place(size, base, n // 2, 2, capacity)
            else:
                n = min(n, p.left[mate])
                base = p.open(n)
                first = p.taken[size]
                p.rows.append((size, first, first + n, base, 1, 0))
                p.taken[size] += n
                p.left[size] -= n
                p.place(mate, base, n, 1, capacity - size)
    for size in sorted((s for s in p.left if 3 * s <= capacity), reverse=True):
        while p.left[size]:
            room = min((r for r, runs in p.gaps.items() if runs and r >= size), default=None)
            if room is None:
                each = capacity // size
                n = p.left[size] // each
                if n:
                    p.place(size, p.open(n), n, each, capacity)
                else:
                    p.place(size, p.open(1), 1, p.left[size], capacity)
                continue
            base, n = p.gaps[room].pop()
            each = room // size
            full = min(n, p.left[size] // each)
            if full:
                p.place(size, base, full, each, room)
            if full < n:
                rest = p.left[size]
                if 0 < rest < each:
                    p.place(size, base + full, 1, rest, room)
                    full += 1
                if full < n:
                    p.gaps[room].append((base + full, n - full))
    return p.rows, p.sequences


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document; ids are little-endian unsigned 32-bit integers.

    A document is its tokens and ``end_id``. Only one longer than ``capacity`` is cut, into pieces of ``capacity`` ids
    of which the first may be shorter. A null text is empty; a document without any id has no piece. Rows are independent: null
    and repeated ids are kept, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners = batch.column(0)
            for row, ids, n in encoded(batch.column(1), tokenizer, end_id):
                k = -(-n // capacity)  # pieces of each document
                piece = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                head = np.repeat(n - (k - 1) * capacity, k)
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                length = np.where(piece == 0, head, capacity)
                owner = owners.take(pa.array(row + np.repeat(np.arange(len(n)), k)))
                yield pa.RecordBatch.from_arrays(
                    [owner, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), id_rows(ids, length)],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def pack(items: DataFrame, capacity: int, order: list[str], length: str = "length") -> DataFrame:
    """Add sequence_id and offset to ``items``, whose ``length`` is from 1 to ``capacity``.

    ``order`` names columns that identify an item; rows equal in all of them are interchangeable. Lengths of null, zero or
    less take no place: both columns are null. A longer one raises an error. An empty table stays empty. ``items`` are made once,
    from small batches where Python makes them.
    """
    size = F.col(length)
    with small_batches(items.sparkSession, BATCH_ROWS, BATCH_BYTES):
        items = stored(items, "items")
    counts = {r[0]: r[1] for r in items.where(size >= 1).groupBy(size.cast("long")).count().limit(capacity + 1).collect()}
    if counts and max(counts) > capacity:
        raise ValueError(f"an item is longer than {capacity}")
    rows, _ = plan(counts, capacity)
    # Within a length plan rows cover the item numbers in order, so one search finds the row of an item.
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, len(PLAN))
    keys = table[:, 0] << 44 | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(batch.schema.get_field_index("_size")).to_numpy(zero_copy_only=False)
            q = batch.column(batch.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            at = table[np.searchsorted(keys, s << 44 | q, "right") - 1]
            nth = q - at[:, 1]
            kept = [c for c in batch.schema.names if c not in ("_size", "rank")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(at[:, 3] + nth // at[:, 4]), pa.array(at[:, 5] + nth % at[:, 4] * s)],
                [*kept, "sequence_id", "offset"],
            )

    kept = [c for c in items.columns if c not in ("sequence_id", "offset", "_size", "rank")]
    usable = items.where(size >= 1).select(*kept, size.cast("long").alias("_size"))
    ranked = salted_ranks(usable, ["_size"], [c for c in order])
    schema = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in kept)
    placed = ranked.select(*kept, "_size", "rank").mapInArrow(run, f"{schema}, sequence_id long, offset long")
    none = items.where(size.isNull() | (size < 1)).select(*kept, F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    return placed.unionByName(none)


def sequences(placed: DataFrame, ids: str = "ids") -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths): the packed sequences themselves; each is bounded by the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", ids, "doc_id", "length")))
    joined = placed.where("sequence_id is not null").groupBy("sequence_id").agg(parts.alias("p"))
    return joined.select(
        "sequence_id",
        F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x[ids])).alias("ids"),
        F.col("p.doc_id").alias("doc_ids"),
        F.col("p.length").alias("lengths"),
    )
