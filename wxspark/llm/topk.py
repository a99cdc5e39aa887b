"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are cut into segments; a segment is known by its sum and by the norm of its deviations from the mean. Of two
vectors these bound the squared distance from below, |q - c|^2 >= sum over segments of n (mean_q - mean_c)^2 + (dev_q -
dev_c)^2, and so, as |q|^2 and |c|^2 are known, the inner product from above. Bounds go from few segments to many; pairs whose bound
falls below the k-th best score seen for the query are dropped, and only survivors get their exact product.

Vectors are written once, in blocks of rows of one length with components as narrow as they fit, to plain files in the shared folder; a
Parquet table names the place of each block. Queries are dealt into groups and blocks into runs. A task reads the queries of its
group and lets the blocks of its run stream past, so what is shuffled are places of blocks and the best rows of each query and run,
never vectors, and disk does not grow with the number of pairs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wxspark.llm.hard_negatives import best_places, narrow
from wxspark.session import scratch, stored

#: Rows and bytes (of eight-byte components) of a block.
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 22
#: Queries and candidates that meet at once, and bytes of the latter as eight-byte components.
QUERY_ROWS, CANDIDATE_ROWS, CANDIDATE_BYTES = 256, 8192, 1 << 23
#: Candidates multiplied at once, so that the products stay in a processor's cache.
STRIP_ROWS = 2048
#: Queries and their bytes that a task holds, groups into which fewer are dealt.
GROUP_ROWS, GROUP_BYTES, GROUPS = 4096, 1 << 25, 32
#: Candidates that make a run worth its while, and tasks above which a group's candidates are not cut into runs.
RUN_ROWS, TASKS = 1 << 18, 256
#: Numbers of segments, coarse to fine.
LEVELS = (4, 16)
#: Pairs that survive are multiplied one by one where they are fewer than one in so many.
SPARSE = 32


def statistics(v: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Scaled means and deviation norms per segment: products of the first plus products of the second bound the inner product."""
    edges = np.linspace(0, v.shape[1], min(segments, v.shape[1]) + 1).astype(int)[:-1]
    n = np.diff(np.append(edges, v.shape[1]))
    member = np.zeros((v.shape[1], len(n)))
    member[np.arange(v.shape[1]), np.repeat(np.arange(len(n)), n)] = 1
    sums, squares = v @ member, (v * v) @ member
    return sums / np.sqrt(n), np.sqrt(np.maximum(squares - sums * sums / n, 0))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


class Side:
    """Rows that meet others: what bounds their products, coarse to fine, and the components themselves."""

    def __init__(self, v: np.ndarray):
        self.v, self.wide = v, v.astype(np.float64)
        self.bounds = [np.hstack(statistics(self.wide, level)) for level in LEVELS] if v.shape[1] else []
        self.norm = np.sqrt((self.bounds[0] * self.bounds[0]).sum(1)) if v.shape[1] else np.zeros(len(v))
        self.most = float(self.norm.max(initial=0))
        self.kinds: dict[str, list[np.ndarray]] = {}

    def levels(self, kind: str) -> list[np.ndarray]:
        """Matrices whose products with another side's are bounds, and last the scores. ``kind`` i8 has bounds in doubles."""
        if kind not in self.kinds:
            exact = self.v if kind == "i8" else self.wide
            self.kinds[kind] = [m.astype("f8" if kind == "i8" else kind, copy=False) for m in self.bounds] + [exact.astype(kind, copy=False)]
        return self.kinds[kind]


ROOM: dict[str, np.ndarray] = {}


def room(kind: str, rows: int, cols: int) -> np.ndarray:
    """A matrix to write into; the next one of its kind takes the same memory, as fresh pages would cost more than the products."""
    if kind not in ROOM or ROOM[kind].size < rows * cols:
        ROOM[kind] = np.empty(max(rows * cols, QUERY_ROWS * STRIP_ROWS), kind)
    return ROOM[kind][: rows * cols].reshape(rows, cols)


def rounded_down(scores: np.ndarray) -> np.ndarray:
    """Whole numbers as doubles, none larger than it was."""
    out = scores.astype(np.float64)
    if np.abs(out).max(initial=0) >= 2**53:
        out = np.array([f if int(f) <= s else np.nextafter(f, -np.inf) for f, s in zip(out.tolist(), scores.tolist())])
    return out


def places_of(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns that are true, by row. Where few are, eight at once are looked at first, which is several times faster than ``nonzero``."""
    flat = hit.reshape(-1)
    if flat.size % 8 == 0 and np.count_nonzero(flat) * SPARSE < flat.size:
        words = np.flatnonzero(flat.view(np.uint64))
        nth, bit = np.nonzero(flat.reshape(-1, 8)[words])
        places = words[nth] * 8 + bit
    else:
        places = np.flatnonzero(flat)
    return np.divmod(places, max(1, hit.shape[1]))


def pair_products(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 22) // max(1, a.shape[1]))
    parts = [np.einsum("ij,ij->i", a[rows[s : s + step]], b[cols[s : s + step]]) for s in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros(0, a.dtype)


def ranked(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row, by row and best first, ties to the smaller id."""
    order = np.lexsort((ids, ~scores, rows))  # ~s falls as s rises, for the least whole number too
    r = rows[order]
    first = np.searchsorted(r, r)
    return order[np.arange(len(r)) - first < k]


def survivors(q: Side, c: Side, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, score) of pairs among which are the k best of every row that reach ``floor``; candidates are in order of their ids."""
    reach = q.most * c.most
    # Every sum of products stays below the reach, so that whole numbers are exact.
    kind = "f4" if reach < 2**24 else "f8" if reach < 2**52 else "i8"
    slack = (1e-5 if kind == "f4" else 1e-7) * (q.norm * c.most + 1e-3)
    low = (floor - slack).astype("f4" if kind == "f4" else "f8")
    least = floor.astype("f4") if kind == "f4" else floor
    left, right = q.levels(kind), c.levels(kind)
    strips = [strip(left, [m[s : s + STRIP_ROWS] for m in right], own - s, k, low, least) for s in range(0, len(c.v), STRIP_ROWS)]
    if not strips:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.repeat(np.arange(len(strips)) * STRIP_ROWS, [len(x[0]) for x in strips])
    rows, places, scores = (np.concatenate(x) for x in zip(*strips))
    return rows, places + at, scores


def strip(left: list[np.ndarray], right: list[np.ndarray], own: np.ndarray, k: int, low: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``survivors`` among few enough candidates for a processor's cache; bounds must reach ``low``, scores ``least``."""
    rows, cols, pairs = np.arange(len(left[-1])), np.arange(len(right[-1])), None
    for a, b in zip(left[:-1], right[:-1]):
        if pairs is not None:
            r, p = pairs
            keep = pair_products(a, b, r, p) >= low[r]
            pairs = r[keep], p[keep]
            continue
        hit = reached(a, b, rows, cols, low)[1]
        n = np.count_nonzero(hit)
        if n * SPARSE < hit.size:
            r, p = places_of(hit)
            pairs = rows[r], cols[p]
        elif n * 4 < hit.size * 3:
            some, others = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
            if len(some) * len(others) * 4 < hit.size * 3:  # else gathering them costs more than they save
                rows, cols = rows[some], cols[others]
    a, b = left[-1], right[-1]
    if pairs is not None:
        r, p = pairs
        scores = pair_products(a, b, r, p)
        keep = (scores >= least[r]) & (own[r] != p)
        return r[keep], p[keep], scores[keep].astype(np.int64)
    scores, hit = reached(a, b, rows, cols, least)
    # The place of a row's own column among those left, if it is there.
    mine = np.flatnonzero((own[rows] >= 0) & (own[rows] < len(b)))
    at = np.searchsorted(cols, own[rows][mine])
    there = (at < len(cols)) & (cols[np.minimum(at, len(cols) - 1)] == own[rows][mine])
    hit[mine[there], at[there]] = False
    many = np.count_nonzero(hit) > 4 * k
    crowded = np.flatnonzero(np.count_nonzero(hit, axis=1) > 4 * k) if many else []
    # Crowded rows first learn their k-th best score. Those still crowded by rows that tie are cut by the order of columns.
    for s in range(0, len(crowded), 64):
        some = crowded[s : s + 64]
        known = np.where(hit[some], scores[some], np.iinfo(np.int64).min if scores.dtype.kind == "i" else -np.inf)
        hit[some] &= scores[some] >= np.partition(known, known.shape[1] - k, axis=1)[:, [known.shape[1] - k]]
        some = some[np.count_nonzero(hit[some], axis=1) > 4 * k]
        if len(some):
            top = best_places(scores[some].astype(np.int64), hit[some], k)
            hit[some] = False
            hit[some[:, None], top] = True
    r, p = places_of(hit)
    return rows[r], cols[p], scores[r, p].astype(np.int64)


def reached(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of some rows with some columns, and which of them reach the row's ``low``; both in memory that the next call takes."""
    a, b = a if len(rows) == len(a) else a[rows], b if len(cols) == len(b) else b[cols]
    out = np.matmul(a, b.T, out=room(a.dtype.str, len(a), len(b)))
    return out, np.greater_equal(out, low[rows][:, None], out=room("?", *out.shape))


def block_best(q: Side, c: Side, c_ids: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query row the places of its k best candidates and their scores, one below the other; ``floor`` is raised in place.

    ``c_ids`` ascend. ``own`` is the place of the query's own row among the candidates, or -1. ``floor`` is a score that k candidates reach.
    """
    rows, places, scores = survivors(q, c, own, k, floor)
    top = ranked(rows, scores, c_ids[places], k)
    rows, places, scores = rows[top], places[top], scores[top]
    ends = np.searchsorted(rows, np.arange(len(q.v)), "right")
    full = np.flatnonzero(np.bincount(rows, minlength=len(q.v)) >= k)
    floor[full] = np.maximum(floor[full], rounded_down(scores[ends[full] - 1]))
    return rows, places, scores


def block_top(q: np.ndarray, c: np.ndarray, c_ids: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray):
    """``block_best`` row by row, for candidates in any order."""
    order = np.argsort(c_ids, kind="stable")
    place = np.append(np.argsort(order), -1)
    rows, places, scores = block_best(Side(q), Side(c[order]), c_ids[order], place[own], k, floor)
    for i in range(len(q)):
        mine = rows == i
        yield i, order[places[mine]], scores[mine]


class Asking:
    """Some queries, the best rows seen for each, and the score that k of them reach."""

    def __init__(self, block: np.ndarray, place: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int):
        self.block, self.place, self.ids, self.k = block, place, ids, k
        self.from_block = {b: np.flatnonzero(block == b) for b in np.unique(block).tolist()}
        self.side, self.floor = Side(v), np.full(len(ids), -np.inf)
        self.scores, self.found, self.n = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64), np.zeros(len(ids), np.int64)

    def see(self, c: Side, c_ids: np.ndarray, columns: dict[int, np.ndarray]) -> None:
        """Candidates in order of their ids; ``columns`` has those of each block, in the order of its rows."""
        own = np.full(len(self.ids), -1)
        for b in self.from_block.keys() & columns.keys():
            asks = self.from_block[b]
            own[asks] = columns[b][self.place[asks]]
        rows, places, scores = block_best(self.side, c, c_ids, own, self.k, self.floor)
        some = np.unique(rows)
        r, at = places_of(np.arange(self.k) < self.n[some][:, None])
        rows, scores, ids = np.concatenate([some[r], rows]), np.concatenate([self.scores[some[r], at], scores]), np.concatenate([self.found[some[r], at], c_ids[places]])
        top = ranked(rows, scores, ids, self.k)
        rows, scores, ids = rows[top], scores[top], ids[top]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        self.scores[rows, nth], self.found[rows, nth] = scores, ids
        self.n[some] = np.bincount(rows, minlength=len(self.ids))[some]
        full = some[self.n[some] == self.k]
        self.floor[full] = np.maximum(self.floor[full], rounded_down(self.scores[full, -1]))

    def result(self) -> pa.RecordBatch:
        r, at = places_of(np.arange(self.k) < self.n[:, None])
        columns = [self.block[r], self.place[r].astype(np.int32), self.ids[r], self.found[r, at], self.scores[r, at]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q_block", "q_row", "query", "vec_id", "score"])


def quantised(vectors: DataFrame, scale: float, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) with v = floor(scale * x) as long integers; vectors that are null or hold null or non-finite components go.

    Components beyond the range of a long are held at its ends.
    """
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    fine = F.col(vector).isNotNull() & F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
    return vectors.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("long")).alias("v"))


def opened(folder: str):
    """The file system and path of a shared folder that Python and Spark both reach."""
    import os

    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if ":/" in folder else os.path.abspath(folder))


def top_k(vectors: DataFrame, is_query: str, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row of ``vectors`` (vec_id, v) that meets the SQL condition ``is_query``.

    Candidates are all rows of the same length but the query's own row; fewer than k if there are fewer. Ties go to the smaller
    vec_id. Products are exact as long as they fit 64 bits. Rows that repeat a vec_id are rows of their own; a null vec_id
    orders first. An empty table has no result.
    """
    folder = scratch(vectors.sparkSession, "blocks")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes blocks of rows of one length and says where they are: identifiers, places of rows that ask, components.

        A repeated task writes another file; only what the table names is read.
        """
        from pyspark import TaskContext

        part, nth, at, file, out = TaskContext.get().partitionId(), 0, 0, f"{uuid.uuid4().hex}.blocks", None
        made = []
        for batch in batches:
            ids, rows, ask = batch.column(0), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            known = np.array([-(2**63) if i is None else i for i in ids.to_pylist()], np.int64)
            flat, ends = rows.flatten().to_numpy(zero_copy_only=False), np.asarray(rows.offsets)
            ends = ends - ends[0]
            dims = np.diff(ends)
            for d in np.unique(dims).tolist():
                same = np.flatnonzero(dims == d)
                step = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, 8 * d)))
                for s in range(0, len(same), step):
                    some = same[s : s + step]
                    m, asked = narrow(flat[ends[some][:, None] + np.arange(d)]), np.flatnonzero(ask[some])
                    if out is None:
                        store, base = opened(folder)
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{base}/{file}")
                    data = known[some].astype("<i8").tobytes() + asked.astype("<i4").tobytes() + m.tobytes()
                    out.write(data)
                    made.append((d, part << 32 | nth, len(some), len(asked), m.itemsize, file, at))
                    nth, at = nth + 1, at + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()))], ["dim", "block", "n", "asks", "width", "file", "at"])

    rows = vectors.select("vec_id", "v", F.coalesce(F.expr(is_query), F.lit(False)).alias("asks"))
    blocks = stored(rows.mapInArrow(pack, "dim int, block long, n int, asks int, width int, file string, at long"), "block_places")
    # One row per block, a few thousand times fewer than vectors. Of each length, blocks are cut into groups of about as many queries and runs of about as many rows.
    before = Window.partitionBy("dim").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per_dim = blocks.groupBy("dim").agg(F.sum("n").alias("rows"), F.sum("asks").alias("queries")).where("queries > 0")
    held = F.greatest(F.lit(1), F.least(F.lit(GROUP_ROWS), F.floor(GROUP_BYTES / (8 * F.greatest(F.lit(1), "dim")))))
    per_dim = per_dim.withColumn("groups", F.greatest(F.ceil(F.col("queries") / held), F.least(F.ceil(F.col("queries") / QUERY_ROWS), F.lit(GROUPS))).cast("int"))
    per_dim = per_dim.withColumn("runs", F.least(F.ceil(F.col("rows") / RUN_ROWS), F.ceil(F.lit(TASKS) / F.col("groups"))).cast("int"))
    earlier = Window.orderBy("dim").rowsBetween(Window.unboundedPreceding, -1)  # one row per length
    per_dim = per_dim.withColumn("first", F.coalesce(F.sum(F.col("groups").cast("long") * F.col("runs")).over(earlier), F.lit(0)))
    dealt = blocks.withColumn("rows_before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("queries_before", F.coalesce(F.sum("asks").over(before), F.lit(0))).join(per_dim, "dim")
    share = lambda part, whole, count: F.least(F.floor(F.col(part) * F.col(count) / F.col(whole)), F.col(count) - 1).cast("int")
    dealt = dealt.withColumn("grp", share("queries_before", "queries", "groups")).withColumn("run", share("rows_before", "rows", "runs"))
    dealt = stored(dealt.drop("rows", "queries", "rows_before", "queries_before"), "block_numbers")
    # A fixed number of partitions: there is far more work in a block than the bytes of its place tell. Lengths with few queries share some.
    own = F.col("groups").cast("long") * F.col("runs")
    many, others = dealt.select("dim", "groups", "runs").distinct().agg(F.sum(F.when(F.col("groups") > GROUPS, own)), F.sum(F.when(F.col("groups") <= GROUPS, own))).first()
    parts = max(1, min((many or 0) + min(others or 0, TASKS), 20_000))

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    task = (F.col("first") + F.col("grp").cast("long") * F.col("runs") + F.col("run")).alias("task")
    named = ["block", "dim", "n", "asks", "width", "file", "at"]
    asking = dealt.where("asks > 0").withColumn("run", every("runs")).select(task, F.lit(0).alias("kind"), *named)
    asked = dealt.withColumn("grp", every("groups")).select(task, F.lit(1).alias("kind"), *named)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base, name, file = None, None, None, None

        def block(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Identifiers, places of rows that ask, components."""
            nonlocal store, base, name, file
            if store is None:
                store, base = opened(folder)
            if name != r["file"]:
                if file is not None:
                    file.close()
                name, file = r["file"], store.open_input_file(f"{base}/{r['file']}")
            n, d, asks, width = r["n"], r["dim"], r["asks"], r["width"]
            data = file.read_at(8 * n + 4 * asks + width * n * d, r["at"])
            return np.frombuffer(data, "<i8", n), np.frombuffer(data, "<i4", asks, 8 * n), np.frombuffer(data, f"<i{width}", n * d, 8 * n + 4 * asks).reshape(n, d)

        def queries(some: list[tuple[np.ndarray, ...]]) -> list[Asking]:
            whole = [np.concatenate(x) for x in zip(*some)]
            return [Asking(*(x[s : s + QUERY_ROWS] for x in whole[:3]), whole[3][s : s + QUERY_ROWS], k) for s in range(0, len(whole[0]), QUERY_ROWS)]

        def shown(some: list[tuple[int, np.ndarray, np.ndarray]], states: list[Asking]) -> None:
            ids, m = (np.concatenate([x[i] for x in some]) for i in (1, 2))
            order = np.argsort(ids, kind="stable")
            column = np.argsort(order)
            ends = np.cumsum([len(x[1]) for x in some])
            columns = {x[0]: column[e - len(x[1]) : e] for x, e in zip(some, ends.tolist())}
            c, ids = Side(m[order]), ids[order]
            for s in states:
                s.see(c, ids, columns)

        here, some, tile, size, states = None, [], [], 0, []
        for r in (r for batch in batches for r in batch.to_pylist()):
            if r["task"] != here:
                if tile:
                    shown(tile, states)
                yield from (s.result() for s in states)
                here, some, tile, size, states = r["task"], [], [], 0, []
            if r["kind"] == 0:
                ids, places, m = block(r)
                some.append((np.full(len(places), r["block"]), places, ids[places], m[places]))
                continue
            if some:
                states, some = queries(some), []
            if not states:
                continue
            ids, _, m = block(r)
            if tile and (size + len(ids) > CANDIDATE_ROWS or (size + len(ids)) * 8 * r["dim"] > CANDIDATE_BYTES):
                shown(tile, states)
                tile, size = [], 0
            tile.append((r["block"], ids, m))
            size += len(ids)
        if tile:
            shown(tile, states)
        yield from (s.result() for s in states)

    few = asking.unionByName(asked).repartition(parts, "task").sortWithinPartitions("task", "kind", "block")
    found = few.mapInArrow(search, "q_block long, q_row int, query long, vec_id long, score long")
    order = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "vec_id")
    ranks = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    missing = F.lit(-(2**63))
    return ranks.select(F.nullif("query", missing).alias("query_id"), "rank", F.nullif("vec_id", missing).alias("vec_id"), "score")
