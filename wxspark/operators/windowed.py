"""Ridge regression of the next row on the last ``length`` rows, from cross-moments instead of copied windows.

The products a regression on windows needs are sums over the series of x_f(u) x_g(u + k): they depend on the distance k of two
places in the window alone, but for the few rows before the first and after the last window. So one pass adds up the
products of every distance (blocks of rows with ``length`` rows of the next block), and the first and last
``length`` rows of each series correct the edges. No row is copied ``length`` times; a task holds one block and one moment matrix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wxspark.operators import timeline
from wxspark.operators.forest import ridge
from wxspark.operators.timeline import COUNT, POS, Shape, measure
from wxspark.schema import STATION, TARGETS, TS

#: Rows of a block; each carries ``length`` rows of the next one.
BLOCK = 8192


def lagged_products(x: np.ndarray, home: int, length: int) -> np.ndarray:
    """sum over u < ``home`` of x(u) x(u + k)^T for k = 0..length; rows past the end count as 0."""
    padded = np.vstack([x, np.zeros((max(0, home + length - len(x)), x.shape[1]))])
    return np.stack([padded[:home].T @ padded[k : k + home] for k in range(length + 1)])


def run_products(rows: np.ndarray) -> np.ndarray:
    """E[i, j] = sum over v = 1..i of x(i - v) x(j - v)^T for i <= j: products of pairs that lie before a window's first row.

    ``rows`` are the first rows of a series; for its last ones reverse them and the places.
    """
    n, f = rows.shape
    out = np.zeros((n + 1, n + 1, f, f))
    for i in range(1, n + 1):
        out[i, i:] = out[i - 1, i - 1 : n] + np.einsum("f,jg->jfg", rows[i - 1], rows[i - 1 : n])
    return out


def edge_products(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """What the whole-series products hold too much, for places 0..length: (i, j, f, g) with i <= j."""
    before = run_products(head)
    # Pairs after the last window: the same sums on the reversed series, places and roles swapped.
    after = run_products(tail[::-1])[::-1, ::-1].transpose(1, 0, 3, 2)
    return before + after


def window_moments(df: DataFrame, length: int, columns: Sequence[str], shift: np.ndarray, *, station=STATION, ts=TS, shape: Shape | None = None) -> tuple[np.ndarray, int]:
    """Moment matrix of (places 0..length) x columns and a constant over all windows of all series, and the number of windows.

    ``shift`` is taken off every value, which keeps digits. Series of at most ``length`` rows have no window. Each task sends one
    matrix of products by distance; the matrices are added up per pair of edges, not per row.
    """
    shape = shape or measure(df, station)
    placed = timeline.with_position(df.select(station, ts, *columns), station=station, ts=ts, shape=shape)
    placed = placed.filter(F.col(COUNT) > length)
    f, values = len(columns), F.array(*[F.col(c).cast("double") for c in columns])
    rows = placed.select(station, POS, COUNT, values.alias("x"))
    first = F.greatest(F.floor((F.col(POS) - length) / BLOCK), F.lit(0).cast("long"))
    blocks = _in_blocks(rows.withColumn("block", F.explode(F.sequence(first, F.floor(F.col(POS) / BLOCK)))), station)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((length + 1, f, f))
        for part in _each_block(batches, station):
            home = int((part[POS] // BLOCK == part["block"]).sum())
            total += lagged_products(np.array(part["x"].tolist()) - shift, home, length)
        yield pd.DataFrame({"m": [total.ravel().tolist()]})

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, sums, windows = np.zeros((length + 1, length + 1, f, f)), np.zeros((length + 1, f)), 0
        for b in batches:
            for n, found in zip(b["n"], b["rows"]):
                ordered = sorted((r["p"], r["x"]) for r in found)
                x = np.array([v for _, v in ordered]) - shift
                total += edge_products(x[:length], x[-length:])
                # Sums of a place: all rows but those before and after the rows it takes.
                lead = np.vstack([np.zeros(f), np.cumsum(x[:length], 0)])
                trail = np.vstack([np.cumsum(x[-length:][::-1], 0)[::-1], np.zeros(f)])
                sums += lead + trail
                windows += n - length
        yield pd.DataFrame({"m": [total.ravel().tolist()], "s": [sums.ravel().tolist()], "windows": [windows]})

    near = rows.filter((F.col(POS) < length) | (F.col(POS) >= F.col(COUNT) - length))
    ends = near.groupBy(station).agg(F.first(COUNT).alias("n"), F.collect_list(F.struct(F.col(POS).alias("p"), "x")).alias("rows"))
    added = [np.array(r["m"]).reshape(length + 1, f, f) for r in _summed(blocks.mapInPandas(add_up, "m array<double>"), ["m"])]
    cut = _summed(ends.mapInPandas(edges, "m array<double>, s array<double>, windows long"), ["m", "s"], "windows")
    whole = placed.agg(*[F.sum(F.col(c) - float(s)).alias(f"s{i}") for i, (c, s) in enumerate(zip(columns, shift))]).first()
    if not cut or not cut[0]["windows"]:
        return np.zeros(((length + 1) * f + 1,) * 2), 0
    windows, size = int(cut[0]["windows"]), (length + 1) * f
    out = np.zeros((length + 1, f, length + 1, f))
    wrong = np.array(cut[0]["m"]).reshape(length + 1, length + 1, f, f)
    for i in range(length + 1):
        for j in range(i, length + 1):
            out[i, :, j, :] = added[0][j - i] - wrong[i, j]
            out[j, :, i, :] = out[i, :, j, :].T
    full = np.zeros((size + 1, size + 1))
    full[:size, :size] = out.reshape(size, size)
    sums = np.array([whole[f"s{i}"] for i in range(f)])[None, :] - np.array(cut[0]["s"]).reshape(length + 1, f)
    full[:size, size] = full[size, :size] = sums.ravel()
    full[size, size] = windows
    return full, windows


def _in_blocks(spread: DataFrame, station: str) -> DataFrame:
    return spread.repartition(station, "block").sortWithinPartitions(station, "block", POS)


def _each_block(batches: Iterator[pd.DataFrame], station: str) -> Iterator[pd.DataFrame]:
    """The rows of one block after the other; a block may go over the edges of batches."""
    held, key = [], None
    for b in batches:
        change = (b[station] != b[station].shift()) | (b["block"] != b["block"].shift())
        for _, part in b.groupby(change.cumsum().to_numpy(), sort=False):
            now = (part[station].iloc[0], part["block"].iloc[0])
            if held and now != key:
                yield pd.concat(held)
                held = []
            key = now
            held.append(part)
    if held:
        yield pd.concat(held)


def predicted(df: DataFrame, models: dict[str, tuple[np.ndarray, float]], length: int, features: Sequence[str] = tuple(TARGETS), *, keep: Sequence[str] = (), station=STATION, ts=TS, shape: Shape | None = None) -> DataFrame:
    """station, ts, ``keep``, target, actual, prediction of every row with ``length`` complete rows before it.

    ``models`` is what ``fit_windows`` gives. Blocks carry the ``length`` rows before them; a window is a view of the block's array.
    """
    targets = list(models)
    columns = list(dict.fromkeys([*features, *targets]))
    coefs = np.stack([np.reshape(models[t][0], (length, len(features))) for t in targets], 2)
    intercepts = np.array([models[t][1] for t in targets])
    full = df.select(station, ts, *keep, *columns).dropna(subset=columns)
    placed = timeline.with_position(full, station=station, ts=ts, shape=shape or measure(full, station))
    here, last = F.floor(F.col(POS) / BLOCK), F.floor((F.col(COUNT) - 1) / BLOCK)
    until = F.least(F.floor((F.col(POS) + length) / BLOCK), last)
    blocks = _in_blocks(placed.withColumn("block", F.explode(F.sequence(here, until))), station)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _each_block(batches, station):
            x = part[list(features)].to_numpy(float)
            if len(x) <= length:
                continue
            # One window per row from the first that has all its rows; the last window would be of a row that is not there.
            views = np.lib.stride_tricks.sliding_window_view(x, length, axis=0)[:-1]
            found = np.einsum("nfl,lft->nt", views, coefs, optimize=True) + intercepts
            rows = part.iloc[length:]
            own = (rows[POS] // BLOCK == rows["block"]).to_numpy()
            for i, t in enumerate(targets):
                out = rows.loc[own, [station, ts, *keep]].assign(target=t, actual=rows.loc[own, t].astype(float), prediction=found[own, i])
                yield out

    kinds = dict(placed.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (station, ts, *keep)) + ", target string, actual double, prediction double"
    return blocks.mapInPandas(run, schema)


def _summed(parts: DataFrame, arrays: list[str], count: str | None = None) -> list:
    """Element-wise sums of array columns over all rows: one row per task, added place by place."""
    pieces = []
    for a in arrays:
        at = parts.select(F.posexplode(a).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
        pieces.append(at.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias(a)))
    out = {a: (p.first() or {a: None})[a] for a, p in zip(arrays, pieces)}
    if any(not v for v in out.values()):
        return []
    if count:
        out[count] = parts.agg(F.sum(count).alias("n")).first()["n"]
    return [out]


def fit_windows(df: DataFrame, length: int = 168, features: Sequence[str] = tuple(TARGETS), targets: Sequence[str] = tuple(TARGETS), *, reg: float = 0.1, station=STATION, ts=TS, shape: Shape | None = None) -> dict[str, tuple[np.ndarray, float]]:
    """Per target (coefficients, intercept) of the ridge regression of the next row on the window, oldest row first.

    Rows with a null feature or target take no part. Equal to ``forest.mdl_window_reg`` on ``forest.window_frame``. Without any
    window there is no model.
    """
    columns = list(dict.fromkeys([*features, *targets]))
    full = df.dropna(subset=columns)
    means = full.agg(*[F.avg(c).alias(c) for c in columns]).first()
    if means[columns[0]] is None:
        return {}
    shift = np.array([means[c] for c in columns])
    m, windows = window_moments(full, length, columns, shift, station=station, ts=ts, shape=shape)
    if not windows:
        return {}
    place = {c: i for i, c in enumerate(columns)}
    used = [i * len(columns) + place[c] for i in range(length) for c in features]
    out = {}
    for t in targets:
        at = [*used, length * len(columns) + place[t], len(m) - 1]
        coefs, intercept = ridge(m[np.ix_(at, at)], reg)
        out[t] = (coefs, float(intercept + shift[place[t]] - coefs @ np.tile(shift[[place[c] for c in features]], length)))
    return out
