"""Products of a series with itself some rows earlier, for many lags in one pass and a plan whose width does not grow with them.

Equal blocks of rows, each with the rows of the next ones that its lags reach, are multiplied inside a task (by FFT where there are many
lags); blocks of one series add up in the task and then by lag. Regressions on lagged rows follow from these sums, less the products
at both ends of the series that a regression leaves out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wxspark.operators import timeline
from wxspark.operators.timeline import COUNT, POS, Shape
from wxspark.operators.windowed import _each_block, _in_blocks, edge_products, lagged_products
from wxspark.schema import STATION, TS

#: Rows of a block.
BLOCK = 8192
#: From this many lags on the products are taken by FFT.
MANY = 64


def block_products(x: np.ndarray, home: int, lags: int) -> np.ndarray:
    """sum over u < ``home`` of x(u) x(u + k)^T for k = 0..lags, as (lags + 1, f, f); rows past the end count as 0."""
    if lags < MANY:
        return lagged_products(x, home, lags)
    size = 1 << (home + lags).bit_length()
    here, there = np.fft.rfft(x[:home], size, axis=0), np.fft.rfft(x[: home + lags], size, axis=0)
    return np.fft.irfft(np.conj(here)[:, :, None] * there[:, None, :], size, axis=0)[: lags + 1]


def with_steps(y: np.ndarray) -> np.ndarray:
    """Rows (value before, step to the next value)."""
    return np.column_stack([y[:-1], np.diff(y)])


def lag_products(df: DataFrame, value: str, lags: int, *, steps: bool = False, station=STATION, ts=TS, shape: Shape | None = None, block: int = BLOCK) -> DataFrame:
    """station, products: sums of x(u) x(u + k)^T over the whole series, flat by lag 0..lags.

    x is ``value`` itself or, with ``steps``, the pair of the value before and the step from it. Values should be centred, which keeps
    digits; they may not be null. Every series of the table has a row, unless ``steps`` finds a single value in it.
    """
    placed = timeline.with_position(df.select(station, ts, value), station=station, ts=ts, shape=shape)
    more = int(steps)
    first = F.greatest(F.floor((F.col(POS) - more - lags) / block), F.lit(0).cast("long"))
    last = F.floor(F.col(POS) / block)
    rows = placed.select(station, POS, F.col(value).cast("double").alias("y"), F.explode(F.sequence(first, last)).alias("block"))

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = None, None
        for part in _each_block(batches, station):
            key = part[station].iloc[0]
            if total is not None and key != held:
                yield pd.DataFrame({"station": [held], "g": [total.ravel().tolist()]})
                total = None
            y = part["y"].to_numpy()
            x = with_steps(y) if steps else y[:, None]
            home = min(len(x), block)
            # The last value of a series may stand alone in its block: it has no step.
            if home:
                g = block_products(x, home, lags)
                held, total = key, g if total is None else total + g
        if total is not None:
            yield pd.DataFrame({"station": [held], "g": [total.ravel().tolist()]})

    kind = df.schema[station].dataType.simpleString()
    parts = _in_blocks(rows, station).mapInPandas(add_up, f"station {kind}, g array<double>")
    by_lag = parts.select(F.col("station").alias(station), F.posexplode("g")).groupBy(station, "pos").agg(F.sum("col").alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return by_lag.groupBy(station).agg(F.transform(ordered, lambda r: r["v"]).alias("products"))


def series_ends(df: DataFrame, value: str, reach: int, *, station=STATION, ts=TS, shape: Shape | None = None) -> DataFrame:
    """station, rows, head, tail: the number of values, the first and the last ``reach`` + 1 of them in order (all, if fewer)."""
    placed = timeline.with_position(df.select(station, ts, value), station=station, ts=ts, shape=shape)
    near = placed.filter((F.col(POS) <= reach) | (F.col(POS) >= F.col(COUNT) - 1 - reach))
    one = F.struct(F.col(POS).alias("p"), F.col(value).cast("double").alias("y"))
    pick = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, one))), lambda r: r["y"])
    return near.groupBy(station).agg(
        F.first(COUNT).alias("rows"), pick(F.col(POS) <= reach).alias("head"), pick(F.col(POS) >= F.col(COUNT) - 1 - reach).alias("tail")
    )


def step_moments(products: np.ndarray, head: np.ndarray, tail: np.ndarray, rows: int, lags: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Means and covariances of (step, value before, steps 1..lags rows earlier) over all rows that have ``lags`` earlier steps.

    ``products`` are the sums of ``lag_products`` with steps for at least ``lags`` lags; ``head`` and ``tail`` the first and last values, at
    least ``lags`` + 1 of each.
    """
    n = rows - 1 - lags
    first, last = with_steps(head[: lags + 1]), with_steps(tail[len(tail) - lags - 1 :])
    wrong = edge_products(first, last)
    # Place of the window and column of x for every variable.
    at = [(lags, 1), (lags, 0), *[(lags - k, 1) for k in range(1, lags + 1)]]
    m = np.empty((len(at), len(at)))
    for a, (i, f) in enumerate(at):
        for b, (j, g) in enumerate(at[: a + 1]):
            (i0, f0), (j0, g0) = sorted([(i, f), (j, g)], key=lambda v: v[0])
            m[a, b] = m[b, a] = products[j0 - i0, f0, g0] - wrong[i0, j0, f0, g0]
    # Steps of a place telescope to two values of the ends; values before are summed by the caller's centring.
    steps = [tail[len(tail) - 1 - k] - head[lags - k] for k in range(lags + 1)]
    levels = -tail[-1] - head[:lags].sum()
    mean = np.array([steps[0], levels, *steps[1:]]) / n
    return mean, m / n - np.outer(mean, mean), n
