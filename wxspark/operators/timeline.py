"""Ordered row windows over series of any length.

Every row-based operator (lags, rolling statistics, sequences, carried labels, cumulative sums) is a window over one
station in time order. A window partition is one task, so a station holding a third of all rows would be one task with
a third of the data. ``measure`` looks at the series lengths once (a two-column scan with map-side combine) and the
helpers then pick one of two plans with equal results:

* short series: ``partitionBy(station)``, one shuffle and one sort;
* long series: exact row positions from time chunks (local ranks plus prefix sums of the chunk counts), then blocks of
  equal row count that carry copies of the few rows a frame reaches across a block edge. Every task is bounded by the
  block size, and values carried over whole blocks travel in a table of one row per block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

MAX_SERIES_ROWS = 1_000_000
MAX_SMALL_CELLS = 2_000_000
BLOCK_ROWS = 100_000
CHUNK_DAYS = 32
# Rows per key up to which the engine cuts before a shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000

POS, COUNT = "_pos", "_n"
_CHUNK, _BLOCK, _HOME = "_chunk", "_block", "_home"


@dataclass(frozen=True)
class Shape:
    """How many series there are, how long the longest is, and how long a block may be."""

    series: int
    longest: int
    max_rows: int = MAX_SERIES_ROWS
    block_rows: int = BLOCK_ROWS
    chunk_days: int = CHUNK_DAYS

    @property
    def whole(self) -> bool:
        return self.longest <= self.max_rows


def measure(df: DataFrame, station: str | Sequence[str] = "station") -> Shape:
    """Count the series and the rows of the longest one; one scalar row reaches the driver."""
    keys = [station] if isinstance(station, str) else list(station)
    row = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("c"))
        .agg(F.count(F.lit(1)).alias("series"), F.coalesce(F.max("c"), F.lit(0)).alias("longest"))
        .first()
    )
    return Shape(row["series"], row["longest"])


def join_small(
    big: DataFrame, small: DataFrame, on: Sequence[str], rows: int | None, how: str = "left", *, per_row: int | None = None
) -> DataFrame:
    """Equi join that broadcasts ``small`` only under a size bound: ``rows`` is a checked upper bound of its rows (None
    if unknown) and ``per_row`` the values in a row (default: its columns). Beyond it a shuffle join, which adaptive
    execution may split by skew."""
    fits = rows is not None and rows * (per_row or len(small.columns)) <= MAX_SMALL_CELLS
    return big.join(F.broadcast(small) if fits else small, list(on), how)


def count_small(df: DataFrame, limit: int = MAX_SMALL_CELLS) -> int | None:
    """Number of rows, or None above ``limit``."""
    n = df.count()
    return n if n <= limit else None


def newest(df: DataFrame, keep: int, *, keys: Sequence[str] = ("station",), ts: str = "ts") -> DataFrame:
    """The last ``keep`` rows of every key. Each task first keeps only its own newest rows, so a long series sends
    ``keep`` rows per task to the shuffle instead of all of them.

    The engine does so up to GROUP_LIMIT rows. For more, row counts of time chunks tell which chunks hold them, and
    only rows of those chunks are ranked: at most ``keep`` and one chunk per key.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(ts))
    if keep > GROUP_LIMIT:
        chunk = F.floor(F.unix_date(F.to_date(ts)) / CHUNK_DAYS)
        later = Window.partitionBy(*keys).orderBy(F.col(_CHUNK).desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
        counts = df.groupBy(*keys, chunk.alias(_CHUNK)).agg(F.count(F.lit(1)).alias("_c"))
        needed = counts.withColumn("_later", F.coalesce(F.sum("_c").over(later), F.lit(0))).filter(F.col("_later") < keep)
        needed = needed.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col(_CHUNK).alias("_needed"))
        same = chunk.eqNullSafe(F.col("_needed"))
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
        df = df.join(needed, same, "left_semi")
    return df.withColumn("_newest", F.row_number().over(w)).filter(F.col("_newest") <= keep).drop("_newest")


def with_position(
    df: DataFrame, *, station: str = "station", ts: str = "ts", shape: Shape | None = None
) -> DataFrame:
    """Add ``_pos`` (0-based row position in the series) and ``_n`` (rows in the series)."""
    if POS in df.columns:
        return df
    shape = shape or measure(df, station)
    if shape.whole:
        w = Window.partitionBy(station)
        return df.withColumns(
            {
                POS: (F.row_number().over(w.orderBy(ts)) - 1).cast("long"),
                COUNT: F.count(F.lit(1)).over(w),
            }
        )
    chunked = df.withColumn(_CHUNK, F.floor(F.unix_date(F.to_date(ts)) / shape.chunk_days))
    counts = chunked.groupBy(station, _CHUNK).agg(F.count(F.lit(1)).alias("_c"))
    by_chunk = Window.partitionBy(station).orderBy(_CHUNK)
    offsets = counts.select(
        station,
        _CHUNK,
        (F.sum("_c").over(by_chunk) - F.col("_c")).alias("_off"),
        F.sum("_c").over(Window.partitionBy(station)).alias(COUNT),
    )
    local = chunked.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(station, _CHUNK).orderBy(ts)).cast("long")
    )
    return (
        local.join(offsets, [station, _CHUNK])
        .withColumn(POS, F.col("_off") + F.col("_rn") - 1)
        .drop(_CHUNK, "_off", "_rn")
    )


@dataclass(frozen=True)
class Frames:
    """A frame ready for row windows: ``window`` is the specification, ``close`` removes the helper rows and columns."""

    df: DataFrame
    keys: list[str]
    window: WindowSpec
    station: str
    blocked: bool
    _drop: tuple[str, ...]

    def close(self, df: DataFrame) -> DataFrame:
        if self.blocked:
            df = df.filter(F.col(_HOME))
        return df.drop(*self._drop)


def frames(
    df: DataFrame,
    *,
    back: int = 0,
    ahead: int = 0,
    station: str = "station",
    ts: str = "ts",
    shape: Shape | None = None,
    keep_position: bool = False,
) -> Frames:
    """Prepare windows that look at most ``back`` rows before and ``ahead`` rows after each row."""
    shape = shape or measure(df, station)
    had = POS in df.columns
    if shape.whole:
        if keep_position:
            df = with_position(df, station=station, ts=ts, shape=shape)
        order = POS if POS in df.columns else ts
        return Frames(df, [station], Window.partitionBy(station).orderBy(order), station, False, ())
    pos = with_position(df, station=station, ts=ts, shape=shape)
    size = shape.block_rows
    first = F.greatest(F.floor((F.col(POS) - ahead) / size), F.lit(0).cast("long"))
    last = F.least(F.floor((F.col(POS) + back) / size), F.floor((F.col(COUNT) - 1) / size))
    spread = pos.withColumn(_BLOCK, F.explode(F.sequence(first, last)))
    spread = spread.withColumn(_HOME, F.col(_BLOCK) == F.floor(F.col(POS) / size))
    drop = (_BLOCK, _HOME) if (had or keep_position) else (_BLOCK, _HOME, POS, COUNT)
    return Frames(
        spread, [station, _BLOCK], Window.partitionBy(station, _BLOCK).orderBy(POS), station, True, drop
    )


def over_rows(
    df: DataFrame,
    columns: Callable[[WindowSpec], dict[str, Column]],
    *,
    back: int = 0,
    ahead: int = 0,
    station: str = "station",
    ts: str = "ts",
    shape: Shape | None = None,
) -> DataFrame:
    """Add window columns whose frames reach at most ``back`` and ``ahead`` rows."""
    fr = frames(df, back=back, ahead=ahead, station=station, ts=ts, shape=shape)
    return fr.close(fr.df.withColumns(columns(fr.window)))


def known_neighbours(
    df: DataFrame, values: Sequence[str], *, station: str = "station", ts: str = "ts", shape: Shape | None = None
) -> DataFrame:
    """For each column ``c`` add ``c_prev`` and ``c_next``: structs (p, v) of the nearest known value at or before and
    at or after each row. Adds ``_pos`` and ``_n`` as well."""
    fr = frames(df, station=station, ts=ts, shape=shape, keep_position=True)
    # Looking ahead is a running frame over the reversed order: a frame that ends at the last row would be evaluated
    # anew for every row, which is quadratic in the length of the partition.
    up = fr.window.rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*fr.keys).orderBy(F.desc(POS)).rowsBetween(Window.unboundedPreceding, 0)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(POS).alias("p"), F.col(c).alias("v"))) for c in values}
    if not fr.blocked:
        out = {f"{c}_prev": F.last(k, ignorenulls=True).over(up) for c, k in known.items()}
        out |= {f"{c}_next": F.last(k, ignorenulls=True).over(down) for c, k in known.items()}
        return fr.df.withColumns(out)
    edges = fr.df.groupBy(*fr.keys).agg(
        *[F.max(k).alias(f"{c}_hi") for c, k in known.items()],
        *[F.min(k).alias(f"{c}_lo") for c, k in known.items()],
    )
    by_block = Window.partitionBy(station).orderBy(_BLOCK)
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(station).orderBy(F.desc(_BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *fr.keys,
        *[F.last(f"{c}_hi", ignorenulls=True).over(before).alias(f"{c}_in") for c in values],
        *[F.last(f"{c}_lo", ignorenulls=True).over(after).alias(f"{c}_out") for c in values],
    )
    both = fr.df.join(carried, fr.keys)
    out = {f"{c}_prev": F.coalesce(F.last(k, ignorenulls=True).over(up), F.col(f"{c}_in")) for c, k in known.items()}
    out |= {
        f"{c}_next": F.coalesce(F.last(k, ignorenulls=True).over(down), F.col(f"{c}_out")) for c, k in known.items()
    }
    return fr.close(both.withColumns(out).drop(*[f"{c}_in" for c in values], *[f"{c}_out" for c in values]))


def running_sum(
    df: DataFrame, value: str, name: str, *, station: str = "station", ts: str = "ts", shape: Shape | None = None
) -> DataFrame:
    """Cumulative sum in time order."""
    fr = frames(df, station=station, ts=ts, shape=shape)
    up = fr.window.rowsBetween(Window.unboundedPreceding, 0)
    if not fr.blocked:
        return fr.df.withColumn(name, F.sum(value).over(up))
    sums = fr.df.groupBy(*fr.keys).agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(station).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*fr.keys, F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_in"))
    out = fr.df.join(carried, fr.keys).withColumn(name, F.sum(value).over(up) + F.col("_in")).drop("_in")
    return fr.close(out)


def sort_ts(df: DataFrame, *, station: str = "station", ts: str = "ts") -> DataFrame:
    """Order for output only; windows carry their own order."""
    return df.orderBy(station, ts)
