"""Splits, folds, sequences and bounded histories by row position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wxspark.operators import timeline
from wxspark.operators.timeline import COUNT, POS, Shape
from wxspark.schema import STATION, TARGETS, TS


def _int(x):
    return F.floor(x).cast("long")


def win_split(
    df, *, station=STATION, ts=TS, test_size: float = 0.2, validation_size: float = 0.1, shape: Shape | None = None
) -> DataFrame:
    """Add ``role``: train, validation, test, in time order."""
    p = timeline.with_position(df, station=station, ts=ts, shape=shape)
    n = F.col(COUNT)
    role = (
        F.when(F.col(POS) < _int(n * (1 - test_size - validation_size)), "train")
        .when(F.col(POS) < _int(n * (1 - test_size)), "validation")
        .otherwise("test")
    )
    return p.withColumn("role", role).drop(POS, COUNT)


def win_split_frac(
    df, *, station=STATION, ts=TS, train: float = 0.8, validation: float = 0.1, shape: Shape | None = None
) -> DataFrame:
    """First ``train`` share, then ``validation`` share, rest unused (empty when they add to one)."""
    p = timeline.with_position(df, station=station, ts=ts, shape=shape)
    n = F.col(COUNT)
    cut = _int(n * train)
    role = (
        F.when(F.col(POS) < cut, "train").when(F.col(POS) < cut + _int(n * validation), "validation").otherwise("rest")
    )
    return p.withColumn("role", role).drop(POS, COUNT)


def win_cv_folds(df, *, station=STATION, ts=TS, n_splits: int = 5, shape: Shape | None = None) -> DataFrame:
    """Expanding folds: every row once per fold that uses it, with ``fold`` and ``role``.

    A row joins the folds after its own part as training data, so the frame grows by about n_splits / 2.
    """
    p = timeline.with_position(df, station=station, ts=ts, shape=shape)
    size = F.floor(F.col(COUNT) / (n_splits + 1))
    part = F.when(size > 0, F.floor(F.col(POS) / size))
    # part 0 trains in every fold; part i (1..k) validates in fold i-1 and trains later; the remainder is unused.
    first = F.greatest(part - 1, F.lit(0).cast("long"))
    folds = F.when(part <= n_splits, F.sequence(first, F.lit(n_splits - 1).cast("long")))
    out = p.withColumn("_part", part).withColumn("fold", F.explode(folds))
    role = F.when(F.col("_part") == F.col("fold") + 1, "validation").otherwise("train")
    return out.withColumns({"role": role, "fold": F.col("fold").cast("int")}).drop("_part", POS, COUNT)


def win_sequences(
    df, *, station=STATION, ts=TS, length: int = 168, features: Sequence[str] = tuple(TARGETS),
    targets: Sequence[str] = tuple(TARGETS), shape: Shape | None = None,
) -> DataFrame:
    """Every run of ``length`` rows (``window``: array of feature arrays) with the next row's targets as ``next_*``."""
    def cols(w):
        run = w.rowsBetween(0, length - 1)
        step = F.array(*[F.col(c).cast("double") for c in features])
        out = {"window": F.collect_list(step).over(run)}
        out |= {f"next_{t}": F.lead(t, length).over(w) for t in targets}
        out["_full"] = F.lead(F.lit(1), length).over(w)
        return out

    wide = timeline.over_rows(df, cols, ahead=length, station=station, ts=ts, shape=shape)
    return wide.filter(F.col("_full").isNotNull()).select(station, ts, "window", *[f"next_{t}" for t in targets])


def win_sequences_predict(
    df, *, station=STATION, ts=TS, length: int = 168, features: Sequence[str] = tuple(TARGETS), last_only: bool = False,
    shape: Shape | None = None,
) -> DataFrame:
    """Every full run of ``length`` rows; ``last_only`` keeps the newest one of each series."""
    shape = shape or timeline.measure(df, station)
    if last_only:
        df = timeline.newest(df, length, keys=[station], ts=ts)
        shape = timeline.Shape(shape.series, length)

    def cols(w):
        step = F.array(*[F.col(c).cast("double") for c in features])
        return {"window": F.collect_list(step).over(w.rowsBetween(0, length - 1))}

    wide = timeline.over_rows(df, cols, ahead=length - 1, station=station, ts=ts, shape=shape)
    return wide.filter(F.size("window") == length).select(station, ts, "window")


def win_history_bound(df, *, keys: Sequence[str] = (STATION,), ts=TS, keep: int = 100) -> DataFrame:
    """The last ``keep`` rows of every key."""
    return timeline.newest(df, keep, keys=keys, ts=ts)


def latest_row(df, *, station=STATION, ts=TS) -> DataFrame:
    """Newest row per series by aggregation, without sorting the series."""
    rest = [c for c in df.columns if c != station]
    return df.groupBy(station).agg(F.max_by(F.struct(*rest), ts).alias("_r")).select(station, "_r.*")


def pad_recent(df, current: DataFrame, *, station=STATION, ts=TS, need: int = 24) -> DataFrame:
    """Series with fewer than ``need`` recent rows become the current row repeated ``need`` times (``copy`` numbers
    them); the others pass with ``copy`` null."""
    counts = df.groupBy(station).agg(F.count(F.lit(1)).alias("_c"))
    state = current.select(station).join(counts, station, "left").withColumn("_c", F.coalesce("_c", F.lit(0)))
    short = state.filter(F.col("_c") < need).select(station)
    n = timeline.measure(current, station).series
    kept = timeline.join_small(df, short, [station], n, "left_anti").withColumn("copy", F.lit(None).cast("int"))
    padded = current.join(short, station, "left_semi").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(need))))
    return kept.unionByName(padded.select(*kept.columns))
