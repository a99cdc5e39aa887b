"""Missing values, outliers, scaling. Parameters are fitted per station into a small frame and joined back."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wxspark.operators import timeline
from wxspark.operators.timeline import Shape, join_small, measure
from wxspark.schema import BASE, STATION, TARGETS, TS

SKETCH_ACCURACY = 20_000
MAX_GROUP_VALUES = 5_000_000
SKETCH_COLUMNS = 16
WIDE_COLUMNS = 32


def _name(column: str, p: float) -> str:
    return f"{column}__q{round(p * 1000)}"


def station_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    *,
    station: str = STATION,
    shape: Shape | None = None,
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """Exact linear quantiles per station, one row per station, columns ``{c}__q{1000p}``.

    Series of checked length go through the exact percentile aggregate, as many columns at a time as one task may hold.
    A longer series would keep too many distinct values in one task, so there a mergeable sketch brackets each order
    statistic first and only the rows inside the bracket are counted by value.
    """
    shape = shape or measure(df, station)
    columns = list(columns)
    size = MAX_GROUP_VALUES // max(shape.longest, 1) if shape.whole else SKETCH_COLUMNS
    exact, size = shape.whole and size > 0, max(size, 1)
    parts = []
    for i in range(0, len(columns), size):
        some = columns[i : i + size]
        if exact:
            parts.append(
                df.groupBy(station).agg(
                    *[F.expr(f"percentile(`{c}`, {float(p)}D) AS `{_name(c, p)}`") for c in some for p in probs]
                )
            )
        else:
            parts.append(_bracketed(df, some, probs, station, accuracy, shape))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, station)
    return out


def _bracketed(df, columns, probs, station, accuracy, shape) -> DataFrame:
    margin = 2.0 / accuracy
    sketch = df.groupBy(station).agg(
        *[
            F.percentile_approx(
                c, [max(0.0, p - margin), min(1.0, p + margin)], accuracy
            ).alias(f"{_name(c, p)}_b")
            for c in columns
            for p in probs
        ]
    )
    marked = join_small(df.select(station, *columns), sketch, [station], shape.series)
    edge_aggs, picks = [], []
    for c in columns:
        for p in probs:
            n = _name(c, p)
            lo, hi, x = F.col(f"{n}_b")[0], F.col(f"{n}_b")[1], F.col(c)
            edge_aggs.append(
                F.struct(
                    F.lit(n).alias("q"),
                    F.lit(float(p)).alias("p"),
                    F.count(x).alias("n"),
                    F.count_if(x < lo).alias("below"),
                    F.max(F.when(x < lo, x)).alias("under"),
                    F.min(F.when(x > hi, x)).alias("over"),
                    F.count_if(x > hi).alias("above"),
                )
            )
            picks.append(F.when(x.between(lo, hi), F.struct(F.lit(n).alias("q"), x.alias("v"))))
    edges = marked.groupBy(station).agg(F.array(*edge_aggs).alias("e")).select(station, F.inline("e"))
    inside = (
        marked.select(station, F.explode(F.filter(F.array(*picks), lambda s: s.isNotNull())).alias("s"))
        .groupBy(station, F.col("s.q").alias("q"), F.col("s.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    # The neighbours just outside the bracket close it, whatever the sketch error did to its ends.
    outer = edges.select(
        station,
        "q",
        F.explode(
            F.array(
                F.struct(F.col("under").alias("v"), F.least("below", F.lit(1)).alias("c")),
                F.struct(F.col("over").alias("v"), F.least("above", F.lit(1)).alias("c")),
            )
        ).alias("s"),
    ).select(station, "q", "s.v", "s.c").filter("c > 0")
    w = Window.partitionBy(station, "q").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        inside.unionByName(outer)
        .withColumn("cum", F.sum("c").over(w))
        .join(edges.select(station, "q", "p", "n", "below"), [station, "q"])
        .withColumn("end", F.col("below") - F.least("below", F.lit(1)) + F.col("cum"))
        .withColumn("start", F.col("end") - F.col("c"))
        .withColumn("at", (F.col("n") - 1) * F.col("p"))
        .withColumn("k", F.floor("at"))
    )
    here = ranked.groupBy(station, "q").agg(
        F.max("at").alias("at"),
        F.max("k").alias("k"),
        F.max(F.when((F.col("start") <= F.col("k")) & (F.col("k") < F.col("end")), F.col("v"))).alias("v0"),
        F.max(F.when((F.col("start") <= F.col("k") + 1) & (F.col("k") + 1 < F.col("end")), F.col("v"))).alias("v1"),
    )
    value = F.col("v0") + (F.coalesce("v1", "v0") - F.col("v0")) * (F.col("at") - F.col("k"))
    names = [_name(c, p) for c in columns for p in probs]
    return here.groupBy(station).agg(*[F.max(F.when(F.col("q") == n, value)).alias(n) for n in names])


def fit_medians(df, columns, *, station=STATION, shape: Shape | None = None) -> DataFrame:
    return station_quantiles(df, columns, [0.5], station=station, shape=shape)


def cl_impute_median(
    df, *, station=STATION, ts=TS, columns: Sequence[str] = tuple(BASE), params: DataFrame | None = None,
    shape: Shape | None = None,
) -> DataFrame:
    """Nulls become the station median (of ``params`` when given, so that prediction uses the training medians).
    A column without any value stays null."""
    shape = shape or measure(df, station)
    params = fit_medians(df, columns, station=station, shape=shape) if params is None else params
    names = {c: _name(c, 0.5) for c in columns}
    out = join_small(df, params.select(station, *names.values()), [station], shape.series)
    return out.withColumns({c: F.coalesce(F.col(c), F.col(n)) for c, n in names.items()}).drop(*names.values())


def clip_bounds(df, columns, *, station=STATION, threshold=1.5, shape: Shape | None = None) -> DataFrame:
    q = station_quantiles(df, columns, [0.25, 0.75], station=station, shape=shape)
    out = []
    for c in columns:
        q1, q3 = F.col(_name(c, 0.25)), F.col(_name(c, 0.75))
        out += [(q1 - threshold * (q3 - q1)).alias(f"{c}__lo"), (q3 + threshold * (q3 - q1)).alias(f"{c}__hi")]
    return q.select(station, *out)


def cl_outlier_iqr(
    df, *, station=STATION, ts=TS, columns: Sequence[str] = tuple(BASE), threshold: float = 1.5,
    params: DataFrame | None = None, shape: Shape | None = None,
) -> DataFrame:
    """Clip to [Q1 - threshold*IQR, Q3 + threshold*IQR]."""
    shape = shape or measure(df, station)
    params = clip_bounds(df, columns, station=station, threshold=threshold, shape=shape) if params is None else params
    out = join_small(df, params, [station], shape.series)
    clipped = {
        c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"{c}__hi")), F.col(f"{c}__lo")))
        for c in columns
    }
    return out.withColumns(clipped).drop(*[f"{c}__{e}" for c in columns for e in ("lo", "hi")])


def cl_outlier_zscore(
    df, *, station=STATION, ts=TS, columns: Sequence[str] = tuple(BASE), threshold: float = 3.0, shape: Shape | None = None
) -> DataFrame:
    """Values more than ``threshold`` sample deviations from the mean become the median."""
    shape = shape or measure(df, station)
    moments = df.groupBy(station).agg(
        *[F.avg(c).alias(f"{c}__m") for c in columns], *[F.stddev_samp(c).alias(f"{c}__s") for c in columns]
    )
    medians = fit_medians(df, columns, station=station, shape=shape)
    out = join_small(df, moments.join(medians, station), [station], shape.series)
    fixed = {
        c: F.when(
            F.try_divide(F.abs(F.col(c) - F.col(f"{c}__m")), F.col(f"{c}__s")) > threshold, F.col(_name(c, 0.5))
        ).otherwise(F.col(c))
        for c in columns
    }
    return out.withColumns(fixed).drop(*[f"{c}__{e}" for c in columns for e in ("m", "s", "q500")])


def drop_nan_rows(df, columns: Sequence[str]) -> DataFrame:
    """Keep rows with a real value in every listed column."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.col(c).isNotNull() & ~F.isnan(c)
    return df.filter(keep)


def nan_to_num(df, columns: Sequence[str]) -> DataFrame:
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({c: F.when(bad(c), F.lit(0.0)).otherwise(F.col(c)) for c in columns})


# ---- scaling ------------------------------------------------------------------------------------------------------


def _per_column(df, columns: Sequence[str], center: str, scale: str, station: str) -> DataFrame:
    """Two aggregates per column as ``{c}__center`` and ``{c}__scale``.

    Hundreds of aggregate buffers in one row defeat code generation, so a wide frame is turned into (station, position,
    value) rows that combine on the map side; the result is one array per station again.
    """
    if len(columns) <= WIDE_COLUMNS:
        return df.groupBy(station).agg(
            *[F.expr(f"{center.format(f'`{c}`')} AS `{c}__center`") for c in columns],
            *[F.expr(f"{scale.format(f'`{c}`')} AS `{c}__scale`") for c in columns],
        )
    values = ", ".join(f"CAST(`{c}` AS DOUBLE)" for c in columns)
    long = df.selectExpr(station, f"posexplode(array({values})) AS (_i, _v)")
    each = long.groupBy(station, "_i").agg(F.expr(f"{center.format('_v')} AS c"), F.expr(f"{scale.format('_v')} AS s"))
    packed = each.groupBy(station).agg(F.array_sort(F.collect_list(F.struct("_i", "c", "s"))).alias("a"))
    return packed.selectExpr(
        station,
        *[f"a[{i}].c AS `{c}__center`" for i, c in enumerate(columns)],
        *[f"a[{i}].s AS `{c}__scale`" for i, c in enumerate(columns)],
    )


def fit_scaler(df, kind: str, columns: Sequence[str], *, station=STATION, shape: Shape | None = None) -> DataFrame:
    """One row per station with ``{c}__center`` and ``{c}__scale``; a zero scale counts as 1."""
    if kind == "standard":
        raw = _per_column(df, columns, "avg({0})", "stddev_pop({0})", station)
    elif kind == "minmax":
        raw = _per_column(df, columns, "min({0})", "max({0}) - min({0})", station)
    elif kind == "robust":
        q = station_quantiles(df, columns, [0.25, 0.5, 0.75], station=station, shape=shape)
        raw = q.select(
            station,
            *[F.col(_name(c, 0.5)).alias(f"{c}__center") for c in columns],
            *[(F.col(_name(c, 0.75)) - F.col(_name(c, 0.25))).alias(f"{c}__scale") for c in columns],
        )
    else:
        raise ValueError(f"unknown scaler: {kind}")
    # A constant column may keep a rounding residue; it counts as zero.
    one = (
        f"CASE WHEN `{c}__scale` <= 1e-12D * greatest(abs(`{c}__center`), 1.0D) THEN 1.0D ELSE `{c}__scale` END AS `{c}__scale`"
        for c in columns
    )
    return raw.selectExpr(station, *[f"`{c}__center`" for c in columns], *one)


def apply_scaler(df, params: DataFrame, columns: Sequence[str], *, station=STATION, rows: int | None = None, inverse=False) -> DataFrame:
    """Scale with fitted parameters; ``inverse`` brings forecasts back to physical units."""

    def scaled(c: str) -> Column:
        x, m, s = F.col(c), F.col(f"{c}__center"), F.col(f"{c}__scale")
        return x * s + m if inverse else (x - m) / s

    out = join_small(df, params, [station], rows)
    return out.withColumns({c: scaled(c) for c in columns}).drop(*[f"{c}__{e}" for c in columns for e in ("center", "scale")])


def _fit_apply(kind: str):
    def op(df, *, station=STATION, ts=TS, columns: Sequence[str] = tuple(TARGETS), params=None, shape=None) -> DataFrame:
        shape = shape or measure(df, station)
        params = fit_scaler(df, kind, columns, station=station, shape=shape) if params is None else params
        return apply_scaler(df, params, columns, station=station, rows=shape.series)

    op.__name__ = f"sca_{kind}"
    return op


sca_standard = _fit_apply("standard")
sca_minmax = _fit_apply("minmax")
sca_robust = _fit_apply("robust")


# ---- gaps ---------------------------------------------------------------------------------------------------------


def win_interpolate(
    df, *, station=STATION, ts=TS, columns: Sequence[str] = ("temperature",), shape: Shape | None = None
) -> DataFrame:
    """Linear by row position between known values, then the nearest known value at the ends."""
    near = timeline.known_neighbours(df, columns, station=station, ts=ts, shape=shape)
    pos = F.col(timeline.POS)

    def filled(c: str) -> Column:
        a, b = F.col(f"{c}_prev"), F.col(f"{c}_next")
        share = F.try_divide(pos - a["p"], b["p"] - a["p"])
        between = a["v"] + (b["v"] - a["v"]) * share
        return F.coalesce(F.col(c), between, b["v"], a["v"])

    out = near.withColumns({c: filled(c) for c in columns})
    return out.select(*df.columns)


def win_carry_label(
    df, *, station=STATION, ts=TS, label: str = "label", first: str = "VeryLow", shape: Shape | None = None
) -> DataFrame:
    """A missing label takes the previous one, or ``first`` at the start."""
    near = timeline.known_neighbours(df, [label], station=station, ts=ts, shape=shape)
    return near.withColumn(label, F.coalesce(F.col(f"{label}_prev")["v"], F.lit(first))).select(*df.columns)


def forced(shape: Shape, **changes) -> Shape:
    """A copy of a shape with other limits, to choose the long-series plan by hand."""
    return replace(shape, **changes)
