"""Profiles, stationarity, seasonality and autoregression of many series at once.

Regressions are fitted from moments: lag columns from one window pass, then one grouped aggregate of centred products
(``covar_pop`` combines on the map side and stays accurate far from zero). What remains per series is a k x k solve on
one row, done in Arrow batches. Series length never matters to the Python side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wxspark.operators import timeline
from wxspark.operators.lags import lag_products, series_ends, step_moments
from wxspark.operators.metrics import agg_metrics
from wxspark.operators.timeline import COUNT, POS, Shape, join_small, measure
from wxspark.schema import STATION, TARGETS, TS
from wxspark.session import stored

Z95 = 1.96


def agg_series_profile(df, *, target: str, station: str = STATION) -> DataFrame:
    return df.groupBy(station).agg(
        F.count(target).alias("length"), F.avg(target).alias("mean"), F.stddev_samp(target).alias("std")
    )


# ---- moments ------------------------------------------------------------------------------------------------------


NARROW = 8


def moments(df: DataFrame, variables: Sequence[str], *, station: str = STATION) -> DataFrame:
    """station, n, means[k], cov[k*(k+1)/2] (lower triangle by rows) over rows where all variables are known.

    A few variables stay native. Many would need hundreds of aggregate expressions, so there each Arrow batch is reduced
    to one row per series by a matrix product about its own means, and Spark moves those to the means of the series.
    """
    full = df.dropna(subset=list(variables))
    if len(variables) > NARROW:
        return _batched_moments(full.select(station, F.array(*[F.col(v).cast("double") for v in variables]).alias("x")), len(variables), station)
    pairs = [(a, b) for i, a in enumerate(variables) for b in variables[: i + 1]]
    return full.groupBy(station).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(v) for v in variables]).alias("means"),
        F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("cov"),
    )


def _batched_moments(vectors: DataFrame, k: int, station: str) -> DataFrame:
    kind = vectors.schema[station].dataType.simpleString()
    low = np.tril_indices(k)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, part in pdf.groupby(station, sort=False)["x"]:
                x = np.stack(part.to_numpy())
                mean = x.mean(axis=0)
                rows.append((key, len(x), mean, ((x - mean).T @ (x - mean))[low]))
            yield pd.DataFrame(rows, columns=[station, "n", "mean", "c"])

    def gathered(each: DataFrame, value: Column, name: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("pos", "v")))
        by_place = each.groupBy(station, "pos").agg(value.alias("v"), F.sum("n").alias("n"))
        return by_place.groupBy(station).agg(F.max("n").alias("n"), F.transform(ordered, lambda r: r["v"]).alias(name))

    # One small row per Arrow batch and series, read twice: for the means, then for products about them.
    parts = stored(vectors.mapInPandas(reduce, f"{station} {kind}, n long, mean array<double>, c array<double>"), "moments")
    means = gathered(parts.select(station, "n", F.posexplode("mean").alias("pos", "x")), F.sum(F.col("x") * F.col("n")) / F.sum("n"), "means")
    rows, cols = [F.array(*[F.lit(int(i)) for i in ix]) for ix in low]
    off = lambda ix, i: F.get("mean", F.get(ix, i)) - F.get("means", F.get(ix, i))
    about = F.transform("c", lambda v, i: v + F.col("n") * off(rows, i) * off(cols, i))
    cov = gathered(parts.join(means.drop("n"), station).select(station, "n", F.posexplode(about).alias("pos", "x")), F.sum("x") / F.sum("n"), "cov")
    return means.join(cov.drop("n"), station).select(station, "n", "means", "cov")


def _matrix(flat: np.ndarray, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    m[np.tril_indices(k)] = flat
    return m + np.tril(m, -1).T


def _regress(mean: np.ndarray, cov: np.ndarray, n: int, use: Sequence[int]) -> tuple[float, np.ndarray, float]:
    """(constant, slopes, squared error) of variable 0 on the variables in ``use``."""
    use = list(use)
    if not use:
        return float(mean[0]), np.zeros(0), float(n * cov[0, 0])
    slopes = np.linalg.lstsq(cov[np.ix_(use, use)], cov[use, 0], rcond=None)[0]
    sse = max(n * (cov[0, 0] - slopes @ cov[use, 0]), 0.0)
    return float(mean[0] - slopes @ mean[use]), slopes, float(sse)


def differenced(column: str, lag: int, d: int, w) -> Column:
    """The d-times differenced series, ``lag`` rows back."""
    signs = [(-1) ** j * math.comb(d, j) for j in range(d + 1)]
    at = lambda k: F.lag(column, k).over(w) if k else F.col(column)
    total = None
    for j, s in enumerate(signs):
        term = at(lag + j) * s
        total = term if total is None else total + term
    return total


# ---- autoregression -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ARConfig:
    p: int = 1
    d: int = 0
    season: int = 0
    seasonal_p: int = 0
    min_rows: int = 50
    station: str = STATION
    ts: str = TS

    @property
    def lags(self) -> list[int]:
        return [*range(1, self.p + 1), *(self.season * i for i in range(1, self.seasonal_p + 1))]

    @property
    def reach(self) -> int:
        """Rows a prediction looks back."""
        return max(self.lags, default=0) + self.d


AR_PARAMS = "station string, target string, n long, const double, level_coef array<double>, sigma double"


def mdl_ar(df, target: str, cfg: ARConfig = ARConfig(), *, shape: Shape | None = None) -> DataFrame:
    """Conditional least squares for every station: const, level_coef (on undifferenced lags 1..reach), sigma."""
    shape = shape or measure(df, cfg.station)
    names = ["_y", *[f"_l{k}" for k in cfg.lags]]

    def cols(w):
        return {n: differenced(target, k, cfg.d, w) for n, k in zip(names, [0, *cfg.lags])}

    base = df.select(cfg.station, cfg.ts, target)
    wide = timeline.over_rows(base, cols, back=max(cfg.reach, 1), station=cfg.station, ts=cfg.ts, shape=shape)
    lags, d, reach, low = cfg.lags, cfg.d, cfg.reach, cfg.min_rows
    k = len(names)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for station, n, mean, cov in zip(pdf["station"], pdf["n"], pdf["means"], pdf["cov"]):
                if n < max(low, k + 1):
                    continue
                const, slopes, sse = _regress(np.asarray(mean), _matrix(np.asarray(cov), k), n, range(1, k))
                poly = np.zeros(max(lags, default=0) + 1)
                poly[0] = 1.0
                for lag, s in zip(lags, slopes):
                    poly[lag] -= s
                for _ in range(d):
                    poly = np.convolve(poly, [1.0, -1.0])
                rows.append((station, target, int(n), const, (-poly[1 : reach + 1]).tolist(), math.sqrt(sse / n)))
            yield pd.DataFrame(rows, columns=["station", "target", "n", "const", "level_coef", "sigma"])

    m = moments(wide, names, station=cfg.station).withColumnRenamed(cfg.station, "station")
    return m.mapInPandas(solve, AR_PARAMS)


def recent_levels(df, target: str, depth: int, *, station=STATION, ts=TS) -> DataFrame:
    """station, last_ts, levels: the newest ``depth`` values, newest first."""
    recent = timeline.newest(df.select(station, ts, target).dropna(subset=[target]), depth, keys=[station], ts=ts)
    rows = F.sort_array(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(target).alias("v"))), asc=False)
    return recent.groupBy(F.col(station).alias("station")).agg(
        F.max(ts).alias("last_ts"), F.transform(rows, lambda r: r["v"]).alias("levels")
    )


def _step(levels: Column) -> Column:
    terms = F.zip_with(F.col("level_coef"), levels, lambda a, x: a * x)
    return F.aggregate(terms, F.col("const"), lambda acc, t: acc + t)


def mdl_ar_predict(df, params: DataFrame, target: str, cfg: ARConfig = ARConfig()) -> DataFrame:
    """One step ahead; 0.0 for a station without a model."""
    levels = recent_levels(df, target, max(cfg.reach, 1), station=cfg.station, ts=cfg.ts)
    joined = levels.join(params.filter(F.col("target") == target).drop("target"), "station", "left")
    point = _step(F.slice("levels", F.lit(1), F.lit(max(cfg.reach, 1))))
    return joined.select("station", F.lit(target).alias("target"), "last_ts", F.coalesce(point, F.lit(0.0)).alias("prediction"))


def mdl_multi_step(df, params: DataFrame, target: str, steps: int, cfg: ARConfig = ARConfig()) -> DataFrame:
    """Recursive forecast: each prediction becomes the newest level of the next step. One native fold per station."""
    depth = max(cfg.reach, 1)
    levels = recent_levels(df, target, depth, station=cfg.station, ts=cfg.ts)
    joined = levels.join(params.filter(F.col("target") == target).drop("target"), "station")
    start = F.struct(F.col("levels").alias("lv"), F.array().cast("array<double>").alias("out"))

    def advance(acc, _):
        nxt = _step(acc["lv"])
        lv = F.slice(F.concat(F.array(nxt), acc["lv"]), 1, depth)
        return F.struct(lv.alias("lv"), F.concat(acc["out"], F.array(nxt)).alias("out"))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, advance, lambda acc: acc["out"])
    return joined.select("station", F.lit(target).alias("target"), "last_ts", F.posexplode(path).alias("i", "prediction")).select(
        "station", "target", "last_ts", (F.col("i") + 1).alias("step"), "prediction"
    )


def mdl_ar_interval(
    df, params: DataFrame, target: str, cfg: ARConfig = ARConfig(), *, steps: int = 1
) -> DataFrame:
    """95 percent interval: point +- 1.96 * sigma * sqrt(sum of squared impulse responses)."""
    points = mdl_multi_step(df, params, target, steps, cfg)
    depth = max(cfg.reach, 1)
    zero = F.array(*[F.lit(0.0)] * depth)
    # Impulse responses follow the same recursion, started by a unit shock and without the constant.
    start = F.struct(
        F.slice(F.concat(F.array(F.lit(1.0)), zero), 1, depth).alias("lv"), F.array(F.lit(1.0)).alias("sums")
    )

    def advance(acc, _):
        psi = F.aggregate(F.zip_with(F.col("level_coef"), acc["lv"], lambda a, x: a * x), F.lit(0.0), lambda s, t: s + t)
        total = F.element_at(acc["sums"], -1) + psi * psi
        lv = F.slice(F.concat(F.array(psi), acc["lv"]), 1, depth)
        return F.struct(lv.alias("lv"), F.concat(acc["sums"], F.array(total)).alias("sums"))

    sums = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, advance, lambda acc: acc["sums"])
    spread = params.filter(F.col("target") == target).select("station", "sigma", sums.alias("_v"))
    half = Z95 * F.col("sigma") * F.sqrt(F.element_at("_v", F.col("step")))
    return points.join(spread, "station").select(
        "station", "target", "last_ts", "step", "prediction",
        (F.col("prediction") - half).alias("lower"), (F.col("prediction") + half).alias("upper"),
    )


def ar_fitted(df, params: DataFrame, target: str, cfg: ARConfig = ARConfig(), *, shape: Shape | None = None) -> DataFrame:
    """In-sample one-step values: station, ts, target, actual, prediction."""
    shape = shape or measure(df, cfg.station)
    depth = max(cfg.reach, 1)
    base = df.select(cfg.station, cfg.ts, target)
    wide = timeline.over_rows(
        base, lambda w: {"_lv": F.array(*[F.lag(target, k).over(w) for k in range(1, depth + 1)])},
        back=depth, station=cfg.station, ts=cfg.ts, shape=shape,
    )
    own = params.filter(F.col("target") == target).select(F.col("station").alias(cfg.station), "const", "level_coef")
    fit = join_small(wide, own, [cfg.station], shape.series, "inner", per_row=depth + 3)
    return fit.select(
        cfg.station, cfg.ts, F.lit(target).alias("target"), F.col(target).alias("actual"), _step(F.col("_lv")).alias("prediction")
    )


def mdl_ar_fit_metrics(df, models: dict[str, DataFrame], cfg: ARConfig = ARConfig(), *, shape: Shape | None = None) -> DataFrame:
    """Metrics of the fitted values pooled over targets; stations without any model score infinite."""
    shape = shape or measure(df, cfg.station)
    fitted = None
    for target, params in models.items():
        part = ar_fitted(df, params, target, cfg, shape=shape)
        fitted = part if fitted is None else fitted.unionByName(part)
    every = df.select(cfg.station).distinct()
    none = every.join(fitted.select(cfg.station).distinct(), cfg.station, "left_anti")
    return agg_metrics(fitted.unionByName(none, allowMissingColumns=True), by=[cfg.station])


# ---- moving average terms and order search ------------------------------------------------------------------------


def _with_residuals(df, target: str, d: int, long_p: int, cfg: ARConfig, shape: Shape) -> DataFrame:
    """Add ``_e``: residual of a long autoregression, the first Hannan-Rissanen step."""
    long_cfg = ARConfig(p=long_p, d=d, min_rows=cfg.min_rows, station=cfg.station, ts=cfg.ts)
    params = mdl_ar(df, target, long_cfg, shape=shape)
    fitted = ar_fitted(df, params, target, long_cfg, shape=shape)
    return fitted.select(
        cfg.station, cfg.ts, F.col("actual").alias(target), (F.col("actual") - F.col("prediction")).alias("_e")
    )


def _arma_moments(df, target: str, p: int, d: int, q: int, cfg: ARConfig, shape: Shape, long_p: int) -> DataFrame:
    base = _with_residuals(df, target, d, long_p, cfg, shape) if q else df.select(cfg.station, cfg.ts, target)
    names = ["_y", *[f"_a{k}" for k in range(1, p + 1)], *[f"_m{k}" for k in range(1, q + 1)]]

    def cols(w):
        out = {"_y": differenced(target, 0, d, w)}
        out |= {f"_a{k}": differenced(target, k, d, w) for k in range(1, p + 1)}
        return out | {f"_m{k}": F.lag("_e", k).over(w) for k in range(1, q + 1)}

    wide = timeline.over_rows(base, cols, back=max(p + d, q, 1), station=cfg.station, ts=cfg.ts, shape=shape)
    return moments(wide, names, station=cfg.station).withColumnRenamed(cfg.station, "station")


def mdl_arma(
    df, target: str, p: int, q: int, *, d: int = 0, cfg: ARConfig = ARConfig(), shape: Shape | None = None, long_p: int = 10
) -> DataFrame:
    """ARMA(p, q) on the d-times differenced series: station, const, ar, ma, sigma, n."""
    shape = shape or measure(df, cfg.station)
    low, k = cfg.min_rows, 1 + p + q

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for station, n, mean, cov in zip(pdf["station"], pdf["n"], pdf["means"], pdf["cov"]):
                if n >= max(low, k + 1):
                    c, b, sse = _regress(np.asarray(mean), _matrix(np.asarray(cov), k), n, range(1, k))
                    rows.append((station, c, b[:p].tolist(), b[p:].tolist(), math.sqrt(sse / n), int(n)))
            yield pd.DataFrame(rows, columns=["station", "const", "ar", "ma", "sigma", "n"])

    m = _arma_moments(df, target, p, d, q, cfg, shape, long_p)
    return m.mapInPandas(solve, "station string, const double, ar array<double>, ma array<double>, sigma double, n long")


def order_grid(
    df, target: str, *, max_p: int = 5, max_d: int = 2, max_q: int = 5, cfg: ARConfig = ARConfig(), shape: Shape | None = None,
    long_p: int = 10,
) -> DataFrame:
    """Criteria of every (p, d, q): station, p, d, q, n, sse, aic, bic, hqic.

    All orders of one d are submatrices of one moment matrix, so the grid costs one aggregate per d.
    """
    shape = shape or measure(df, cfg.station)
    k, low = 1 + max_p + max_q, cfg.min_rows

    def grid_for(d: int):
        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for station, n, mean, cov in zip(pdf["station"], pdf["n"], pdf["means"], pdf["cov"]):
                    if n < max(low, k + 1):
                        continue
                    mean, cov = np.asarray(mean), _matrix(np.asarray(cov), k)
                    for p in range(max_p + 1):
                        for q in range(max_q + 1):
                            use = [*range(1, p + 1), *range(1 + max_p, 1 + max_p + q)]
                            sse = max(_regress(mean, cov, n, use)[2], 1e-12)
                            fit, size = n * math.log(sse / n), p + q + 1
                            rows.append(
                                (station, p, d, q, int(n), sse, fit + 2 * size, fit + size * math.log(n),
                                 fit + 2 * size * math.log(math.log(n)))
                            )
                yield pd.DataFrame(rows, columns=["station", "p", "d", "q", "n", "sse", "aic", "bic", "hqic"])

        return solve

    out = None
    for d in range(max_d + 1):
        m = _arma_moments(df, target, max_p, d, max_q, cfg, shape, long_p)
        part = m.mapInPandas(
            grid_for(d), "station string, p int, d int, q int, n long, sse double, aic double, bic double, hqic double"
        )
        out = part if out is None else out.unionByName(part)
    return out


def best_order(grid: DataFrame, *, criterion: str = "aic", keys: Sequence[str] = ("station",)) -> DataFrame:
    """Order with the lowest criterion per station; smaller orders win ties."""
    best = F.min(F.struct(F.col(criterion).alias("value"), "p", "d", "q"))
    return grid.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.p", "b.d", "b.q", F.col("b.value").alias(criterion))


def mdl_order_search(df, target: str, *, criterion: str = "aic", **grid) -> DataFrame:
    return best_order(order_grid(df, target, **grid), criterion=criterion)


# ---- stationarity -------------------------------------------------------------------------------------------------

# Response surface of the 5 percent critical value with a constant, in powers of 1/n.
ADF_CRITICAL = [-2.86154, -2.8903, -4.234, -40.04]
# Level test table.
KPSS_CRITICAL = [(0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01)]
MIN_TEST_ROWS = 10


def adf_max_lag(n: int) -> int:
    return max(min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25)), 0)


def _adf(products: np.ndarray, head: np.ndarray, tail: np.ndarray, rows: int, cap: int) -> tuple[float, int, int] | None:
    """Statistic, lags and rows of the regression whose lag count has the lowest AIC among 0..cap, all on the rows the longest allows."""
    mean, cov, n = step_moments(products, head, tail, rows, cap)
    scores = []
    for used in range(cap + 1):
        sse = max(_regress(mean, cov, n, range(1, 2 + used))[2], 1e-300)
        scores.append((n * math.log(sse / n) + 2 * (used + 2), used))
    used = min(scores)[1]
    mean, cov, n = step_moments(products, head, tail, rows, used)
    use = list(range(1, 2 + used))
    _, slopes, sse = _regress(mean, cov, n, use)
    free = n - len(use) - 1
    if free <= 0 or sse <= 0:
        return None
    var = np.linalg.pinv(cov[np.ix_(use, use)])[0, 0] / n * sse / free
    return float(slopes[0] / math.sqrt(var)), used, n


def _centred(base: DataFrame, target: str, station: str, ts: str, shape: Shape) -> DataFrame:
    """station, ts, _r: values less the mean of their series, of series long enough to be tested."""
    means = base.groupBy(station).agg(F.avg(target).alias("_m"), F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= MIN_TEST_ROWS)
    return join_small(base, means, [station], shape.series, "inner").select(station, ts, (F.col(target) - F.col("_m")).alias("_r"))


def ts_adf(df, target: str, *, station=STATION, ts=TS, shape: Shape | None = None) -> DataFrame:
    """Augmented unit root test with constant, lag count by AIC: station, adf_statistic, used_lag, nobs,
    critical_5, adf_stationary.

    One pass of lagged products serves the regressions of every lag count; Python sees one row per station.
    """
    base = df.select(station, ts, target).dropna(subset=[target])
    shape = shape or measure(base, station)
    lags = adf_max_lag(shape.longest)
    centred = _centred(base, target, station, ts, shape)
    sums = lag_products(centred, "_r", lags, steps=True, station=station, ts=ts, shape=shape)
    ends = series_ends(centred, "_r", lags, station=station, ts=ts, shape=shape)

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for name, p, head, tail, rows in zip(pdf[station], pdf["products"], pdf["head"], pdf["tail"], pdf["rows"]):
                one = _adf(np.asarray(p).reshape(lags + 1, 2, 2), np.asarray(head), np.asarray(tail), int(rows), adf_max_lag(int(rows)))
                if one is not None:
                    found.append((name, *one))
            yield pd.DataFrame(found, columns=["station", "adf_statistic", "used_lag", "nobs"])

    kind = df.schema[station].dataType.simpleString()
    out = sums.join(ends, station).mapInPandas(test, f"station {kind}, adf_statistic double, used_lag int, nobs long")
    critical = sum((F.lit(c) / F.pow(F.col("nobs").cast("double"), F.lit(float(i))) for i, c in enumerate(ADF_CRITICAL)), F.lit(0.0))
    return out.withColumn("critical_5", critical).withColumn("adf_stationary", F.col("adf_statistic") <= F.col("critical_5"))


def _kpss_p(stat: Column) -> Column:
    chain = F.when(stat <= KPSS_CRITICAL[0][0], KPSS_CRITICAL[0][1])
    for (x0, p0), (x1, p1) in zip(KPSS_CRITICAL, KPSS_CRITICAL[1:]):
        chain = chain.when(stat <= x1, p0 + (p1 - p0) * (stat - x0) / (x1 - x0))
    return chain.otherwise(KPSS_CRITICAL[-1][1])


def ts_kpss(df, target: str, *, station=STATION, ts=TS, nlags: int | str = "auto", shape: Shape | None = None) -> DataFrame:
    """Level stationarity test: station, kpss_statistic, used_lag, kpss_pvalue.

    ``auto`` first derives the lag count of every series from a few autocovariances, then uses exactly that many.
    """
    base = df.select(station, ts, target).dropna(subset=[target])
    shape = shape or measure(base, station)
    centred = _centred(base, target, station, ts, shape)
    means = centred.groupBy(station).agg(F.count(F.lit(1)).alias("rows"))
    if nlags == "auto":
        few = int(max(shape.longest, 1) ** (2 / 9) + 1e-9)
        n = F.col("rows").cast("double")
        own = F.floor(F.pow(n, F.lit(2.0 / 9.0)) + 1e-9).cast("int")
        g = lag_products(centred, "_r", few, station=station, ts=ts, shape=shape).join(means, station)
        gam = F.transform(F.slice("products", F.lit(2), own), lambda x: x / (n / 2))
        s0 = F.aggregate(gam, F.col("products")[0] / n, lambda a, x: a + x)
        s1 = F.aggregate(F.transform(gam, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
        ratio = F.try_divide(s1, s0)
        auto = F.floor(1.1447 * F.pow(ratio * ratio, F.lit(1 / 3)) * F.pow(n, F.lit(1 / 3)))
        lag_table = g.select(station, F.least(F.coalesce(auto, F.lit(0)), F.col("rows") - 1).cast("int").alias("used_lag"))
        top = lag_table.agg(F.max("used_lag")).first()[0] or 0
    else:
        lag_table = means.select(station, F.lit(int(nlags)).alias("used_lag"))
        top = int(nlags)
    prods = lag_products(centred, "_r", top, station=station, ts=ts, shape=shape)
    # Squared running sums per series.
    cs = timeline.running_sum(centred, "_r", "_s", station=station, ts=ts, shape=shape)
    eta = cs.groupBy(station).agg(F.sum(F.col("_s") * F.col("_s")).alias("_eta"), F.count(F.lit(1)).alias("_rows"))
    j = prods.join(lag_table, station).join(eta, station)
    n = F.col("_rows").cast("double")
    weighted = F.transform(
        F.slice("products", F.lit(2), F.col("used_lag")), lambda x, i: 2 * x * (1 - (i + 1) / (F.col("used_lag") + 1.0))
    )
    long_run = F.aggregate(weighted, F.col("products")[0], lambda a, x: a + x) / n
    stat = F.try_divide(F.col("_eta") / (n * n), long_run)
    return j.select(F.col(station).alias("station"), stat.alias("kpss_statistic"), "used_lag").withColumn(
        "kpss_pvalue", _kpss_p(F.col("kpss_statistic"))
    )


def ts_stationarity(df, target: str, *, station=STATION, ts=TS, alpha: float = 0.05, shape: Shape | None = None) -> DataFrame:
    """Both tests; stationary only if both agree. Series under ten rows are not stationary. suggested_d is 0 or 1."""
    every = df.select(F.col(station).alias("station")).distinct()
    a = ts_adf(df, target, station=station, ts=ts, shape=shape)
    k = ts_kpss(df, target, station=station, ts=ts, shape=shape)
    both = every.join(a, "station", "left").join(k.drop("used_lag"), "station", "left")
    ok = F.coalesce(F.col("adf_stationary") & (F.col("kpss_pvalue") >= alpha), F.lit(False))
    return both.withColumn("is_stationary", ok).withColumn("suggested_d", F.when(ok, 0).otherwise(1)).select(
        "station", "is_stationary", "adf_statistic", "kpss_statistic", "kpss_pvalue", "suggested_d"
    )


# ---- seasonality --------------------------------------------------------------------------------------------------


# Longest period whose average is taken over a plain frame.
FRAME_PERIOD = 48


def _trend(target: str, period: int):
    half = period // 2

    def cols(w):
        full = F.count(target).over(w.rowsBetween(-half, half)) == 2 * half + 1
        if period % 2:
            value = F.avg(target).over(w.rowsBetween(-half, half))
        else:
            inner = F.sum(target).over(w.rowsBetween(-half + 1, half - 1))
            value = (inner + 0.5 * (F.lag(target, half).over(w) + F.lead(target, half).over(w))) / period
        return {"trend": F.when(full, value)}

    return cols


def win_seasonal_trend(df, target: str, period: int, *, station=STATION, ts=TS, shape: Shape | None = None) -> DataFrame:
    """Centred moving average over one period, half weights at both ends of an even period; null near the ends."""
    half = max(period // 2, 1)
    if period <= FRAME_PERIOD:
        return timeline.over_rows(df, _trend(target, period), back=half, ahead=half, station=station, ts=ts, shape=shape)
    # A frame is summed anew for every row; for long periods differences of running sums cost the same at any length.
    shape = shape or measure(df, station)
    sums = df.withColumns({"_x": F.coalesce(F.col(target), F.lit(0.0)), "_k": F.when(F.col(target).isNull(), 0.0).otherwise(1.0)})
    for value, name in (("_x", "_cx"), ("_k", "_ck")):
        sums = timeline.running_sum(sums, value, name, station=station, ts=ts, shape=shape)

    def cols(w):
        # Sum of the rows from -half+1 to half-1 (whole frame for odd periods: -half to half).
        near, far = (half, half + 1) if period % 2 else (half - 1, half)
        inner = F.lead("_cx", near).over(w) - F.coalesce(F.lag("_cx", far).over(w), F.lit(0.0))
        ends = F.lit(0.0) if period % 2 else 0.5 * (F.lag("_x", half).over(w) + F.lead("_x", half).over(w))
        known = F.lead("_ck", half).over(w) - F.coalesce(F.lag("_ck", half + 1).over(w), F.lit(0.0))
        full = (F.lag("_x", half).over(w).isNotNull()) & (known == 2 * half + 1)
        return {"trend": F.when(full, (inner + ends) / period)}

    out = timeline.over_rows(sums, cols, back=half + 1, ahead=half, station=station, ts=ts, shape=shape)
    return out.drop("_x", "_k", "_cx", "_ck")


def ts_decompose(
    df, target: str, period: int, *, station=STATION, ts=TS, extend: bool = True, shape: Shape | None = None
) -> DataFrame:
    """Additive trend, seasonal and resid columns. ``extend`` continues the trend at both ends along a line fitted to
    its first and last ``period`` values."""
    base = df.select(station, ts, target).dropna(subset=[target])
    shape = shape or measure(base, station)
    pos = timeline.with_position(base, station=station, ts=ts, shape=shape).filter(F.col(COUNT) >= 2 * period)
    t = win_seasonal_trend(pos, target, period, station=station, ts=ts, shape=shape)
    if extend:
        half, p, n = period // 2, F.col(POS).cast("double"), F.col(COUNT)
        lines = []
        for side, inside in (
            ("front", F.col(POS) < half + period), ("back", F.col(POS) >= n - half - period),
        ):
            y, x = F.when(inside, F.col("trend")), F.when(inside & F.col("trend").isNotNull(), p)
            slope = F.try_divide(F.covar_pop(x, y), F.nullif(F.var_pop(x), F.lit(0.0)))
            lines += [slope.alias(f"{side}_s"), (F.avg(y) - slope * F.avg(x)).alias(f"{side}_c")]
        ends = t.groupBy(station).agg(*lines)
        t = join_small(t, ends, [station], shape.series)
        line = F.when(F.col(POS) < half, F.col("front_c") + F.col("front_s") * p).otherwise(
            F.col("back_c") + F.col("back_s") * p
        )
        t = t.withColumn("trend", F.coalesce("trend", line)).drop("front_s", "front_c", "back_s", "back_c")
    t = t.withColumn("_phase", (F.col(POS) % period).cast("int"))
    phases = t.groupBy(station, "_phase").agg(F.avg(F.col(target) - F.col("trend")).alias("_raw"))
    w = Window.partitionBy(station)
    phases = phases.select(station, "_phase", (F.col("_raw") - F.avg("_raw").over(w)).alias("seasonal"))
    out = join_small(t, phases, [station, "_phase"], shape.series * period)
    return out.withColumn("resid", F.col(target) - F.col("trend") - F.col("seasonal")).drop("_phase", POS, COUNT)


def ts_seasonality(
    df, target: str, *, periods: Sequence[int] = (24, 168, 8760), station=STATION, ts=TS, extend: bool = True,
    shape: Shape | None = None,
) -> DataFrame:
    """station, has_seasonality, seasonal_period, seasonal_strength: best of the periods that fit twice."""
    shape = shape or measure(df.dropna(subset=[target]), station)
    parts = df.select(station).distinct().select(station, F.lit(None).cast("int").alias("period"), F.lit(0.0).alias("strength"))
    for period in periods:
        if shape.longest < 2 * period:
            continue
        d = ts_decompose(df, target, period, station=station, ts=ts, extend=extend, shape=shape)
        s, r = F.var_pop("seasonal"), F.var_pop("resid")
        one = d.groupBy(station).agg(F.when(r > 0, s / (s + F.nullif(r, F.lit(0.0)))).alias("strength"))
        parts = parts.unionByName(one.select(station, F.lit(period).alias("period"), F.coalesce("strength", F.lit(0.0)).alias("strength")))
    best = parts.groupBy(station).agg(F.max(F.struct("strength", (-F.col("period")).alias("np"))).alias("b"))
    found = F.col("b.strength") > 0.1
    return best.select(
        station, found.alias("has_seasonality"), F.when(found, -F.col("b.np")).alias("seasonal_period"),
        F.col("b.strength").alias("seasonal_strength"),
    )


# ---- diagnostics --------------------------------------------------------------------------------------------------


def ts_diagnostics(residuals: DataFrame, *, value: str = "residual", lags: int = 10, station=STATION, ts=TS, shape: Shape | None = None) -> DataFrame:
    """station, residual_mean, residual_std (population), ljung_box, ljung_box_p for an even number of lags."""
    base = residuals.select(station, ts, value).dropna(subset=[value])
    shape = shape or measure(base, station)
    stats = base.groupBy(station).agg(
        F.avg(value).alias("residual_mean"), F.stddev_pop(value).alias("residual_std"), F.count(F.lit(1)).alias("n")
    )
    centred = join_small(base, stats, [station], shape.series).withColumn("_r", F.col(value) - F.col("residual_mean"))
    prods = lag_products(centred, "_r", lags, station=station, ts=ts, shape=shape)
    n = F.col("n").cast("double")
    terms = F.transform(
        F.slice("products", 2, lags), lambda x, i: F.try_divide(F.pow(F.try_divide(x, F.col("products")[0]), F.lit(2.0)), n - (i + 1))
    )
    q = n * (n + 2) * F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    h = F.col("ljung_box") / 2
    tail = sum((F.pow(h, F.lit(float(i))) / math.factorial(i) for i in range(lags // 2)), F.lit(0.0))
    return (
        prods.join(stats, station)
        .withColumn("ljung_box", q)
        .withColumn("ljung_box_p", F.exp(-h) * tail)
        .select(station, "n", "residual_mean", "residual_std", "ljung_box", "ljung_box_p")
    )


def fit_all(df, cfg: ARConfig = ARConfig(), *, targets: Sequence[str] = tuple(TARGETS), shape: Shape | None = None) -> dict[str, DataFrame]:
    shape = shape or measure(df, cfg.station)
    return {t: mdl_ar(df, t, cfg, shape=shape) for t in targets}
