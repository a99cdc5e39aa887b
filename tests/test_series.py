import math

import numpy as np

from wxspark.operators import lags, series
from wxspark.operators.series import ARConfig


def local(df, station, col):
    return np.array([r[0] for r in df.filter(f"station = '{station}'").orderBy("ts").select(col).collect()])


def regress(y, rows, x):
    b, *_ = np.linalg.lstsq(x, y[rows], rcond=None)
    e = y[rows] - x @ b
    return b, float(e @ e)


def test_adf_equals_direct_regression(full):
    got = {r["station"]: r for r in series.ts_adf(full, "temperature").collect()}
    for s in ("a", "b"):
        y = local(full, s, "temperature")
        dy, top = np.diff(y), series.adf_max_lag(len(y))

        def fit(k, start):
            t = np.arange(start, len(dy))
            x = np.column_stack([y[t], *[dy[t - i] for i in range(1, k + 1)], np.ones(len(t))])
            b, sse = regress(dy, t, x)
            se = math.sqrt(np.linalg.inv(x.T @ x)[0, 0] * sse / (len(t) - x.shape[1]))
            return b[0] / se, len(t) * math.log(sse / len(t)) + 2 * x.shape[1]

        best = min((fit(k, top)[1], k) for k in range(top + 1))[1]
        assert got[s]["used_lag"] == best
        assert abs(got[s]["adf_statistic"] - fit(best, best)[0]) < 1e-6


def test_kpss_equals_direct_sum(full):
    got = {r["station"]: r for r in series.ts_kpss(full, "temperature").collect()}
    for s in ("a", "b"):
        r = local(full, s, "temperature")
        r, n = r - r.mean(), len(r)
        own = int(n ** (2 / 9))
        g = [r[i:] @ r[: n - i] / (n / 2) for i in range(1, own + 1)]
        s0 = r @ r / n + sum(g)
        s1 = sum((i + 1) * v for i, v in enumerate(g))
        lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
        lrv = (r @ r + sum(2 * (1 - i / (lags + 1)) * (r[i:] @ r[: n - i]) for i in range(1, lags + 1))) / n
        assert got[s]["used_lag"] == lags
        assert abs(got[s]["kpss_statistic"] - (np.cumsum(r) ** 2).sum() / n**2 / lrv) < 1e-8


def test_short_series_is_not_stationary(spark, full):
    few = full.filter("ts < '2024-01-01 05:00:00'")
    rows = series.ts_stationarity(few, "temperature").collect()
    assert len(rows) == 2 and not any(r["is_stationary"] for r in rows) and all(r["suggested_d"] == 1 for r in rows)


def test_ar_with_season_equals_least_squares(full):
    cfg = ARConfig(p=2, d=1, season=24, seasonal_p=1)
    got = {r["station"]: r for r in series.mdl_ar(full, "temperature", cfg).collect()}
    y = local(full, "a", "temperature")
    dy = np.diff(y)
    t = np.arange(24, len(dy))
    b, sse = regress(dy, t, np.column_stack([dy[t - 1], dy[t - 2], dy[t - 24], np.ones(len(t))]))
    level = np.zeros(25)
    poly = np.zeros(25)
    poly[0], poly[1], poly[2], poly[24] = 1, -b[0], -b[1], -b[2]
    level = -np.convolve(poly, [1, -1])[1:]
    assert np.allclose(got["a"]["level_coef"], level, atol=1e-8)
    assert abs(got["a"]["sigma"] - math.sqrt(sse / len(t))) < 1e-8
    # One step and many steps follow the same recursion.
    steps = [r["prediction"] for r in series.mdl_multi_step(full, series.mdl_ar(full, "temperature", cfg), "temperature", 5, cfg).filter("station = 'a'").orderBy("step").collect()]
    lv = list(y[::-1][:25])
    for p in steps:
        nxt = got["a"]["const"] + float(np.dot(level, lv))
        assert abs(nxt - p) < 1e-6
        lv = [nxt, *lv[:-1]]


def test_interval_widens_and_contains_point(full):
    cfg = ARConfig(p=2)
    rows = series.mdl_ar_interval(full, series.mdl_ar(full, "temperature", cfg), "temperature", cfg, steps=6).orderBy("station", "step").collect()
    for a, b in zip(rows, rows[1:]):
        assert a["lower"] <= a["prediction"] <= a["upper"]
        if a["station"] == b["station"]:
            assert b["upper"] - b["lower"] >= a["upper"] - a["lower"] - 1e-9


def test_daily_wave_is_found(full):
    rows = series.ts_seasonality(full, "temperature").collect()
    assert {r["seasonal_period"] for r in rows} == {24} and all(r["seasonal_strength"] > 0.5 for r in rows)


def test_order_grid_matches_single_fits(full):
    grid = {(r["station"], r["p"], r["d"], r["q"]): r for r in series.order_grid(full, "temperature", max_p=2, max_d=1, max_q=1).collect()}
    assert len(grid) == 2 * 3 * 2 * 2
    best = series.mdl_order_search(full, "temperature", criterion="bic", max_p=2, max_d=1, max_q=1).collect()
    for r in best:
        assert r["bic"] == min(g["bic"] for k, g in grid.items() if k[0] == r["station"])


def test_arma_shapes(full):
    r = series.mdl_arma(full, "temperature", 2, 1).filter("station = 'a'").first()
    assert len(r["ar"]) == 2 and len(r["ma"]) == 1 and r["sigma"] > 0


def test_products_of_many_lags_by_blocks(full):
    from pyspark.sql import functions as F

    df = full.select("station", "ts", (F.col("temperature") - 20).alias("v"))
    for count, block in ((3, 16), (90, 32), (300, 64), (70, 8192)):
        got = {r["station"]: np.array(r["products"]) for r in lags.lag_products(df, "v", count, block=block).collect()}
        pair = {r["station"]: np.array(r["products"]) for r in lags.lag_products(df, "v", count, steps=True, block=block).collect()}
        for s in ("a", "b"):
            y = local(full, s, "temperature") - 20
            assert np.allclose(got[s], [y[: max(len(y) - k, 0)] @ y[k:] for k in range(count + 1)], atol=1e-7)
            x = np.column_stack([y[:-1], np.diff(y)])
            assert np.allclose(pair[s].reshape(-1, 2, 2), [x[: max(len(x) - k, 0)].T @ x[k:] for k in range(count + 1)], atol=1e-7)


def test_moments_of_steps_equal_the_lagged_table():
    y = np.random.default_rng(5).normal(size=40).cumsum()
    y -= y.mean()
    x = lags.with_steps(y)
    products = np.stack([x[: len(x) - k].T @ x[k:] for k in range(8)])
    for c in (0, 1, 4, 7):
        t = np.arange(c, len(x))
        wide = np.column_stack([x[t, 1], x[t, 0], *[x[t - k, 1] for k in range(1, c + 1)]])
        mean, cov, n = lags.step_moments(products, y[:8], y[-8:], len(y), c)
        assert n == len(wide)
        assert np.allclose(mean, wide.mean(axis=0), atol=1e-12) and np.allclose(cov, np.cov(wide.T, bias=True), atol=1e-11)


def test_series_of_several_lengths_have_their_own_lag_limits(spark, full):
    from pyspark.sql import functions as F

    short = full.filter("station = 'a'").orderBy("ts").limit(30).withColumn("station", F.lit("c"))
    one = full.filter("station = 'a'").limit(1).withColumn("station", F.lit("d"))
    alone = series.ts_adf(short, "temperature").first()
    among = {r["station"]: r for r in series.ts_adf(full.unionByName(short).unionByName(one), "temperature").collect()}
    assert set(among) == {"a", "b", "c"} and among["c"]["used_lag"] == alone["used_lag"] and among["c"]["nobs"] == alone["nobs"]
    assert abs(among["c"]["adf_statistic"] - alone["adf_statistic"]) < 1e-9
    assert series.ts_adf(full.limit(0), "temperature").isEmpty() and series.ts_kpss(full.limit(0), "temperature").isEmpty()


def test_moments_of_many_variables_keep_their_digits(spark):
    from pyspark.sql import functions as F

    names = [f"v{i}" for i in range(10)]
    df = spark.range(3000).select((F.col("id") % 2).cast("string").alias("station"), *[(F.lit(1e6) + F.sin(F.col("id") * (i + 1)) / 100).alias(n) for i, n in enumerate(names)])
    for r in series.moments(df.repartition(5), names).collect():
        x = np.array(df.filter(f"station = '{r['station']}'").select(names).collect())
        assert r["n"] == len(x) and np.allclose(r["means"], x.mean(axis=0), rtol=1e-14)
        want = np.cov((x - 1e6).T, bias=True)[np.tril_indices(10)]
        assert np.abs(np.array(r["cov"]) - want).max() < 1e-5 * np.abs(want).max()
