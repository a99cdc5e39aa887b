"""Series statistics and autoregression, checked against closed forms in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wxspark.catalog.base import query
from wxspark.operators import metrics, series, split, timeline
from wxspark.operators.series import ARConfig
from wxspark.sources.panel import panel, panel_table

AR1 = "ar AS (SELECT station, ts, {t} AS y, lag({t}) OVER (PARTITION BY station ORDER BY ts) AS x FROM panel)"
AR1_FIT = (
    AR1.format(t="temperature")
    + ", fit AS (SELECT station, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sqrt(regr_syy(y,x)*(1-regr_r2(y,x))/count(*)) AS s"
    " FROM ar WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY station HAVING count(*) >= 50)"
)


@query(
    "mdl_ar", "SELECT station, n, a AS const, b AS coef, s AS sigma FROM fit", keys="station", ints="n", nums="const coef sigma", ctes=AR1_FIT,
)
def mdl_ar(spark, path):
    return series.mdl_ar(panel(spark, path), "temperature").withColumn("coef", F.col("level_coef")[0])


@query(
    "mdl_ar_difference",
    "SELECT station, count(*) AS n, regr_intercept(y, x) AS const, 1 + regr_slope(y, x) AS c1, -regr_slope(y, x) AS c2 FROM"
    " (SELECT station, y - lag(y) OVER w AS y, lag(y) OVER w - lag(y, 2) OVER w AS x FROM (SELECT station, ts, pressure AS y FROM panel)"
    " WINDOW w AS (PARTITION BY station ORDER BY ts)) WHERE x IS NOT NULL GROUP BY station",
    keys="station", ints="n", nums="const c1 c2",
)
def mdl_ar_difference(spark, path):
    m = series.mdl_ar(panel(spark, path), "pressure", ARConfig(p=1, d=1))
    return m.withColumns({"c1": F.col("level_coef")[0], "c2": F.col("level_coef")[1]})


LAST = ", lastrow AS (SELECT station, max_by(temperature, ts) AS y0 FROM panel GROUP BY station)"


@query(
    "mdl_ar_predict", "SELECT station, coalesce(a + b*y0, 0) AS prediction FROM lastrow LEFT JOIN fit USING (station)",
    keys="station", nums="prediction", ctes=AR1_FIT + LAST,
)
def mdl_ar_predict(spark, path):
    obs = panel_table(spark, path)
    return series.mdl_ar_predict(obs, series.mdl_ar(obs, "temperature"), "temperature")


@query(
    "mdl_multi_step",
    "WITH RECURSIVE r AS (SELECT station, 1 AS step, a + b*y0 AS prediction FROM lastrow JOIN fit USING (station)"
    " UNION ALL SELECT r.station, step+1, a + b*prediction FROM r JOIN fit USING (station) WHERE step < 24) SELECT station, step, prediction FROM r",
    keys="station", ints="step", nums="prediction", ctes=AR1_FIT + LAST,
)
def mdl_multi_step(spark, path):
    obs = panel_table(spark, path)
    return series.mdl_multi_step(obs, series.mdl_ar(obs, "temperature"), "temperature", 24)


@query(
    "mdl_ar_interval",
    "WITH RECURSIVE r AS (SELECT station, 1 AS step, a + b*y0 AS prediction, 1.0::DOUBLE AS v FROM lastrow JOIN fit USING (station)"
    " UNION ALL SELECT r.station, step+1, a + b*prediction, v + pow(b, 2*step) FROM r JOIN fit USING (station) WHERE step < 6)"
    " SELECT station, step, prediction, prediction - 1.96*s*sqrt(v) AS lower, prediction + 1.96*s*sqrt(v) AS upper FROM r JOIN fit USING (station)",
    keys="station", ints="step", nums="prediction lower upper", ctes=AR1_FIT + LAST,
)
def mdl_ar_interval(spark, path):
    obs = panel_table(spark, path)
    return series.mdl_ar_interval(obs, series.mdl_ar(obs, "temperature"), "temperature", steps=6)


@query(
    "mdl_ar_fit_metrics",
    "SELECT station, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e*e)) AS rmse FROM (SELECT station, a+b*x-y AS e FROM ar JOIN fit USING (station) WHERE x IS NOT NULL"
    " UNION ALL SELECT station, a+b*x-y FROM ar2 JOIN fit2 USING (station) WHERE x IS NOT NULL) GROUP BY station",
    keys="station", ints="n", nums="mae rmse",
    ctes=AR1_FIT + ", ar2 AS (SELECT station, ts, pressure AS y, lag(pressure) OVER (PARTITION BY station ORDER BY ts) AS x FROM panel),"
    " fit2 AS (SELECT station, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM ar2 WHERE x IS NOT NULL GROUP BY station)",
)
def mdl_ar_fit_metrics(spark, path):
    obs = panel_table(spark, path)
    shape = timeline.measure(obs)
    return series.mdl_ar_fit_metrics(obs, series.fit_all(obs, targets=["temperature", "pressure"], shape=shape), shape=shape)


@query("mdl_arma", keys="station", ints="n p q", nums="const sigma", digits=4)
def mdl_arma(spark, path):
    m = series.mdl_arma(panel_table(spark, path), "temperature", 2, 1)
    return m.withColumns({"p": F.size("ar"), "q": F.size("ma")})


@query("mdl_order_search", keys="station", ints="p d q", nums="aic", digits=3)
def mdl_order_search(spark, path):
    return series.mdl_order_search(panel_table(spark, path), "temperature")


@query(
    "best_order",
    "SELECT station, arg_min(p, ic) AS p, min(ic) AS ic FROM (SELECT station, 0 AS p, n*ln(var_pop_y) + 2 AS ic FROM g UNION ALL SELECT station, 1, n*ln(var_pop_y*(1-r2)) + 4 FROM g) GROUP BY station",
    keys="station", ints="p", nums="ic", digits=4,
    ctes=AR1.format(t="temperature") + ", g AS (SELECT station, count(*) AS n, var_pop(y) AS var_pop_y, regr_r2(y, x) AS r2 FROM ar WHERE x IS NOT NULL GROUP BY station)",
)
def best_order(spark, path):
    grid = series.order_grid(panel_table(spark, path), "temperature", max_p=1, max_d=0, max_q=0)
    return series.best_order(grid).withColumnRenamed("aic", "ic")


@query("ts_adf", keys="station adf_stationary", ints="used_lag nobs", nums="adf_statistic critical_5", digits=4)
def ts_adf(spark, path):
    return series.ts_adf(panel_table(spark, path), "temperature")


@query("ts_stationarity", keys="station is_stationary", ints="suggested_d", nums="adf_statistic kpss_statistic kpss_pvalue", digits=4)
def ts_stationarity(spark, path):
    return series.ts_stationarity(panel_table(spark, path), "temperature")


KPSS = (
    "c AS (SELECT station, ts, temperature - avg(temperature) OVER (PARTITION BY station) AS r FROM panel),"
    " d AS (SELECT station, ts, r, sum(r) OVER w AS s, " + ", ".join(f"r*lag(r, {k}) OVER w AS p{k}" for k in range(1, 6))
    + " FROM c WINDOW w AS (PARTITION BY station ORDER BY ts)),"
    " k AS (SELECT station, sum(s*s)/pow(count(*), 2) / ((sum(r*r) + " + " + ".join(f"2*(1-{k}/6.0::DOUBLE)*sum(p{k})" for k in range(1, 6)) + ")/count(*)) AS kpss_statistic FROM d GROUP BY station)"
)


@query("ts_kpss", "SELECT station, 5 AS used_lag, kpss_statistic FROM k", keys="station", ints="used_lag", nums="kpss_statistic", ctes=KPSS)
def ts_kpss(spark, path):
    return series.ts_kpss(panel_table(spark, path), "temperature", nlags=5)


TREND = (
    "num AS (SELECT station, ts, temperature AS y, row_number() OVER (PARTITION BY station ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY station) AS n FROM panel),"
    " tr AS (SELECT *, CASE WHEN pos >= 12 AND pos < n - 12 THEN (sum(y) OVER (PARTITION BY station ORDER BY ts ROWS BETWEEN 11 PRECEDING AND 11 FOLLOWING)"
    " + 0.5::DOUBLE*(lag(y, 12) OVER w + lead(y, 12) OVER w))/24 END AS raw FROM num WINDOW w AS (PARTITION BY station ORDER BY ts))"
)
DECOMP = TREND + (
    ", e AS (SELECT station, regr_slope(raw, pos) FILTER (pos < 36) AS fs, regr_intercept(raw, pos) FILTER (pos < 36) AS fc,"
    " regr_slope(raw, pos) FILTER (pos >= n - 36) AS bs, regr_intercept(raw, pos) FILTER (pos >= n - 36) AS bc FROM tr WHERE raw IS NOT NULL GROUP BY station),"
    " t2 AS (SELECT station, ts, y, pos, coalesce(raw, CASE WHEN pos < 12 THEN fc+fs*pos ELSE bc+bs*pos END) AS trend FROM tr JOIN e USING (station) WHERE n >= 48),"
    " ph AS (SELECT station, pos % 24 AS phase, avg(y - trend) AS m FROM t2 GROUP BY 1, 2),"
    " ph2 AS (SELECT station, phase, m - avg(m) OVER (PARTITION BY station) AS seasonal FROM ph),"
    " dec AS (SELECT t2.station, ts, trend, seasonal, y - trend - seasonal AS resid FROM t2 JOIN ph2 ON t2.station = ph2.station AND t2.pos % 24 = phase)"
)


@query("win_seasonal_trend", "SELECT station, ts, raw AS trend FROM tr", keys="station ts", nums="trend", ctes=TREND)
def win_seasonal_trend(spark, path):
    return series.win_seasonal_trend(panel(spark, path).select("station", "ts", "temperature"), "temperature", 24)


@query("ts_decompose", "SELECT * FROM dec", keys="station ts", nums="trend seasonal resid", ctes=DECOMP)
def ts_decompose(spark, path):
    return series.ts_decompose(panel_table(spark, path), "temperature", 24)


@query(
    "ts_seasonality",
    "SELECT station, s/(s+r) > 0.1 AS has_seasonality, CASE WHEN s/(s+r) > 0.1 THEN 24 END AS seasonal_period, s/(s+r) AS seasonal_strength"
    " FROM (SELECT station, var_pop(seasonal) AS s, var_pop(resid) AS r FROM dec GROUP BY station)",
    keys="station has_seasonality", ints="seasonal_period", nums="seasonal_strength", ctes=DECOMP,
)
def ts_seasonality(spark, path):
    return series.ts_seasonality(panel_table(spark, path), "temperature", periods=[24])


@query("ts_seasonality_all", keys="station has_seasonality", ints="seasonal_period", nums="seasonal_strength")
def ts_seasonality_all(spark, path):
    return series.ts_seasonality(panel_table(spark, path), "temperature")


@query(
    "ts_diagnostics",
    "SELECT station, n, mean AS residual_mean, std AS residual_std, q AS ljung_box, exp(-q/2)*(1+q/2+pow(q/2,2)/2+pow(q/2,3)/6+pow(q/2,4)/24) AS ljung_box_p FROM lb",
    keys="station", ints="n", nums="residual_mean residual_std ljung_box ljung_box_p",
    ctes=AR1_FIT + ", e0 AS (SELECT station, ts, y-a-b*x AS e FROM ar JOIN fit USING (station) WHERE x IS NOT NULL),"
    " e1 AS (SELECT station, ts, e, e - avg(e) OVER (PARTITION BY station) AS r FROM e0),"
    " e2 AS (SELECT station, e, r, " + ", ".join(f"r*lag(r,{k}) OVER w AS p{k}" for k in range(1, 11)) + " FROM e1 WINDOW w AS (PARTITION BY station ORDER BY ts)),"
    " lb AS (SELECT station, count(*) AS n, avg(e) AS mean, stddev_pop(e) AS std, CAST(count(*) AS DOUBLE)*(count(*)+2)*("
    + " + ".join(f"pow(sum(p{k})/sum(r*r),2)/(count(*)-{k})" for k in range(1, 11)) + ") AS q FROM e2 GROUP BY station)",
)
def ts_diagnostics(spark, path):
    obs = panel_table(spark, path)
    fitted = series.ar_fitted(obs, series.mdl_ar(obs, "temperature"), "temperature")
    return series.ts_diagnostics(fitted.select("station", "ts", (F.col("actual") - F.col("prediction")).alias("residual")))


@query(
    "cv_time_series",
    "SELECT station, avg(mae) AS mae_mean, stddev_pop(mae) AS mae_std, avg(rmse) AS rmse_mean, stddev_pop(rmse) AS rmse_std FROM"
    " (SELECT station, fold, avg(abs(a+b*x-y)) AS mae, sqrt(avg(pow(a+b*x-y,2))) AS rmse FROM f JOIN ff USING (station, fold) WHERE role = 'validation' GROUP BY 1, 2) GROUP BY station",
    keys="station", nums="mae_mean mae_std rmse_mean rmse_std",
    ctes="num AS (SELECT station, ts, temperature AS y, lag(temperature) OVER (PARTITION BY station ORDER BY ts) AS x, row_number() OVER (PARTITION BY station ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY station) AS n FROM panel),"
    " f AS (SELECT num.*, fold, CASE WHEN pos >= (n//6)*(fold+1) THEN 'validation' ELSE 'train' END AS role FROM num, range(0,5) f(fold) WHERE pos < (n//6)*(fold+2)),"
    " ff AS (SELECT station, fold, regr_slope(y,x) AS b, regr_intercept(y,x) AS a FROM f WHERE role = 'train' AND x IS NOT NULL GROUP BY 1, 2)",
)
def cv_time_series(spark, path):
    from wxspark.plans.validate import cv_time_series as cv

    return cv(panel_table(spark, path), "temperature")


@query("cv_models", keys="station model", nums="mae_mean mae_std rmse_mean rmse_std", digits=4)
def cv_models(spark, path):
    """Autoregression and rule base over five folds; tests/test_validate.py has the loop over folds."""
    from wxspark.plans.validate import cv_models as cv

    return cv(panel_table(spark, path), "temperature")
