"""Whole pipelines, forests, forecasts and streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from wxspark.catalog import features as S
from wxspark.catalog.base import query
from wxspark.catalog.models import PRED, RULES
from wxspark.catalog.places import HEALTH, provider_log
from wxspark.catalog.series import AR1_FIT, LAST
from wxspark.operators import features, forest, fuzzy, innovations, timeline, trees, windowed
from wxspark.plans import families, forecast, pipeline
from wxspark.schema import BASE, TARGETS
from wxspark.session import scratch, stored
from wxspark.sources import commits
from wxspark.sources.panel import forecast_log, located, panel, panel_table
from wxspark.streaming import jobs

# ---- feature pipeline ---------------------------------------------------------------------------------------------

TIME = ["hour", "day_of_week", "day_of_year", "month", "season"]
EXTRA = ["pressure_tendency", "temp_humidity_ratio", "pressure_normalized", "precipitation_intensity", "feels_like", "dew_point", "heat_index", "wind_chill"]
ALL = [*BASE, *EXTRA, *TIME, *S.CYC_NAMES, *S.LAG_NAMES, *S.ROLL_NAMES]
ENG = (
    f"eng AS (SELECT station, ts, {', '.join(BASE)}, {S.HOUR} AS hour, {S.DOW} AS day_of_week, dayofyear(ts) AS day_of_year, {S.MONTH} AS month, {S.SEASON} AS season,"
    f" {S.CYC_SQL}, {S.TENDENCY} AS pressure_tendency, {S.RATIO} AS temp_humidity_ratio, (pressure-1013.25::DOUBLE)/1013.25::DOUBLE AS pressure_normalized,"
    f" {S.RAIN_BIN} AS precipitation_intensity, {S.FEELS} AS feels_like, {S.DEW} AS dew_point, {S.HEAT} AS heat_index, {S.CHILL} AS wind_chill, {S.LAG_SQL}, {S.ROLL_SQL} FROM panel {S.WINDOW_SQL})"
)


def pipe_sql(fit: str, use: str) -> str:
    """Parameters from the rows that satisfy ``fit``, applied to the rows that satisfy ``use``."""
    med = ", ".join(f"median({c}) AS {c}_m" for c in ALL)
    imp = ", ".join(f"coalesce({c}, {c}_m) AS {c}" for c in ALL)
    q = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_a, quantile_cont({c}, 0.75) AS {c}_b" for c in BASE)
    clip = ", ".join(f"greatest(least({c}, {c}_b+1.5::DOUBLE*({c}_b-{c}_a)), {c}_a-1.5::DOUBLE*({c}_b-{c}_a)) AS {c}" for c in BASE)
    mom = ", ".join(f"avg({c}) AS {c}_v, stddev_pop({c}) AS {c}_p" for c in ALL)
    scale = ", ".join(f"({c}-{c}_v)/CASE WHEN {c}_p <= 1e-12*greatest(abs({c}_v),1) THEN 1 ELSE {c}_p END AS {c}" for c in ALL)
    return (
        f"{ENG}, med AS (SELECT station, {med} FROM eng WHERE {fit} GROUP BY station), imp AS (SELECT station, ts, {imp} FROM eng JOIN med USING (station)),"
        f" qq AS (SELECT station, {q} FROM imp WHERE {fit} GROUP BY station), cl AS (SELECT * EXCLUDE ({', '.join(f'{c}_a, {c}_b' for c in BASE)}) REPLACE ({clip}) FROM imp JOIN qq USING (station)),"
        f" mm AS (SELECT station, {mom} FROM cl WHERE {fit} GROUP BY station), scaled AS (SELECT station, ts, {scale} FROM cl JOIN mm USING (station) WHERE {use})"
    )


@query("pipe_train", "SELECT * FROM scaled", keys="station ts", nums=" ".join(ALL), ctes=pipe_sql("true", "true"), digits=5)
def pipe_train(spark, path):
    return pipeline.pipe_train(panel_table(spark, path))[0]


FIRST = "day(ts) <= 20"


@query("pipe_predict", "SELECT * FROM scaled", keys="station ts", nums=" ".join([*BASE, *EXTRA]), ctes=pipe_sql(FIRST, "true"), digits=5)
def pipe_predict(spark, path):
    """Parameters from the first 20 days, applied to all days."""
    obs = panel_table(spark, path)
    wide = stored(features.engineered(obs), "wide").filter(F.dayofmonth("ts") <= 20)
    return pipeline.pipe_predict(obs, pipeline.fit_pipeline(wide))


@query("pipe_restore", "SELECT station, ts, " + ", ".join(BASE) + " FROM clipped", keys="station ts", nums=" ".join(BASE),
       ctes="qq AS (SELECT station, " + ", ".join(f"quantile_cont({c}, 0.25) AS {c}_a, quantile_cont({c}, 0.75) AS {c}_b" for c in BASE) + " FROM panel GROUP BY station), clipped AS (SELECT station, ts, "
       + ", ".join(f"greatest(least({c}, {c}_b+1.5::DOUBLE*({c}_b-{c}_a)), {c}_a-1.5::DOUBLE*({c}_b-{c}_a)) AS {c}" for c in BASE) + " FROM panel JOIN qq USING (station))")
def pipe_restore(spark, path):
    obs = panel_table(spark, path)
    scaled, params = pipeline.pipe_train(obs, engineered=True)
    return pipeline.restore(scaled, params, BASE)


@query("feature_target_split", "SELECT station, count(*) AS rows, 7 AS columns, sum(temperature) AS t FROM panel GROUP BY station", keys="station", ints="rows columns", nums="t")
def feature_target_split(spark, path):
    obs = panel(spark, path)
    x, y = features.feature_target_split(obs)
    return obs.select("station", *x, *y).groupBy("station").agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(x) + len(y)).alias("columns"), F.sum("temperature").alias("t")
    )


@query("align_features", "SELECT station, ts, humidity, temperature, 0.0 AS missing_one FROM panel", keys="station ts", nums="humidity temperature missing_one")
def align_features(spark, path):
    return features.align_features(panel(spark, path), ["humidity", "missing_one", "temperature"])


# ---- forests and window regressions (rows only) -------------------------------------------------------------------

SMALL = forest.ForestConfig(trees=10, depth=6)
#: Narrower than the whole grid in trees and depths only; trees grow once for all of either.
TUNED = forest.GRID | {"trees": [10, 20], "depth": [5, 10]}
FOREST_FEATURES = [
    "humidity", "pressure", "wind_speed", "cloud_cover", "hour_sin", "hour_cos", "temperature", "pressure_tendency",
    "temperature_lag_1h", "temperature_lag_3h", "temperature_rolling_6h_mean", "temperature_rolling_6h_std",
]


def forest_frame(spark, path, targets=("temperature",)):
    obs = panel(spark, path)
    wide = features.engineered(obs, columns=["temperature"], lags=[1, 3], windows=[6])
    return stored(forest.training_frame(wide, FOREST_FEATURES, targets, SMALL), "train")


@query("mdl_forest", keys="station ts target", nums="prediction")
def mdl_forest(spark, path):
    train = forest_frame(spark, path, TARGETS)
    return forest.predict_long(forest.mdl_forest(train, TARGETS, SMALL), train)


@query("agg_importance", keys="feature", nums="importance")
def agg_importance(spark, path):
    train = forest_frame(spark, path, TARGETS)
    return forest.agg_importance(forest.mdl_forest(train, TARGETS, SMALL), FOREST_FEATURES, spark)


@query("sel_forest", keys="feature", ints="rank", nums="importance")
def sel_forest(spark, path):
    return forest.sel_forest(forest_frame(spark, path), FOREST_FEATURES, "temperature", forest.ForestConfig(trees=50, depth=6))


@query("mdl_forest_tune", keys="params", nums="mse")
def mdl_forest_tune(spark, path):
    return forest.mdl_forest_tune(forest_frame(spark, path), "temperature", TUNED)


@query("int_tree_spread", keys="station ts target", nums="prediction lower upper")
def int_tree_spread(spark, path):
    train = forest_frame(spark, path, TARGETS)
    nodes = trees.node_table(forest.mdl_forest(train, TARGETS, forest.ForestConfig(trees=100, depth=6)), spark)
    return trees.tree_spread(train, nodes)


def window_train(spark, path, length=24):
    """A day of rows per window; the longest training window of 168 rows is the same plan with wider vectors."""
    return stored(forest.window_frame(panel(spark, path), length=length), "windows")


@query("mdl_window_reg", keys="station ts target", nums="prediction")
def mdl_window_reg(spark, path):
    train = window_train(spark, path)
    return forest.predict_long(forest.mdl_window_reg(train), train)


@query("mdl_multi_step_window", keys="station", ints="step", nums=" ".join(TARGETS))
def mdl_multi_step_window(spark, path):
    obs = panel_table(spark, path)
    models = forest.mdl_window_reg(stored(forest.window_frame(obs, length=24), "windows"))
    return forest.multi_step(models, forest.recent_windows(obs, length=24), 24)


@query("int_replicas", keys="station ts", nums="prediction lower upper")
def int_replicas(spark, path):
    train = window_train(spark, path)
    return forest.int_replicas(train, train, "temperature")


# ---- forecasts ----------------------------------------------------------------------------------------------------

TRANS = RULES + (
    ", tv AS (SELECT s.station, s.set_no, coalesce(rule_value, center) AS value, u_min, u_max FROM sets s LEFT JOIN rv ON rv.station = s.station AND rv.antecedent = s.label),"
    " tn AS (SELECT station, set_no, value, next_no FROM (SELECT tv.station, tv.set_no, value, s.set_no AS next_no, row_number() OVER (PARTITION BY tv.station, tv.set_no ORDER BY"
    " CASE WHEN abs(value-s.center) <= s.width THEN 1-abs(value-s.center)/s.width ELSE 0 END DESC, s.set_no) AS r FROM tv JOIN sets s USING (station)) WHERE r = 1),"
    " lastlab AS (SELECT station, max_by(set_no, ts) AS at, max(ts) AS last_ts FROM lab GROUP BY station)"
)
WALK = (
    "WITH RECURSIVE wk AS (SELECT l.station, last_ts, 1 AS step, value AS prediction, next_no FROM lastlab l JOIN tn ON tn.station = l.station AND tn.set_no = l.at"
    " UNION ALL SELECT wk.station, last_ts, step+1, tn.value, tn.next_no FROM wk JOIN tn ON tn.station = wk.station AND tn.set_no = wk.next_no WHERE step < {h})"
)


@query("fz_multi_step", WALK.format(h=24) + " SELECT * FROM wk", keys="station last_ts", ints="step", nums="prediction", ctes=TRANS.replace("FROM gaps", "FROM panel"))
def fz_multi_step(spark, path):
    return fuzzy.fz_multi_step(panel_table(spark, path), 24)


@query(
    "fc_forecast",
    WALK.format(h=24) + ", ark AS (SELECT station, 1 AS step, a + b*y0 AS prediction FROM lastrow JOIN fit USING (station) UNION ALL SELECT ark.station, step+1, a + b*prediction FROM ark JOIN fit USING (station) WHERE step < 24)"
    " SELECT wk.station, last_ts + INTERVAL 1 HOUR * step AS ts, step, (wk.prediction+ark.prediction)/2 AS temperature, 50.0 AS humidity, 1013.25 AS pressure, 5.0 AS wind_speed,"
    " (wk.prediction+ark.prediction)/2 - 1.96*abs(wk.prediction-ark.prediction)/2 AS lower, (wk.prediction+ark.prediction)/2 + 1.96*abs(wk.prediction-ark.prediction)/2 AS upper, 0.95 AS confidence,"
    " 0.5 AS fuzzy_share FROM wk JOIN ark USING (station, step)",
    keys="station ts", ints="step", nums="temperature humidity pressure wind_speed lower upper confidence fuzzy_share",
    ctes=TRANS.replace("FROM gaps", "FROM panel") + ", " + AR1_FIT + LAST,
)
def fc_forecast(spark, path):
    f = forecast.fc_forecast(panel_table(spark, path), 24, targets=["temperature"])
    return f.withColumn("fuzzy_share", F.col("contributions")["fuzzy"])


@query("fc_forecast_all", keys="station ts", ints="step", nums="temperature humidity pressure wind_speed lower upper confidence")
def fc_forecast_all(spark, path):
    return forecast.fc_forecast(panel_table(spark, path), 24)


@query(
    "fc_train",
    "SELECT station, 'fuzzy' AS model_type, 'temperature' AS target, count(*) > 0 AS is_trained, count(*) AS n, avg(abs(prediction-actual)) AS mae, sqrt(avg(pow(prediction-actual,2))) AS rmse FROM fitted GROUP BY station HAVING count(*) >= 99"
    " UNION ALL SELECT station, 'arima', 'temperature', count(*) > 0, count(*), avg(abs(a+b*x-y)), sqrt(avg(pow(a+b*x-y,2))) FROM ar JOIN fit USING (station) WHERE x IS NOT NULL GROUP BY station HAVING count(*) >= 99",
    keys="station model_type target is_trained", ints="n", nums="mae rmse", ctes=PRED.replace("FROM gaps", "FROM panel") + ", " + AR1_FIT,
)
def fc_train(spark, path):
    return forecast.fc_train(located(panel_table(spark, path)), targets=["temperature"])


# ---- five families, trained, committed and read back (tests/test_families.py compares them with plain loops) ----------


def committed(spark, path):
    """Every family on every target, as one committed version: 100 trees of 10 levels, windows of 168 rows."""
    cfg = families.FamilyConfig(forest=forest.ForestConfig(trees=100, depth=10))
    obs, root = stored(located(panel_table(spark, path))), scratch(spark, "models")
    families.save(families.train(obs, cfg), root, "v1", datetime(2024, 2, 1), cfg)
    return obs, root, cfg


@query("fc_train_families", keys="station model_type version targets is_trained", ints="training_rows", nums="mae rmse")
def fc_train_families(spark, path):
    _, root, _ = committed(spark, path)
    return commits.read_all(spark, root, "registry").withColumn("targets", F.concat_ws(",", "targets"))


@query("fc_forecast_families", keys="station ts", ints="step families", nums="temperature humidity pressure wind_speed lower upper confidence")
def fc_forecast_families(spark, path):
    obs, root, cfg = committed(spark, path)
    return families.forecast(obs, families.load(spark, root), 24, cfg).withColumn("families", F.size("contributions"))


@query("mdl_window_moments", keys="station ts target", nums="actual prediction")
def mdl_window_moments(spark, path):
    """The last 168 rows, as in the longest training window, without a copied row."""
    obs = panel_table(spark, path)
    models = windowed.fit_windows(obs, 168)
    return windowed.predicted(obs, models, 168)


@query("int_tree_table", keys="station ts target", nums="prediction lower upper")
def int_tree_table(spark, path):
    train = forest_frame(spark, path, TARGETS)
    models = forest.mdl_forest(train, TARGETS, forest.ForestConfig(trees=100, depth=6))
    return trees.tree_spread(train, stored(trees.node_table(models, spark), "nodes"))


# ---- innovations and seasonal orders ----------------------------------------------------------------------------------

LAGGED = "SELECT station, ts, temperature AS y, lag(temperature) OVER w AS x, row_number() OVER w AS rn FROM panel WINDOW w AS (PARTITION BY station ORDER BY ts)"


@query(
    "innovations_scan",
    f"WITH RECURSIVE r AS ({LAGGED}), e AS (SELECT station, ts, rn, (y-15)-0.5::DOUBLE*(x-15) AS e FROM r WHERE rn = 2 UNION ALL"
    " SELECT r.station, r.ts, r.rn, (r.y-15)-0.5::DOUBLE*(r.x-15)-0.4::DOUBLE*e.e FROM e JOIN r ON r.station = e.station AND r.rn = e.rn + 1) SELECT station, ts, e FROM e",
    keys="station ts", nums="e",
)
def innovations_scan(spark, path):
    """Innovations of an ARMA(1, 1) with given parameters, in blocks of 100 rows."""
    obs = panel_table(spark, path)
    order = innovations.Order(1, 0, 1)
    c, ar, ma = order.polynomials([15.0, 0.5, 0.4])
    fixed = obs.select("station").distinct().withColumns({"params": F.array(F.lit(c)), "ar": F.array(*map(F.lit, ar.tolist())), "ma": F.array(*map(F.lit, ma.tolist()))})
    return innovations.residuals(obs, "temperature", fixed, order, block=100)


@query(
    "mdl_css_ar", f"SELECT station, count(*) AS n, regr_slope(y, x) AS phi, regr_intercept(y, x)/(1-regr_slope(y, x)) AS level FROM ({LAGGED}) WHERE x IS NOT NULL GROUP BY station",
    keys="station", ints="n", nums="phi level", digits=3,
)
def mdl_css_ar(spark, path):
    fits = innovations.fit_orders(panel_table(spark, path), "temperature", [innovations.Order(1)])
    return fits.select("station", "n", F.col("params")[0].alias("level"), F.col("params")[1].alias("phi"))


@query("mdl_css_arma", keys="station", ints="n", nums="c phi theta season_phi season_theta sigma", digits=2)
def mdl_css_arma(spark, path):
    """(1, 0, 1)(1, 0, 1) with a day as season, by Gauss-Newton; tests/test_innovations.py has plain loops."""
    fits = innovations.fit_orders(panel_table(spark, path), "temperature", [innovations.Order(1, 0, 1, 1, 0, 1, 24)])
    names = ("c", "phi", "theta", "season_phi", "season_theta")
    return fits.select("station", "n", "sigma", *[F.col("params")[i].alias(n) for i, n in enumerate(names)])


@query("mdl_order_seasonal", keys="station", ints="p d q sp sd sq n", nums="sigma", digits=2)
def mdl_order_seasonal(spark, path):
    grid = innovations.order_grid(p=(0, 1), q=(0, 1), period=24)
    return innovations.best_seasonal(innovations.fit_orders(panel_table(spark, path), "temperature", grid))


# ---- streams ------------------------------------------------------------------------------------------------------


@query(
    "st_panel",
    "SELECT * FROM panel WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    keys="station ts", nums=" ".join(BASE),
)
def st_panel(spark, path):
    out = jobs.run_to_table(jobs.st_panel(jobs.read_events_stream(spark, path)), scratch(spark, "st-panel"))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("st_ingest", "SELECT DISTINCT event_type AS station, date_trunc('hour', ts)::TIMESTAMP AS obs_ts FROM events", keys="station obs_ts")
def st_ingest(spark, path):
    e = jobs.read_events_stream(spark, path)
    obs = e.select(F.col("event_type").alias("station"), F.date_trunc("hour", "ts").alias("obs_ts"), "ts")
    out = jobs.run_to_table(jobs.st_ingest(obs), scratch(spark, "st-ingest"))
    return out.withColumn("obs_ts", F.col("obs_ts").cast("timestamp_ntz"))


@query(
    "st_rules", "SELECT station, antecedent, consequent, n FROM pairs0", keys="station antecedent consequent", ints="n",
    ctes=RULES.replace("FROM gaps", "FROM panel"),
)
def st_rules(spark, path):
    labels = fuzzy.prepare(panel_table(spark, path))[1].select("station", "ts", "label")
    return jobs.rule_counts(jobs.in_two_parts(labels, F.dayofmonth("ts") <= 12, jobs.st_rules, ["station"], "st-rules"))


@query(
    "st_errors",
    "SELECT station, model, ts, abs(actual-prediction) AS abs_error FROM (SELECT *, row_number() OVER (PARTITION BY station, model ORDER BY ts DESC) AS r FROM flog WHERE prediction IS NOT NULL) WHERE r <= 100",
    keys="station model ts", nums="abs_error",
)
def st_errors(spark, path):
    log = forecast_log(panel(spark, path)).select("station", "model", "ts", F.abs(F.col("actual") - F.col("prediction")).alias("abs_error"))
    state = jobs.in_two_parts(log, F.dayofmonth("ts") <= 28, jobs.st_errors, ["station", "model"], "st-errors")
    return jobs.recent_errors(state, log.schema["ts"].dataType.simpleString())


@query(
    "st_provider_health", "SELECT * FROM health", keys="provider last_failure is_healthy", ints="total_requests successful_requests consecutive_failures",
    ctes=HEALTH,
)
def st_provider_health(spark, path):
    log = provider_log(spark, path)
    state = jobs.in_two_parts(log, F.dayofmonth("ts") <= 15, jobs.st_provider_health, ["provider"], "st-health")
    return jobs.health_status(state, ts_type=log.schema["ts"].dataType.simpleString())
