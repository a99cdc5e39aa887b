"""Validation, missing values, outliers, scaling, splits, selection and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from wxspark.catalog.base import query
from wxspark.operators import clean, metrics, places, quality, select, split, timeline
from wxspark.schema import BASE, TARGETS
from wxspark.sources.panel import customer_points, forecast_log, located, panel, panel_gaps, panel_table

REASONS = [
    ("temperature IS NULL", "temperature missing"),
    ("humidity < 0 OR humidity > 100", "humidity out of range"),
    ("pressure <= 0", "pressure out of range"),
    ("wind_speed < 0", "wind_speed out of range"),
    ("wind_direction < 0 OR wind_direction > 360", "wind_direction out of range"),
    ("cloud_cover < 0 OR cloud_cover > 100", "cloud_cover out of range"),
    ("precipitation < 0", "precipitation out of range"),
]
REASON_SQL = "concat_ws(';', " + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in REASONS) + ")"


@query(
    "val_obs",
    # Shifted values, so that every kind of violation occurs.
    f"SELECT station, ts, {REASON_SQL} AS reasons, {REASON_SQL} = '' AS is_valid FROM (SELECT station, ts, temperature,"
    " humidity + 10 AS humidity, pressure - 990 AS pressure, wind_speed - 1 AS wind_speed, wind_direction + 5 AS wind_direction,"
    " cloud_cover + 3 AS cloud_cover, precipitation - 1 AS precipitation FROM gaps)",
    keys="station ts reasons is_valid",
)
def val_obs(spark, path):
    moves = {"humidity": 10, "pressure": -990, "wind_speed": -1, "wind_direction": 5, "cloud_cover": 3, "precipitation": -1}
    obs = panel_gaps(spark, path).withColumns({c: F.col(c) + d for c, d in moves.items()})
    return quality.val_obs(obs).withColumn("reasons", F.concat_ws(";", "reasons"))


@query(
    "val_coords",
    "SELECT id, lat*4-30 BETWEEN -90 AND 90 AND lon*2 BETWEEN -180 AND 180 AS valid_coords FROM points",
    keys="id valid_coords",
)
def val_coords(spark, path):
    p = customer_points(spark, path)
    return quality.val_coords(p.withColumns({"latitude": F.col("lat") * 4 - 30, "longitude": F.col("lon") * 2}))


@query(
    "val_requests",
    "SELECT c_custkey, coalesce(h, 24) AS horizon, coalesce(coalesce(h, 24) BETWEEN 1 AND 168 AND length(q) BETWEEN 2 AND 100 AND"
    " l BETWEEN 1 AND 50 AND cl BETWEEN 1 AND 20, false) AS valid_request FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0"
    " THEN c_custkey % 200 END AS h, substr(c_name, 1, CAST(c_custkey % 5 AS INT)) AS q, c_custkey % 55 AS l, c_custkey % 23 AS cl FROM customer)",
    keys="c_custkey valid_request", ints="horizon",
)
def val_requests(spark, path):
    k = F.col("c_custkey")
    r = spark.read.parquet(f"{path}/customer.parquet").select(
        "c_custkey", F.when(k % 10 != 0, k % 200).alias("horizon"), F.substring("c_name", F.lit(1), (k % 5).cast("int")).alias("query"),
        (k % 55).alias("limit"), (k % 23).alias("city_limit"),
    )
    return quality.val_requests(r)


@query(
    "val_model_type",
    "SELECT event_id, t IN ('lstm','arima','random_forest','fuzzy','lube','ensemble') AS valid_model_type FROM (SELECT event_id,"
    " CASE event_id % 4 WHEN 0 THEN 'arima' WHEN 1 THEN 'fuzzy' WHEN 2 THEN event_type ELSE 'ARIMA' END AS t FROM events)",
    keys="event_id valid_model_type",
)
def val_model_type(spark, path):
    m = F.col("event_id") % 4
    t = F.when(m == 0, "arima").when(m == 1, "fuzzy").when(m == 2, F.col("event_type")).otherwise("ARIMA")
    return quality.val_model_type(spark.read.parquet(f"{path}/events.parquet").select("event_id", t.alias("model_type")))


@query(
    "bbox_filter",
    "SELECT id, lat, lon FROM points WHERE lat BETWEEN 19.076-2.0 AND 19.076+2.0 AND lon BETWEEN 72.8777-2.0 AND 72.8777+2.0",
    keys="id", nums="lat lon",
)
def bbox_filter(spark, path):
    return quality.bbox_filter(customer_points(spark, path), 19.076, 72.8777, tol=2.0, lat_col="lat", lon_col="lon")


@query(
    "min_rows_gate",
    "SELECT station, ts, temperature FROM (SELECT *, count(*) OVER (PARTITION BY station) AS c FROM (SELECT user_id AS station,"
    " ts, value AS temperature FROM events)) WHERE c >= 10",
    keys="station ts", nums="temperature",
)
def min_rows_gate(spark, path):
    e = spark.read.parquet(f"{path}/events.parquet")
    return quality.min_rows_gate(e.select(F.col("user_id").alias("station"), "ts", F.col("value").alias("temperature")), stage="fuzzy")


@query(
    "drop_nan_rows",
    "SELECT station, ts, temperature, humidity FROM gaps WHERE temperature IS NOT NULL AND humidity <> 0",
    keys="station ts", nums="temperature humidity",
)
def drop_nan_rows(spark, path):
    g = panel_gaps(spark, path).withColumn("humidity", F.when(F.col("humidity") == 0, F.lit(float("nan"))).otherwise(F.col("humidity")))
    return clean.drop_nan_rows(g, ["temperature", "humidity"])


@query(
    "nan_to_num",
    "SELECT station, ts, coalesce(temperature, 0) AS temperature, CASE WHEN humidity >= 50 THEN humidity ELSE 0 END AS humidity FROM gaps",
    keys="station ts", nums="temperature humidity",
)
def nan_to_num(spark, path):
    h = F.col("humidity")
    g = panel_gaps(spark, path).withColumn(
        "humidity", F.when(h >= 50, h).when(h >= 25, F.lit(float("inf"))).when(h >= 10, F.lit(float("nan"))).otherwise(F.lit(float("-inf")))
    )
    return clean.nan_to_num(g, ["temperature", "humidity"])


@query(
    "agg_quality",
    """SELECT station, total_records, start_ts, end_ts, date_diff('second', start_ts, end_ts)/3600.0 AS duration_hours, missing AS missing_data_percentage,
       concat_ws(';', CASE WHEN missing > 20 THEN printf('High missing data: %.1f%%', missing) END,
         CASE WHEN total_records < 24 THEN printf('Insufficient data: %d records', total_records) END,
         CASE WHEN t0 < -50 OR t1 > 60 THEN printf('Extreme temperature values: %.1f to %.1f', round(t0+1e-9,1), round(t1+1e-9,1)) END,
         CASE WHEN h0 < 0 OR h1 > 100 THEN printf('Invalid humidity values: %.1f to %.1f', round(h0+1e-9,1), round(h1+1e-9,1)) END,
         CASE WHEN p0 < 800 OR p1 > 1100 THEN printf('Extreme pressure values: %.1f to %.1f', round(p0+1e-9,1), round(p1+1e-9,1)) END) AS issues,
       (CASE WHEN missing > 20 THEN 1 ELSE 0 END + CASE WHEN total_records < 24 THEN 1 ELSE 0 END
         + CASE WHEN t0 < -50 OR t1 > 60 THEN 1 ELSE 0 END + CASE WHEN h0 < 0 OR h1 > 100 THEN 1 ELSE 0 END
         + CASE WHEN p0 < 800 OR p1 > 1100 THEN 1 ELSE 0 END) <= 2 AS is_valid
       FROM (SELECT station, count(*) AS total_records, min(ts) AS start_ts, max(ts) AS end_ts,
             100.0::DOUBLE * (count(*) - count(temperature)) / (count(*) * 10) AS missing, min(temperature) AS t0, max(temperature) AS t1,
             min(humidity) AS h0, max(humidity) AS h1, min(pressure) AS p0, max(pressure) AS p1 FROM gaps GROUP BY station)""",
    keys="station start_ts end_ts issues is_valid", ints="total_records", nums="duration_hours missing_data_percentage",
)
def agg_quality(spark, path):
    q = quality.agg_quality(located(panel_gaps(spark, path)))
    return q.withColumn("issues", F.concat_ws(";", "issues"))


def each(fn, cols=BASE, src="m"):
    return ", ".join(fn(c) for c in cols)


@query(
    "cl_impute_median",
    "SELECT station, ts, coalesce(temperature, median(temperature) OVER (PARTITION BY station)) AS temperature, humidity FROM gaps",
    keys="station ts", nums="temperature humidity",
)
def cl_impute_median(spark, path):
    return clean.cl_impute_median(panel_gaps(spark, path), columns=["temperature", "humidity"])


QUART = ", ".join(
    f"quantile_cont({c}, 0.25) AS {c}_a, quantile_cont({c}, 0.75) AS {c}_b, median({c}) AS {c}_m, stddev_samp({c}) AS {c}_s,"
    f" stddev_pop({c}) AS {c}_p, avg({c}) AS {c}_v, min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in BASE
)
QCTE = f"q AS (SELECT station, {QUART} FROM panel GROUP BY station)"


@query(
    "cl_outlier_iqr",
    "SELECT station, ts, " + each(lambda c: f"greatest(least({c}, {c}_b+1.5::DOUBLE*({c}_b-{c}_a)), {c}_a-1.5::DOUBLE*({c}_b-{c}_a)) AS {c}")
    + " FROM panel JOIN q USING (station)",
    keys="station ts", nums=" ".join(BASE), ctes=QCTE,
)
def cl_outlier_iqr(spark, path):
    return clean.cl_outlier_iqr(panel_table(spark, path))


@query(
    "cl_outlier_zscore",
    "SELECT station, ts, " + each(lambda c: f"CASE WHEN abs({c}-{c}_v)/{c}_s > 2 THEN {c}_m ELSE {c} END AS {c}")
    + " FROM panel JOIN q USING (station)",
    keys="station ts", nums=" ".join(BASE), ctes=QCTE,
)
def cl_outlier_zscore(spark, path):
    return clean.cl_outlier_zscore(panel_table(spark, path), threshold=2.0)


SCALE = {
    "sca_standard": lambda c: f"({c}-{c}_v)/CASE WHEN {c}_p = 0 THEN 1 ELSE {c}_p END AS {c}",
    "sca_minmax": lambda c: f"({c}-{c}_lo)/CASE WHEN {c}_hi = {c}_lo THEN 1 ELSE {c}_hi-{c}_lo END AS {c}",
    "sca_robust": lambda c: f"({c}-{c}_m)/CASE WHEN {c}_b = {c}_a THEN 1 ELSE {c}_b-{c}_a END AS {c}",
}


def _scaler(name):
    @query(
        name, "SELECT station, ts, " + each(SCALE[name]) + " FROM panel JOIN q USING (station)",
        keys="station ts", nums=" ".join(BASE), ctes=QCTE,
    )
    def _(spark, path):
        return getattr(clean, name)(panel_table(spark, path), columns=BASE)


for _n in SCALE:
    _scaler(_n)


@query(
    "sca_inverse",
    "SELECT station, ts, " + ", ".join(TARGETS) + " FROM panel",
    keys="station ts", nums=" ".join(TARGETS),
)
def sca_inverse(spark, path):
    obs = panel_table(spark, path)
    shape = timeline.measure(obs)
    params = clean.fit_scaler(obs, "standard", TARGETS, shape=shape)
    scaled = clean.apply_scaler(obs, params, TARGETS, rows=shape.series)
    return clean.apply_scaler(scaled, params, TARGETS, rows=shape.series, inverse=True)


INTERP = """
num AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts) AS rn FROM gaps),
near AS (SELECT station, ts, rn, temperature,
  max(CASE WHEN temperature IS NOT NULL THEN rn END) OVER (PARTITION BY station ORDER BY ts) AS p0,
  min(CASE WHEN temperature IS NOT NULL THEN rn END) OVER (PARTITION BY station ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1 FROM num),
filled AS (SELECT n.station, n.ts, coalesce(n.temperature, a.temperature + (b.temperature-a.temperature)*((n.rn-p0)/CAST(p1-p0 AS DOUBLE)), b.temperature, a.temperature) AS temperature
  FROM near n LEFT JOIN num a ON a.station = n.station AND a.rn = p0 LEFT JOIN num b ON b.station = n.station AND b.rn = p1)
"""


@query("win_interpolate", "SELECT station, ts, temperature FROM filled", keys="station ts", nums="temperature", ctes=INTERP)
def win_interpolate(spark, path):
    return clean.win_interpolate(panel_gaps(spark, path)).select("station", "ts", "temperature")


@query(
    "win_carry_label",
    "SELECT station, ts, coalesce(last_value(l IGNORE NULLS) OVER (PARTITION BY station ORDER BY ts), 'VeryLow') AS label FROM"
    " (SELECT station, ts, CASE WHEN temperature > 20 THEN 'High' WHEN temperature <= 20 THEN 'Low' END AS l FROM gaps)",
    keys="station ts label",
)
def win_carry_label(spark, path):
    t = F.col("temperature")
    g = panel_gaps(spark, path).select("station", "ts", F.when(t > 20, "High").when(t <= 20, "Low").alias("label"))
    return clean.win_carry_label(g)


# ---- splits -------------------------------------------------------------------------------------------------------

NUM = "num AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY station) AS n FROM panel)"


@query(
    "win_split",
    "SELECT station, ts, CASE WHEN pos < floor(n*(1-0.2::DOUBLE-0.1::DOUBLE)) THEN 'train' WHEN pos < floor(n*(1-0.2::DOUBLE)) THEN 'validation' ELSE 'test' END AS role FROM num",
    keys="station ts role", ctes=NUM,
)
def win_split(spark, path):
    return split.win_split(panel(spark, path).select("station", "ts"))


@query(
    "win_split_frac",
    "SELECT station, ts, CASE WHEN pos < floor(n*0.8::DOUBLE) THEN 'train' WHEN pos < floor(n*0.8::DOUBLE) + floor(n*0.1::DOUBLE) THEN 'validation' ELSE 'rest' END AS role FROM num",
    keys="station ts role", ctes=NUM,
)
def win_split_frac(spark, path):
    return split.win_split_frac(panel(spark, path).select("station", "ts"))


@query(
    "win_cv_folds",
    "SELECT station, ts, fold, CASE WHEN pos >= (n//6)*(fold+1) THEN 'validation' ELSE 'train' END AS role FROM num, range(0,5) f(fold) WHERE pos < (n//6)*(fold+2)",
    keys="station ts role", ints="fold", ctes=NUM,
)
def win_cv_folds(spark, path):
    return split.win_cv_folds(panel(spark, path).select("station", "ts"))


SEQ_SQL = "SELECT station, ts, {agg} FROM (SELECT station, ts, n, pos, temperature, pressure, {cols} FROM num WINDOW w AS (PARTITION BY station ORDER BY ts ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)) WHERE {keep}"


def _digest(df, extra=()):
    """Checksums of the window: total, first and last step, length."""
    w = F.col("window")
    return df.select(
        "station", "ts", F.size(w).alias("length"), F.aggregate(w, F.lit(0.0), lambda a, s: a + s[0]).alias("sum_t"),
        F.aggregate(w, F.lit(0.0), lambda a, s: a + s[1]).alias("sum_p"), w[0][0].alias("first_t"), F.element_at(w, -1)[1].alias("last_p"), *extra,
    )


DIGEST_SQL = "24 AS length, sum(temperature) OVER w AS sum_t, sum(pressure) OVER w AS sum_p, first_value(temperature) OVER w AS first_t, last_value(pressure) OVER w AS last_p"


@query(
    "win_sequences",
    f"SELECT station, ts, length, sum_t, sum_p, first_t, last_p, next_t FROM (SELECT station, ts, pos, n, {DIGEST_SQL}, lead(temperature, 24) OVER (PARTITION BY station ORDER BY ts) AS next_t FROM num"
    " WINDOW w AS (PARTITION BY station ORDER BY ts ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)) WHERE pos + 24 < n",
    keys="station ts", ints="length", nums="sum_t sum_p first_t last_p next_t", ctes=NUM,
)
def win_sequences(spark, path):
    s = split.win_sequences(panel(spark, path), length=24, features=["temperature", "pressure"], targets=["temperature"])
    return _digest(s, [F.col("next_temperature").alias("next_t")])


@query(
    "win_sequences_predict",
    f"SELECT * FROM (SELECT station, ts, pos, n, {DIGEST_SQL} FROM num"
    " WINDOW w AS (PARTITION BY station ORDER BY ts ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)) WHERE pos + 24 <= n",
    keys="station ts", ints="length", nums="sum_t sum_p first_t last_p", ctes=NUM,
)
def win_sequences_predict(spark, path):
    return _digest(split.win_sequences_predict(panel(spark, path), length=24, features=["temperature", "pressure"]))


@query(
    "win_sequences_last",
    f"SELECT * FROM (SELECT station, ts, pos, n, {DIGEST_SQL} FROM num"
    " WINDOW w AS (PARTITION BY station ORDER BY ts ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)) WHERE pos + 24 = n",
    keys="station ts", ints="length", nums="sum_t sum_p first_t last_p", ctes=NUM,
)
def win_sequences_last(spark, path):
    s = split.win_sequences_predict(panel(spark, path), length=24, features=["temperature", "pressure"], last_only=True)
    return _digest(s)


@query(
    "win_history_bound",
    "SELECT station, model, ts, prediction FROM (SELECT *, row_number() OVER (PARTITION BY station, model ORDER BY ts DESC) AS r FROM flog) WHERE r <= 100",
    keys="station model ts", nums="prediction",
)
def win_history_bound(spark, path):
    return split.win_history_bound(forecast_log(panel(spark, path)), keys=["station", "model"])


@query(
    "latest_row", "SELECT station, ts, temperature, pressure FROM num WHERE pos = n - 1", keys="station ts", nums="temperature pressure", ctes=NUM,
)
def latest_row(spark, path):
    return split.latest_row(panel(spark, path))


# Recent rows of users: most have fewer than 24 events, a few have more.
USER_OBS = "uo AS (SELECT user_id, ts, event_id, value FROM events)"


@query(
    "pad_recent",
    "SELECT user_id, event_id, copy, value FROM (SELECT user_id, event_id, value, NULL AS copy, count(*) OVER (PARTITION BY user_id) AS c FROM uo) WHERE c >= 24"
    " UNION ALL SELECT user_id, event_id, copy, value FROM (SELECT user_id, event_id, value, count(*) OVER (PARTITION BY user_id) AS c,"
    " row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM uo), range(1, 25) x(copy) WHERE c < 24 AND r = 1",
    keys="user_id event_id", ints="copy", nums="value", ctes=USER_OBS,
)
def pad_recent(spark, path):
    obs = spark.read.parquet(f"{path}/events.parquet").select("user_id", "event_id", "value")
    current = split.latest_row(obs, station="user_id", ts="event_id")
    return split.pad_recent(obs, current, station="user_id", ts="event_id")


@query("sort_ts", "SELECT station, ts, temperature FROM panel", keys="station ts", nums="temperature")
def sort_ts(spark, path):
    return timeline.sort_ts(panel(spark, path))


# ---- selection ----------------------------------------------------------------------------------------------------

RANKED = ["humidity", "pressure", "wind_speed", "wind_direction", "cloud_cover", "precipitation"]


def _corr(feature: str) -> str:
    """0 where the correlation is undefined: null on too few rows, not a number for a constant column."""
    r = f"corr({feature}, temperature)"
    return f"CASE WHEN {r} IS NULL OR isnan({r}) THEN 0 ELSE abs({r}) END"


def _rank_cte(score) -> str:
    items = ", ".join(f"{{'feature': '{f}', 'score': {score(f)}}}" for f in RANKED)
    return (
        f"c AS (SELECT station, UNNEST([{items}], recursive := true) FROM panel GROUP BY station),"
        " ranked AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY round(score, 6) DESC, feature) AS rank FROM c)"
    )


@query(
    "agg_corr_rank", "SELECT * FROM ranked", keys="station feature", ints="rank", nums="score",
    ctes=_rank_cte(_corr),
)
def agg_corr_rank(spark, path):
    return select.agg_corr_rank(panel(spark, path), RANKED, "temperature")


@query(
    "agg_variance_rank", "SELECT * FROM ranked", keys="station feature", ints="rank", nums="score",
    ctes=_rank_cte(lambda f: f"var_pop({f})"), digits=4,
)
def agg_variance_rank(spark, path):
    return select.agg_variance_rank(panel(spark, path), RANKED)


@query(
    "topk_features", "SELECT * FROM ranked WHERE rank <= 3", keys="station feature", ints="rank", nums="score",
    ctes=_rank_cte(_corr),
)
def topk_features(spark, path):
    return select.topk_features(select.agg_corr_rank(panel(spark, path), RANKED, "temperature"), k=3)


IMP_CTE = (
    "imp AS (SELECT user_id % 40 AS g, event_type || '_' || (event_id % 12) AS feature, sum(CAST(round(value*100) AS BIGINT)) AS s FROM events GROUP BY 1, 2),"
    " imp2 AS (SELECT g, feature, CASE WHEN g % 4 = 0 THEN s/1e9::DOUBLE ELSE s/CAST(sum(s) OVER (PARTITION BY g) AS DOUBLE) END AS importance FROM imp),"
    " imp3 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY importance DESC, feature) AS rank, count(*) FILTER (importance > 0.001) OVER (PARTITION BY g) AS above FROM imp2)"
)


@query(
    "topk_importance",
    "SELECT g, feature, rank, importance FROM imp3 WHERE CASE WHEN above < 5 THEN rank <= 10 ELSE importance > 0.001 AND rank <= 50 END",
    keys="g feature", ints="rank", nums="importance", ctes=IMP_CTE, digits=9,
)
def topk_importance(spark, path):
    from pyspark.sql import Window

    e = spark.read.parquet(f"{path}/events.parquet")
    s = e.groupBy(
        (F.col("user_id") % 40).alias("g"), F.concat_ws("_", "event_type", (F.col("event_id") % 12).cast("string")).alias("feature")
    ).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("s"))
    share = F.col("s") / F.sum("s").over(Window.partitionBy("g"))
    scores = s.withColumn("importance", F.when(F.col("g") % 4 == 0, F.col("s") / F.lit(1e9)).otherwise(share))
    return select.topk_importance(scores, keys=["g"])


# ---- metrics ------------------------------------------------------------------------------------------------------

EPS = "2.220446049250313e-16::DOUBLE"
BASIC = (
    "count(*) AS n, avg(abs(prediction-actual)) AS mae, sqrt(avg(pow(prediction-actual, 2))) AS rmse,"
    f" avg(abs(prediction-actual)/greatest(abs(actual), {EPS}))*100 AS mape"
)
DETAIL = BASIC + (
    ", 1 - sum(pow(prediction-actual,2))/(var_pop(actual)*count(*)) AS r2, avg(prediction-actual) AS mean_error, stddev_pop(prediction-actual) AS std_error"
)
PAIRS = "pairs AS (SELECT * FROM flog WHERE prediction IS NOT NULL AND abs(actual) > 0.01)"


def pairs(spark, path):
    return forecast_log(panel(spark, path)).filter(F.abs("actual") > 0.01)


@query(
    "agg_metrics", f"SELECT station, model, {BASIC} FROM pairs GROUP BY station, model",
    keys="station model", ints="n", nums="mae rmse mape", ctes=PAIRS,
)
def agg_metrics(spark, path):
    return metrics.agg_metrics(pairs(spark, path), by=["station", "model"])


@query(
    "agg_metrics_detailed", f"SELECT station, model, {DETAIL} FROM pairs GROUP BY station, model",
    keys="station model", ints="n", nums="mae rmse mape r2 mean_error std_error", ctes=PAIRS,
)
def agg_metrics_detailed(spark, path):
    return metrics.agg_metrics_detailed(pairs(spark, path), by=["station", "model"])


@query(
    "agg_metric_mean",
    f"SELECT station, avg(mae) AS mae, avg(rmse) AS rmse, avg(mape) AS mape FROM (SELECT station, model, {BASIC} FROM pairs GROUP BY station, model) GROUP BY station",
    keys="station", nums="mae rmse mape", ctes=PAIRS,
)
def agg_metric_mean(spark, path):
    return metrics.agg_metric_mean(metrics.agg_metrics(pairs(spark, path), by=["station", "model"]), by=["station"])


BAND = "band AS (SELECT station, model, actual, prediction, prediction - 15 AS lower, prediction + 15 AS upper FROM pairs)"
WIDTH = "avg(upper-lower)/CASE WHEN max(actual)=min(actual) THEN 1 ELSE max(actual)-min(actual) END"
COVER = "avg(CASE WHEN actual BETWEEN lower AND upper THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def band(spark, path):
    p = pairs(spark, path).filter(F.col("prediction").isNotNull())
    return p.withColumns({"lower": F.col("prediction") - 15, "upper": F.col("prediction") + 15})


@query(
    "agg_coverage", f"SELECT station, model, {COVER} AS coverage, avg(upper-lower) AS mean_width, {WIDTH} AS normalized_width FROM band GROUP BY station, model",
    keys="station model", nums="coverage mean_width normalized_width", ctes=f"{PAIRS}, {BAND}",
)
def agg_coverage(spark, path):
    return metrics.agg_coverage(band(spark, path), by=["station", "model"])


@query(
    "agg_interval_loss",
    f"SELECT station, model, avg(pow(prediction-actual,2)) + 50*pow(greatest(0, 0.95::DOUBLE-{COVER}),2) + {WIDTH} AS interval_loss FROM band GROUP BY station, model",
    keys="station model", nums="interval_loss", ctes=f"{PAIRS}, {BAND}",
)
def agg_interval_loss(spark, path):
    return metrics.agg_interval_loss(band(spark, path), by=["station", "model"])


@query(
    "agg_series_profile",
    "SELECT station, count(*) AS length, avg(temperature) AS mean, stddev_samp(temperature) AS std FROM panel GROUP BY station",
    keys="station", ints="length", nums="mean std",
)
def agg_series_profile(spark, path):
    from wxspark.operators import series

    return series.agg_series_profile(panel(spark, path), target="temperature")


CV_CTE = (
    NUM + ", folds AS (SELECT num.*, fold, CASE WHEN pos >= (n//6)*(fold+1) THEN 'validation' ELSE 'train' END AS role FROM num, range(0,5) f(fold) WHERE pos < (n//6)*(fold+2)),"
    " fit AS (SELECT station, fold, avg(temperature) AS m FROM folds WHERE role = 'train' GROUP BY 1, 2),"
    " fm AS (SELECT station, fold, avg(abs(m-temperature)) AS mae, sqrt(avg(pow(m-temperature,2))) AS rmse FROM folds JOIN fit USING (station, fold) WHERE role = 'validation' GROUP BY 1, 2)"
)


@query(
    "agg_cv_summary",
    "SELECT station, avg(mae) AS mae_mean, stddev_pop(mae) AS mae_std, avg(rmse) AS rmse_mean, stddev_pop(rmse) AS rmse_std FROM fm GROUP BY station",
    keys="station", nums="mae_mean mae_std rmse_mean rmse_std", ctes=CV_CTE,
)
def agg_cv_summary(spark, path):
    folds = split.win_cv_folds(panel(spark, path).select("station", "ts", "temperature"))
    fit = folds.filter("role = 'train'").groupBy("station", "fold").agg(F.avg("temperature").alias("prediction"))
    scored = folds.filter("role = 'validation'").join(fit, ["station", "fold"])
    m = metrics.agg_metrics(scored, by=["station", "fold"], truth="temperature")
    return metrics.agg_cv_summary(m, names=["mae", "rmse"])
