"""Fuzzy forecasts, ensembles and intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wxspark.catalog.base import query
from wxspark.catalog.cleaning import INTERP, PAIRS
from wxspark.operators import ensemble as E
from wxspark.operators import fuzzy as Z
from wxspark.operators import intervals, metrics, timeline
from wxspark.sources.panel import forecast_log, panel, panel_gaps, panel_table
from wxspark.session import stored

TERMS = Z.TERMS
UNIVERSE = (
    INTERP + ", uni AS (SELECT station, min(temperature) - 0.1::DOUBLE*(max(temperature)-min(temperature)) AS u_min,"
    " max(temperature) + 0.1::DOUBLE*(max(temperature)-min(temperature)) AS u_max FROM filled GROUP BY station)"
)
SETS = UNIVERSE + (
    ", sets AS (SELECT station, i AS set_no, [" + ", ".join(f"'{t}'" for t in TERMS) + "][i+1] AS label,"
    " u_min + CAST(i AS DOUBLE)*((u_max-u_min)/6.0::DOUBLE) AS center, (u_max-u_min)/6.0::DOUBLE*1.5 AS width, u_min, u_max FROM uni, range(0,7) r(i)),"
    " mem AS (SELECT f.station, f.ts, f.temperature, s.set_no, s.label, CASE WHEN abs(temperature-center) <= width THEN 1-abs(temperature-center)/width ELSE 0 END AS m"
    " FROM filled f JOIN sets s USING (station)),"
    " lab AS (SELECT station, ts, temperature, set_no, label FROM (SELECT *, row_number() OVER (PARTITION BY station, ts ORDER BY m DESC, set_no) AS r FROM mem) WHERE r = 1),"
    " ante AS (SELECT *, lag(label) OVER (PARTITION BY station ORDER BY ts) AS antecedent FROM lab)"
)
RULES = SETS + (
    ", pairs0 AS (SELECT station, antecedent, label AS consequent, count(*) AS n FROM ante WHERE antecedent IS NOT NULL GROUP BY 1, 2, 3),"
    " rules AS (SELECT * FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY station, antecedent) AS BIGINT) AS support, n/CAST(sum(n) OVER (PARTITION BY station, antecedent) AS DOUBLE) AS weight FROM pairs0) WHERE support >= 2),"
    " rv AS (SELECT r.station, antecedent, sum(center*n)/sum(n) AS rule_value, stddev_pop(center) AS spread, count(*) AS outcomes FROM rules r JOIN sets s ON s.station = r.station AND s.label = r.consequent GROUP BY 1, 2)"
)
PRED = RULES + (
    ", fitted AS (SELECT a.station, a.ts, temperature AS actual, coalesce(rule_value, center) AS prediction FROM ante a LEFT JOIN rv USING (station, antecedent)"
    " LEFT JOIN sets s ON s.station = a.station AND s.label = a.antecedent WHERE a.antecedent IS NOT NULL)"
)
NEXT = RULES + (
    ", nxt AS (SELECT l.station, l.antecedent, coalesce(rule_value, center) AS prediction, CASE WHEN outcomes IS NULL THEN 0.2::DOUBLE*(u_max-u_min) WHEN outcomes > 1 THEN spread ELSE 0.05::DOUBLE*(u_max-u_min) END AS s"
    " FROM (SELECT station, max_by(label, ts) AS antecedent FROM lab GROUP BY station) l LEFT JOIN rv USING (station, antecedent) LEFT JOIN sets s2 ON s2.station = l.station AND s2.label = l.antecedent)"
)


def gaps_table(spark, path):
    return stored(panel_gaps(spark, path), "gaps")


@query("fz_universe", "SELECT * FROM uni", keys="station", nums="u_min u_max", ctes=UNIVERSE)
def fz_universe(spark, path):
    return Z.fz_universe(panel_gaps(spark, path))


@query("fz_sets", "SELECT * FROM sets", keys="station label", ints="set_no", nums="center width", ctes=SETS)
def fz_sets(spark, path):
    return Z.fz_sets(Z.fz_universe(panel_gaps(spark, path)))


@query("sc_membership", "SELECT station, ts, label, m AS membership FROM mem", keys="station ts label", nums="membership", ctes=SETS)
def sc_membership(spark, path):
    obs = gaps_table(spark, path)
    from wxspark.operators.clean import win_interpolate

    shape = timeline.measure(obs)
    filled = win_interpolate(obs, shape=shape)
    sets = Z.fz_sets(Z.fz_universe(filled))
    j = timeline.join_small(filled, sets, ["station"], shape.series * len(TERMS))
    return j.withColumn("membership", Z.membership(F.col("temperature"), F.col("center"), F.col("width")))


@query("fz_fuzzify", "SELECT * FROM lab", keys="station ts label", ints="set_no", ctes=SETS)
def fz_fuzzify(spark, path):
    return Z.prepare(gaps_table(spark, path))[1]


@query("win_antecedent", "SELECT station, ts, CASE WHEN l2 IS NOT NULL THEN l2 || ',' || l1 END AS antecedent FROM (SELECT station, ts, lag(label, 2) OVER w AS l2, lag(label) OVER w AS l1 FROM lab WINDOW w AS (PARTITION BY station ORDER BY ts))",
       keys="station ts antecedent", ctes=SETS)
def win_antecedent(spark, path):
    return Z.prepare(gaps_table(spark, path), Z.FuzzyConfig(order=2))[1]


@query("agg_rule_counts", "SELECT * FROM rules", keys="station antecedent consequent", ints="n support", nums="weight", ctes=RULES)
def agg_rule_counts(spark, path):
    return Z.agg_rule_counts(Z.prepare(gaps_table(spark, path))[1])


@query(
    "agg_rules_text",
    "SELECT station, antecedent, max(support) AS support, 'IF ' || antecedent || ' THEN [' || string_agg(t, ', ' ORDER BY t) || ']' AS rule FROM (SELECT *, printf('%s:%.3f', consequent, weight + 1e-9) AS t FROM rules) GROUP BY station, antecedent",
    keys="station antecedent rule", ints="support", ctes=RULES,
)
def agg_rules_text(spark, path):
    return Z.agg_rules_text(Z.agg_rule_counts(Z.prepare(gaps_table(spark, path))[1]))


@query("fz_defuzzify", "SELECT * FROM rv", keys="station antecedent", ints="outcomes", nums="rule_value", ctes=RULES)
def fz_defuzzify(spark, path):
    universe, lab = Z.prepare(gaps_table(spark, path))
    return Z.fz_defuzzify(Z.agg_rule_counts(lab), universe)


@query("fz_fitted", "SELECT * FROM fitted", keys="station ts", nums="actual prediction", ctes=PRED)
def fz_fitted(spark, path):
    return Z.fz_fitted(gaps_table(spark, path))


@query(
    "fz_backtest",
    "SELECT station, count(*) AS n, avg(abs(prediction-actual)) AS mae, sqrt(avg(pow(prediction-actual,2))) AS rmse FROM fitted GROUP BY station",
    keys="station", ints="n", nums="mae rmse", ctes=PRED,
)
def fz_backtest(spark, path):
    return Z.fz_backtest(gaps_table(spark, path))


@query("fz_predict", "SELECT * FROM nxt", keys="station antecedent", nums="prediction", ctes=NEXT)
def fz_predict(spark, path):
    return Z.fz_predict(gaps_table(spark, path))


@query("fz_interval", "SELECT station, antecedent, prediction, prediction-1.96*s AS lower, prediction+1.96*s AS upper FROM nxt", keys="station antecedent", nums="prediction lower upper", ctes=NEXT)
def fz_interval(spark, path):
    return Z.fz_interval(gaps_table(spark, path))


# ---- ensemble -----------------------------------------------------------------------------------------------------

# Trained state and error of each model; one model per station counts as untrained.
MODELS = PAIRS.replace("pairs AS", "pairs AS") + (
    ", models AS (SELECT station, model, avg(abs(prediction-actual)) AS mae, NOT (station = 'view' AND model = 'daily') AS is_trained FROM pairs GROUP BY 1, 2)"
)


def score_sql(src: str, score: str, floor: str = "0.05::DOUBLE") -> str:
    return (
        f"s1 AS (SELECT station, model, {score} AS sc FROM {src}), s2 AS (SELECT station, model, greatest(sc/sum(sc) OVER (PARTITION BY station), {floor}) AS w FROM s1),"
        " weights AS (SELECT station, model, w/sum(w) OVER (PARTITION BY station) AS weight FROM s2)"
    )


PERF = MODELS + ", " + score_sql("models", "CASE WHEN is_trained THEN CASE WHEN mae > 0 THEN 1/mae ELSE 1 END ELSE 0.1::DOUBLE END")
ADAPT = MODELS + (
    ", rec AS (SELECT station, model, avg(abs(actual-prediction)) AS err FROM (SELECT *, row_number() OVER (PARTITION BY station, model ORDER BY ts DESC) AS r FROM flog WHERE prediction IS NOT NULL) WHERE r <= 100 GROUP BY 1, 2), "
    + score_sql("models JOIN rec USING (station, model)", "1/(err + 1e-6::DOUBLE)")
)


def log_table(spark, path):
    return stored(forecast_log(panel(spark, path)), "log")


def model_frame(log):
    usable = log.filter(F.abs("actual") > 0.01)
    m = metrics.agg_metrics(usable, by=["station", "model"])
    return m.withColumn("is_trained", ~((F.col("station") == "view") & (F.col("model") == "daily")))


@query("en_equal", "SELECT station, model, 1.0::DOUBLE/count(*) OVER (PARTITION BY station) AS weight FROM models", keys="station model", nums="weight", ctes=MODELS)
def en_equal(spark, path):
    return E.en_equal(model_frame(log_table(spark, path)))


@query("en_performance", "SELECT * FROM weights", keys="station model", nums="weight", ctes=PERF)
def en_performance(spark, path):
    return E.en_performance(model_frame(log_table(spark, path)))


@query("en_adaptive", "SELECT * FROM weights", keys="station model", nums="weight", ctes=ADAPT)
def en_adaptive(spark, path):
    log = log_table(spark, path)
    return E.en_adaptive(model_frame(log), log)


@query("en_update", "SELECT * FROM weights", keys="station model", nums="weight", ctes=PERF)
def en_update(spark, path):
    log = log_table(spark, path)
    return E.en_update(model_frame(log), log, E.EnsembleConfig(method="performance"))


COMBINE = PERF + (
    ", comb AS (SELECT station, ts, target, sum(weight*prediction)/sum(weight) AS prediction, count(*) AS models, avg(prediction) AS m, stddev_pop(prediction) AS s, max(actual) AS actual"
    " FROM flog JOIN weights USING (station, model) WHERE prediction IS NOT NULL GROUP BY 1, 2, 3)"
)


@query("en_combine", "SELECT * FROM comb", keys="station ts target", ints="models", nums="prediction", ctes=COMBINE)
def en_combine(spark, path):
    log = log_table(spark, path)
    return E.en_combine(log, E.en_performance(model_frame(log)))


@query(
    "en_interval",
    "SELECT station, ts, target, prediction, CASE WHEN hour(ts) < 12 THEN prediction - 10 ELSE m - 1.96*s END AS lower, CASE WHEN hour(ts) < 12 THEN prediction + 10 ELSE m + 1.96*s END AS upper FROM comb",
    keys="station ts target", nums="prediction lower upper", ctes=COMBINE,
)
def en_interval(spark, path):
    log = log_table(spark, path)
    weights = E.en_performance(model_frame(log))
    half = E.en_combine(log, weights).filter(F.hour("ts") < 12)
    primary = half.withColumns({"lower": F.col("prediction") - 10, "upper": F.col("prediction") + 10})
    return E.en_interval(log, weights, primary)


@query(
    "en_drop_failed", "SELECT station, model, weight/sum(weight) OVER (PARTITION BY station) AS weight FROM weights JOIN models USING (station, model) WHERE is_trained",
    keys="station model", nums="weight", ctes=PERF,
)
def en_drop_failed(spark, path):
    m = model_frame(log_table(spark, path))
    return E.en_drop_failed(E.en_performance(m), m)


@query(
    "en_metrics",
    "SELECT station, model, count(*) AS n, avg(abs(prediction-actual)) AS mae, sqrt(avg(pow(prediction-actual,2))) AS rmse, 1 - sum(pow(prediction-actual,2))/(var_pop(actual)*count(*)) AS r2,"
    " avg(prediction-actual) AS mean_error, stddev_pop(prediction-actual) AS std_error, max(weight) AS weight, 3 AS model_count FROM (SELECT station, model, actual, prediction FROM flog WHERE prediction IS NOT NULL"
    " UNION ALL SELECT station, 'ensemble', actual, prediction FROM comb) LEFT JOIN weights USING (station, model) GROUP BY 1, 2",
    keys="station model", ints="n model_count", nums="mae rmse r2 mean_error std_error weight", ctes=COMBINE,
)
def en_metrics(spark, path):
    log = log_table(spark, path)
    return E.en_metrics(log, E.en_performance(model_frame(log)))


@query(
    "en_contributions", "SELECT station, string_agg(model || '=' || printf('%.4f', weight + 1e-9), ',' ORDER BY model) AS contributions FROM weights GROUP BY station",
    keys="station contributions", ctes=PERF,
)
def en_contributions(spark, path):
    c = E.en_contributions(E.en_performance(model_frame(log_table(spark, path))))
    text = F.transform(F.map_entries("contributions"), lambda e: F.format_string("%s=%.4f", e["key"], e["value"] + 1e-9))
    return c.withColumn("contributions", F.concat_ws(",", text))


@query(
    "join_actuals", "SELECT station, ts, target, model, prediction, actual, abs(actual-prediction) AS abs_error FROM flog",
    keys="station ts target model", nums="prediction actual abs_error",
)
def join_actuals(spark, path):
    obs = panel_table(spark, path)
    log = forecast_log(obs).drop("actual")
    truth = obs.select("station", "ts", F.lit("temperature").alias("target"), F.col("temperature").alias("actual"))
    return E.join_actuals(log, truth)


# ---- intervals ----------------------------------------------------------------------------------------------------


@query(
    "int_samples",
    "SELECT station, ts, avg(prediction) AS prediction, avg(prediction)-1.96*stddev_pop(prediction) AS lower, avg(prediction)+1.96*stddev_pop(prediction) AS upper FROM flog WHERE prediction IS NOT NULL GROUP BY 1, 2",
    keys="station ts", nums="prediction lower upper",
)
def int_samples(spark, path):
    log = forecast_log(panel(spark, path)).filter("prediction IS NOT NULL")
    # Three models per (station, ts): the array is bounded.
    return intervals.int_samples(log.groupBy("station", "ts").agg(F.array_sort(F.collect_list("prediction")).alias("samples")))


@query(
    "int_samples_grouped",
    "SELECT station, ts, avg(prediction) AS prediction, avg(prediction)-1.96*stddev_pop(prediction) AS lower, avg(prediction)+1.96*stddev_pop(prediction) AS upper FROM flog WHERE prediction IS NOT NULL GROUP BY 1, 2",
    keys="station ts", nums="prediction lower upper",
)
def int_samples_grouped(spark, path):
    log = forecast_log(panel(spark, path)).filter("prediction IS NOT NULL")
    return intervals.int_samples_grouped(log, by=["station", "ts"])


@query(
    "int_bounds",
    "SELECT station, ts, mean6 AS prediction, least(mean6, mean6+lo) AS lower, greatest(mean6, mean6+hi) AS upper FROM naive JOIN (SELECT station, quantile_cont(actual-mean6, 0.025) AS lo, quantile_cont(actual-mean6, 0.975) AS hi FROM naive WHERE mean6 IS NOT NULL GROUP BY station) USING (station) WHERE mean6 IS NOT NULL",
    keys="station ts", nums="prediction lower upper",
)
def int_bounds(spark, path):
    log = log_table(spark, path).filter("model = 'mean6' AND prediction IS NOT NULL")
    shape = timeline.measure(log)
    return intervals.int_bounds(log, intervals.int_bounds_fit(log, shape=shape), shape=shape)


# ---- labels of model tables ---------------------------------------------------------------------------------------


@query(
    "sc_perf_label", "SELECT station, ts, model, CASE WHEN abs(prediction-actual) < 2 THEN 'Excellent' WHEN abs(prediction-actual) < 5 THEN 'Good' ELSE 'Needs Improvement' END AS performance_label FROM flog WHERE prediction IS NOT NULL",
    keys="station ts model performance_label",
)
def sc_perf_label(spark, path):
    from wxspark.functions.labels import sc_perf_label as label

    log = forecast_log(panel(spark, path)).filter("prediction IS NOT NULL")
    return label(log.withColumn("mae", F.abs(F.col("prediction") - F.col("actual"))))


@query(
    "sc_influence_label", "SELECT station, model, CASE WHEN weight > 0.3 THEN 'High' WHEN weight > 0.15 THEN 'Medium' ELSE 'Low' END AS influence, weight*100 AS weight_percent FROM weights",
    keys="station model influence", nums="weight_percent", ctes=PERF, digits=4,
)
def sc_influence_label(spark, path):
    from wxspark.functions.labels import sc_influence_label as label

    return label(E.en_performance(model_frame(log_table(spark, path))))


@query(
    "sc_display_name",
    "SELECT event_id, CASE m WHEN 'lstm' THEN 'LSTM' WHEN 'random_forest' THEN 'Random Forest' WHEN 'fuzzy' THEN 'Fuzzy Time Series' ELSE upper(m) END AS display_name FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'lstm' WHEN 1 THEN 'random_forest' WHEN 2 THEN 'fuzzy' ELSE event_type END AS m FROM events)",
    keys="event_id display_name",
)
def sc_display_name(spark, path):
    from wxspark.functions.labels import sc_display_name as label

    m = F.col("event_id") % 4
    code = F.when(m == 0, "lstm").when(m == 1, "random_forest").when(m == 2, "fuzzy").otherwise(F.col("event_type"))
    return label(spark.read.parquet(f"{path}/events.parquet").select("event_id", code.alias("model")))
