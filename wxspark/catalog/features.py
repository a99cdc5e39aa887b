"""Scalar formulas, row windows and the column sets built from them."""

from __future__ import annotations

from wxspark.catalog.base import query
from wxspark.functions import labels as L
from wxspark.functions import weather as W
from wxspark.operators import features as X
from wxspark.schema import BASE
from wxspark.sources.panel import located, panel

DEW = (
    "CASE WHEN humidity > 0 THEN 237.7*(17.27*temperature/(237.7+temperature)+ln(humidity/100))"
    "/(17.27-(17.27*temperature/(237.7+temperature)+ln(humidity/100))) END"
)
SIMPLE = "(temperature + 0.5*(temperature + 61.0 + (temperature-68.0)*1.2 + humidity*0.094))"
HEAT = (
    f"CASE WHEN {SIMPLE} >= 80 THEN -42.379 + 2.04901523*temperature + 10.14333127*humidity"
    " - 0.22475541*temperature*humidity - 6.83783e-3*pow(temperature,2) - 5.481717e-2*pow(humidity,2)"
    " + 1.22874e-3*pow(temperature,2)*humidity + 8.5282e-4*temperature*pow(humidity,2)"
    f" - 1.99e-6*pow(temperature,2)*pow(humidity,2) ELSE {SIMPLE} END"
)
CHILL = (
    "CASE WHEN temperature <= 10 AND wind_speed*3.6 >= 4.8 THEN 13.12 + 0.6215*temperature"
    " - 11.37*pow(wind_speed*3.6, 0.16::DOUBLE) + 0.3965*temperature*pow(wind_speed*3.6, 0.16::DOUBLE) ELSE temperature END"
)
FEELS = f"CASE WHEN temperature >= 27 THEN {HEAT} WHEN temperature <= 10 THEN {CHILL} ELSE temperature END"
MONTH, HOUR, DOW = "month(ts)", "hour(ts)", "(isodow(ts)-1)"
SEASON = f"CASE WHEN {MONTH} IN (12,1,2) THEN 0 WHEN {MONTH} <= 5 THEN 1 WHEN {MONTH} <= 8 THEN 2 ELSE 3 END"
CYC = {"hour": (HOUR, 24), "day_of_week": (DOW, 7), "month": (MONTH, 12), "wind_direction": ("wind_direction", 360)}
CYC_SQL = ", ".join(
    f"{f}(2*pi()*{x}/{p}::DOUBLE) AS {n}_{f}" for n, (x, p) in CYC.items() for f in ("sin", "cos")
)
CYC_NAMES = [f"{n}_{f}" for n in CYC for f in ("sin", "cos")]
RAIN_BIN = (
    "CASE WHEN precipitation > -0.1 AND precipitation <= 0 THEN 0 WHEN precipitation > 0 AND precipitation <= 2.5 THEN 1"
    " WHEN precipitation <= 10 AND precipitation > 2.5 THEN 2 WHEN precipitation > 10 AND precipitation <= 50 THEN 3"
    " WHEN precipitation > 50 THEN 4 END"
)
RATIO = "temperature/(humidity+1e-6::DOUBLE)"


def bin_sql(col: str, edges: list[int]) -> str:
    return "CASE " + " ".join(f"WHEN {col} > {a} AND {col} <= {b} THEN {i}" for i, (a, b) in enumerate(zip(edges, edges[1:]))) + " END"


SETS = {
    "sc_interactions": (
        ["temp_humidity_interaction", "temp_humidity_ratio", "pressure_temp_ratio"],
        ["temperature*humidity", RATIO, "pressure/(temperature+273.15::DOUBLE)"],
    ),
    "sc_wind_components": (
        ["wind_u", "wind_v"],
        ["wind_speed*cos(radians(wind_direction))", "wind_speed*sin(radians(wind_direction))"],
    ),
    "sc_polynomials": (
        [f"{c}_{k}" for c in ("temperature", "pressure", "wind_speed") for k in ("squared", "cubed")],
        [e for c in ("temperature", "pressure", "wind_speed") for e in (f"{c}*{c}", f"{c}*{c}*{c}")],
    ),
    "sc_bins": (
        ["temp_category", "wind_category", "pressure_category"],
        [
            bin_sql("temperature", [-50, 0, 10, 20, 30, 50]),
            bin_sql("wind_speed", [0, 2, 5, 10, 15, 100]),
            bin_sql("pressure", [0, 1000, 1013, 1025, 1100]),
        ],
    ),
    "sc_comfort": (
        ["comfort_index"],
        ["CASE WHEN temperature BETWEEN 18 AND 24 AND humidity BETWEEN 40 AND 60 THEN 1 ELSE 0 END"],
    ),
    "sc_extremes": (
        ["extreme_cold", "extreme_hot", "high_wind"],
        [f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in ("temperature < -10", "temperature > 35", "wind_speed > 10")],
    ),
    "sc_dew_point": (["dew_point"], [DEW]),
    "sc_heat_index": (["heat_index"], [HEAT]),
    "sc_wind_chill": (["wind_chill"], [CHILL]),
    "sc_feels_like": (["feels_like"], [FEELS]),
    "sc_ratio_norm": (["temp_humidity_ratio", "pressure_normalized"], [RATIO, "(pressure-1013.25::DOUBLE)/1013.25::DOUBLE"]),
    "sc_precip_intensity": (["precipitation_intensity"], [RAIN_BIN]),
    "sc_units": (["wind_kmh", "wind_ms"], ["wind_speed*3.6::DOUBLE", "wind_speed*3.6::DOUBLE/3.6::DOUBLE"]),
}

FLAGS_SQL = (
    "cloud_cover > 70 AND precipitation > 0 AS rain_probability, cloud_cover < 20 AS clear_sky, cloud_cover > 80 AS overcast"
)


def _exprs(name: str) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in zip(*SETS[name]))


def _scalar(name: str, fn, digits: int = 6) -> None:
    @query(name, f"SELECT station, ts, {_exprs(name)} FROM panel", keys="station ts", nums=" ".join(SETS[name][0]), digits=digits)
    def _(spark, path):
        return fn(panel(spark, path))


for _name in SETS:
    _scalar(_name, getattr(W, _name), 3 if _name == "sc_polynomials" else 6)


@query(
    "sc_time_parts",
    f"SELECT station, ts, {HOUR} AS hour, {DOW} AS day_of_week, dayofyear(ts) AS day_of_year, {MONTH} AS month, {SEASON} AS season FROM panel",
    keys="station ts", ints="hour day_of_week day_of_year month season",
)
def sc_time_parts(spark, path):
    return W.sc_time_parts(panel(spark, path))


@query(
    "sc_season",
    "SELECT o_orderkey, o_orderdate, CASE WHEN month(o_orderdate) IN (12,1,2) THEN 0 WHEN month(o_orderdate) <= 5 THEN 1"
    " WHEN month(o_orderdate) <= 8 THEN 2 ELSE 3 END AS season FROM orders",
    keys="o_orderkey", ints="season",
)
def sc_season(spark, path):
    return W.sc_season(spark.read.parquet(f"{path}/orders.parquet").select("o_orderkey", "o_orderdate"), ts="o_orderdate")


@query("sc_cyclic", f"SELECT station, ts, {CYC_SQL} FROM panel", keys="station ts", nums=" ".join(CYC_NAMES))
def sc_cyclic(spark, path):
    return W.sc_cyclic(panel(spark, path))


@query("sc_pattern_flags", f"SELECT station, ts, {FLAGS_SQL} FROM panel", keys="station ts rain_probability clear_sky overcast")
def sc_pattern_flags(spark, path):
    return W.sc_pattern_flags(panel(spark, path))


TENDENCY = "coalesce(pressure - lag(pressure) OVER (PARTITION BY station ORDER BY ts), 0)"


@query("win_diff", f"SELECT station, ts, {TENDENCY} AS pressure_tendency FROM panel", keys="station ts", nums="pressure_tendency")
def win_diff(spark, path):
    return X.win_diff(panel(spark, path))


@query(
    "sc_tendency_flags",
    f"SELECT station, ts, CASE WHEN d > 0.5 THEN 1 ELSE 0 END AS pressure_rising, CASE WHEN d < -0.5 THEN 1 ELSE 0 END AS"
    f" pressure_falling FROM (SELECT station, ts, {TENDENCY} AS d FROM panel)",
    keys="station ts", nums="pressure_rising pressure_falling",
)
def sc_tendency_flags(spark, path):
    return W.sc_tendency_flags(X.win_diff(panel(spark, path)))


LAG_NAMES = [f"{c}_lag_{k}h" for c in BASE for k in X.LAGS]
LAG_SQL = ", ".join(f"lag({c}, {k}) OVER w AS {c}_lag_{k}h" for c in BASE for k in X.LAGS)
ROLL_FUN = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
ROLL_NAMES = [f"{c}_rolling_{k}h_{n}" for c in BASE for k in X.WINDOWS for n in ROLL_FUN]
ROLL_SQL = ", ".join(
    f"{f}({c}) OVER w{k} AS {c}_rolling_{k}h_{n}" for c in BASE for k in X.WINDOWS for n, f in ROLL_FUN.items()
)
WINDOW_SQL = "WINDOW w AS (PARTITION BY station ORDER BY ts), " + ", ".join(
    f"w{k} AS (PARTITION BY station ORDER BY ts ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in X.WINDOWS
)


@query("win_lag", f"SELECT station, ts, {LAG_SQL} FROM panel {WINDOW_SQL}", keys="station ts", nums=" ".join(LAG_NAMES))
def win_lag(spark, path):
    return X.win_lag(panel(spark, path))


@query("win_rolling", f"SELECT station, ts, {ROLL_SQL} FROM panel {WINDOW_SQL}", keys="station ts", nums=" ".join(ROLL_NAMES))
def win_rolling(spark, path):
    return X.win_rolling(panel(spark, path))


ADV = ["sc_interactions", "sc_wind_components", "sc_bins", "sc_comfort", "sc_extremes", "sc_polynomials"]
ADV_NAMES = [n for s in ADV for n in SETS[s][0]] + ["pressure_rising", "pressure_falling"]


@query(
    "fe_advanced",
    f"SELECT station, ts, {', '.join(_exprs(s) for s in ADV)}, {FLAGS_SQL}, CASE WHEN d > 0.5 THEN 1 ELSE 0 END AS pressure_rising,"
    f" CASE WHEN d < -0.5 THEN 1 ELSE 0 END AS pressure_falling FROM (SELECT *, {TENDENCY} AS d FROM panel)",
    keys="station ts rain_probability clear_sky overcast", nums=" ".join(ADV_NAMES), digits=3,
)
def fe_advanced(spark, path):
    return W.fe_advanced(X.win_diff(panel(spark, path)))


# ---- labels -------------------------------------------------------------------------------------------------------


@query(
    "sc_temp_band",
    "SELECT station, ts, CASE WHEN temperature < 0 THEN 'blue-600' WHEN temperature < 10 THEN 'blue-500' WHEN temperature < 20"
    " THEN 'green-500' WHEN temperature < 30 THEN 'yellow-500' WHEN temperature < 40 THEN 'orange-500' ELSE 'red-500' END"
    " AS temperature_band FROM panel",
    keys="station ts temperature_band",
)
def sc_temp_band(spark, path):
    return L.sc_temp_band(panel(spark, path))


@query(
    "sc_sky_icon",
    "SELECT station, ts, CASE WHEN cloud_cover > 80 AND humidity > 80 THEN 'rain' WHEN cloud_cover > 80 THEN 'cloud'"
    " ELSE 'thermometer' END AS sky_icon FROM panel",
    keys="station ts sky_icon",
)
def sc_sky_icon(spark, path):
    return L.sc_sky_icon(panel(spark, path))


@query(
    "sc_time_labels",
    "SELECT station, ts, strftime(ts, '%-I:%M %p') AS time_label, strftime(ts, '%a, %b %-d') AS date_label FROM panel",
    keys="station ts time_label date_label",
)
def sc_time_labels(spark, path):
    return L.sc_time_labels(panel(spark, path))


@query(
    "sc_location_name",
    "SELECT station, ts, printf('Location (%.2f, %.2f)', latitude, longitude) AS location_name FROM located",
    keys="station ts location_name",
)
def sc_location_name(spark, path):
    return L.sc_location_name(located(panel(spark, path)))
