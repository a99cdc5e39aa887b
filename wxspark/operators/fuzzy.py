"""Fuzzy time series: sets, transition rules, forecasts and intervals for every station at once.

Universe, sets and rules are small tables (a few rows per station); the series themselves are only mapped and joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wxspark.operators import timeline
from wxspark.operators.clean import win_interpolate
from wxspark.operators.metrics import agg_metrics
from wxspark.operators.timeline import Shape, join_small, measure
from wxspark.schema import STATION, TS
from wxspark.session import stored

# Names of the sets, lowest first.
TERMS = ["VeryLow", "Low", "MediumLow", "Medium", "MediumHigh", "High", "VeryHigh"]


@dataclass(frozen=True)
class FuzzyConfig:
    target: str = "temperature"
    sets: int = 7
    order: int = 1
    overlap: float = 0.5
    min_support: int = 2
    nearest: bool = False
    station: str = STATION
    ts: str = TS

    @property
    def terms(self) -> list[str]:
        return TERMS[: self.sets] if self.sets <= len(TERMS) else [f"A{i + 1}" for i in range(self.sets)]


def membership(x: Column, center: Column, width: Column) -> Column:
    """Triangular; a set of no width holds only its centre."""
    d = F.abs(x - center)
    inside = F.when(d <= width, 1 - F.try_divide(d, width)).otherwise(F.lit(0.0))
    return F.when(width == 0, F.when(x == center, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(inside)


def fz_universe(df, cfg: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    lo, hi = F.min(cfg.target), F.max(cfg.target)
    pad = (hi - lo) * 0.1
    return df.groupBy(cfg.station).agg((lo - pad).alias("u_min"), (hi + pad).alias("u_max"))


def _step(cfg: FuzzyConfig) -> Column:
    return (F.col("u_max") - F.col("u_min")) / F.lit(float(max(cfg.sets - 1, 1)))


def _center(i: Column, cfg: FuzzyConfig) -> Column:
    return F.col("u_min") + i.cast("double") * _step(cfg)


def fz_sets(universe: DataFrame, cfg: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """One row per station and set: set_no, label, center, width."""
    names = F.array(*[F.lit(t) for t in cfg.terms])
    return universe.select(
        cfg.station, "u_min", "u_max", F.posexplode(names).alias("set_no", "label")
    ).select(
        cfg.station, "set_no", "label",
        _center(F.col("set_no"), cfg).alias("center"),
        (_step(cfg) * (1 + cfg.overlap)).alias("width"),
    )


def fz_fuzzify(df, universe: DataFrame, cfg: FuzzyConfig = FuzzyConfig(), *, shape: Shape | None = None) -> DataFrame:
    """Add ``label`` and ``set_no``: the set with the largest membership, the lower one on a tie, the first if none.

    ``cfg.nearest`` sends values outside every set to the closest end instead. Memberships are computed in the row, so
    the only join is with one universe row per station.
    """
    shape = shape or measure(df, cfg.station)
    x = F.col(cfg.target)
    names = F.array(*[F.lit(t) for t in cfg.terms])
    u = join_small(df, universe, [cfg.station], shape.series)
    out = u.withColumn("set_no", F.when(x.isNotNull(), best_set(x, cfg)))
    return out.withColumn("label", F.when(F.col("set_no").isNotNull(), F.get(names, F.col("set_no")))).drop("u_min", "u_max")


def best_set(x: Column, cfg: FuzzyConfig) -> Column:
    """Number of the set that holds x best, the lower one on a tie; needs u_min and u_max.

    Membership falls with the distance from the centre, so only the two centres around x can win.
    """
    width = _step(cfg) * (1 + cfg.overlap)
    at = F.coalesce(F.floor(F.try_divide(x - F.col("u_min"), F.nullif(_step(cfg), F.lit(0.0)))).cast("int"), F.lit(0))
    low = F.greatest(F.least(at, F.lit(cfg.sets - 2)), F.lit(0))
    high = F.least(low + 1, F.lit(cfg.sets - 1))
    m_low, m_high = membership(x, _center(low, cfg), width), membership(x, _center(high, cfg), width)
    far = F.when(x > F.col("u_max"), cfg.sets - 1).otherwise(0) if cfg.nearest else F.lit(0)
    return F.when(m_high > m_low, high).when(m_low > 0, low).otherwise(far)


def antecedent(w, order: int) -> Column:
    """Labels of the previous ``order`` rows, oldest first; null where the series is too young."""
    parts = [F.lag("label", k).over(w) for k in range(order, 0, -1)]
    return F.when(parts[0].isNotNull(), F.concat_ws(",", *parts))


def win_antecedent(df, cfg: FuzzyConfig = FuzzyConfig(), *, shape: Shape | None = None) -> DataFrame:
    return timeline.over_rows(
        df, lambda w: {"antecedent": antecedent(w, cfg.order)}, back=cfg.order, station=cfg.station, ts=cfg.ts, shape=shape
    )


def prepare(df, cfg: FuzzyConfig = FuzzyConfig(), *, interpolate: bool = True, shape: Shape | None = None):
    """(universe, labelled series with antecedents) of the target series after filling its gaps.

    Interpolated values never leave the range of the known ones, so the universe comes from the raw series; filling and
    antecedents then share one shuffle.
    """
    shape = shape or measure(df, cfg.station)
    base = df.select(cfg.station, cfg.ts, cfg.target)
    universe = fz_universe(base, cfg)
    if not shape.whole:
        # Positions once for both window steps, and one evaluation for the rules and the rows that use them.
        base = timeline.with_position(base, station=cfg.station, ts=cfg.ts, shape=shape)
    if interpolate:
        base = win_interpolate(base, station=cfg.station, ts=cfg.ts, columns=[cfg.target], shape=shape)
    labelled = win_antecedent(fz_fuzzify(base, universe, cfg, shape=shape), cfg, shape=shape)
    if not shape.whole:
        labelled = stored(labelled.drop(timeline.POS, timeline.COUNT), "labels")
    return universe, labelled


def agg_rule_counts(labelled: DataFrame, cfg: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """station, antecedent, consequent, n, support, weight for antecedents with enough support."""
    pairs = labelled.filter(F.col("antecedent").isNotNull()).groupBy(
        cfg.station, "antecedent", F.col("label").alias("consequent")
    ).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(cfg.station, "antecedent")
    support = F.sum("n").over(w)
    return (
        pairs.withColumn("support", support)
        .withColumn("weight", F.col("n") / F.col("support"))
        .filter(F.col("support") >= cfg.min_support)
    )


def agg_rules_text(rules: DataFrame, cfg: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """One readable line per rule; a rule has at most as many consequents as there are sets."""
    part = F.format_string("%s:%.3f", F.col("consequent"), F.col("weight"))
    return rules.groupBy(cfg.station, "antecedent").agg(
        F.max("support").alias("support"),
        F.format_string(
            "IF %s THEN [%s]", F.col("antecedent"), F.concat_ws(", ", F.array_sort(F.collect_list(part)))
        ).alias("rule"),
    )


def _rule_outputs(rules: DataFrame, universe: DataFrame, cfg: FuzzyConfig) -> DataFrame:
    """Per rule: weighted centre, spread of the distinct consequent centres and their number."""
    numbers = F.create_map(*[F.lit(v) for i, t in enumerate(cfg.terms) for v in (t, i)])
    placed = rules.join(universe, cfg.station).withColumn("_c", _center(F.element_at(numbers, F.col("consequent")), cfg))
    return placed.groupBy(cfg.station, "antecedent").agg(
        F.try_divide(F.sum(F.col("_c") * F.col("n")), F.sum("n")).alias("rule_value"),
        F.stddev_pop("_c").alias("rule_spread"),
        F.count(F.lit(1)).alias("outcomes"),
    )


def fz_defuzzify(rules: DataFrame, universe: DataFrame, cfg: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """Crisp output of each rule: centres weighted by counts (the centroid and the weighted average are the same ratio)."""
    out = _rule_outputs(rules, universe, cfg)
    return out.select(cfg.station, "antecedent", "rule_value", "outcomes")


def _with_prediction(
    states: DataFrame, rules: DataFrame, universe: DataFrame, cfg: FuzzyConfig, shape: Shape
) -> DataFrame:
    """Add ``prediction`` and the rule columns to rows that carry an ``antecedent``.

    There are at most sets ** order rules per station, which bounds the table before anything runs.
    """
    out = _rule_outputs(rules, universe, cfg)
    last = F.element_at(F.split("antecedent", ","), -1)
    numbers = F.create_map(*[F.lit(v) for i, t in enumerate(cfg.terms) for v in (t, i)])
    joined = join_small(states, out, [cfg.station, "antecedent"], shape.series * cfg.sets**cfg.order)
    joined = join_small(joined, universe, [cfg.station], shape.series)
    center = _center(F.try_element_at(numbers, last), cfg)
    middle = (F.col("u_min") + F.col("u_max")) / 2
    return joined.withColumn("prediction", F.coalesce("rule_value", center, middle))


def last_state(labelled: DataFrame, cfg: FuzzyConfig = FuzzyConfig()) -> DataFrame:
    """The antecedent that leads to the next, unseen row: the last ``order`` labels of each station."""
    recent = timeline.newest(labelled.select(cfg.station, cfg.ts, "label"), cfg.order, keys=[cfg.station], ts=cfg.ts)
    labels = F.transform(F.array_sort(F.collect_list(F.struct(cfg.ts, "label"))), lambda s: s["label"])
    return recent.groupBy(cfg.station).agg(F.max(cfg.ts).alias(cfg.ts), F.concat_ws(",", labels).alias("antecedent"))


def fz_predict(df, cfg: FuzzyConfig = FuzzyConfig(), *, shape: Shape | None = None) -> DataFrame:
    """Next value per station: rule output, else centre of the last label, else middle of the universe."""
    return fz_interval(df, cfg, shape=shape).select(cfg.station, "antecedent", "prediction")


def fz_interval(df, cfg: FuzzyConfig = FuzzyConfig(), *, shape: Shape | None = None) -> DataFrame:
    """fz_predict with a 95 percent interval from the diversity of the rule."""
    shape = shape or measure(df, cfg.station)
    universe, labelled = prepare(df, cfg, shape=shape)
    rules = agg_rule_counts(labelled, cfg)
    states = _with_prediction(last_state(labelled, cfg), rules, universe, cfg, shape)
    span = F.col("u_max") - F.col("u_min")
    spread = (
        F.when(F.col("outcomes").isNull(), span * 0.2)
        .when(F.col("outcomes") > 1, F.col("rule_spread"))
        .otherwise(span * 0.05)
    )
    p = F.col("prediction")
    return states.withColumns({"lower": p - 1.96 * spread, "upper": p + 1.96 * spread}).select(
        cfg.station, "antecedent", "prediction", "lower", "upper"
    )


def fz_fitted(df, cfg: FuzzyConfig = FuzzyConfig(), *, shape: Shape | None = None) -> DataFrame:
    """One-step predictions over the series: station, ts, actual, prediction."""
    shape = shape or measure(df, cfg.station)
    universe, labelled = prepare(df, cfg, shape=shape)
    rules = agg_rule_counts(labelled, cfg)
    rows = labelled.filter(F.col("antecedent").isNotNull())
    out = _with_prediction(rows, rules, universe, cfg, shape)
    return out.select(cfg.station, cfg.ts, F.col(cfg.target).alias("actual"), "prediction")


def fz_backtest(df, cfg: FuzzyConfig = FuzzyConfig(), *, shape: Shape | None = None) -> DataFrame:
    return agg_metrics(fz_fitted(df, cfg, shape=shape), by=[cfg.station])


def fz_fit(df, cfg: FuzzyConfig = FuzzyConfig(), *, shape: Shape | None = None) -> DataFrame:
    """Fitted first-order model, one small row per station: universe and, for each label, the value it leads to and the
    label of that value."""
    if cfg.order != 1:
        raise ValueError("recursive forecasts need order 1")
    universe, labelled = prepare(df, cfg, shape=shape or measure(df, cfg.station))
    rules = _rule_outputs(agg_rule_counts(labelled, cfg), universe, cfg)
    sets = fz_sets(universe, cfg).join(universe, cfg.station)
    j = sets.join(rules.withColumnRenamed("antecedent", "label"), [cfg.station, "label"], "left")
    j = j.withColumn("value", F.coalesce("rule_value", "center"))
    j = j.withColumn("next_no", best_set(F.col("value"), cfg))
    return j.groupBy(cfg.station, "u_min", "u_max").agg(
        F.array_sort(F.collect_list(F.struct("set_no", "value", "next_no"))).alias("map")
    )


def fz_multi_step(
    df, steps: int, cfg: FuzzyConfig = FuzzyConfig(), *, params: DataFrame | None = None, shape: Shape | None = None
) -> DataFrame:
    """Recursive forecast from the newest known value: station, last_ts, step, prediction. The steps are a native fold
    over the label map of the station."""
    params = fz_fit(df, cfg, shape=shape) if params is None else params
    x = F.col(cfg.target)
    last = df.groupBy(cfg.station).agg(
        F.max(cfg.ts).alias("last_ts"), F.max_by(x, F.when(x.isNotNull(), F.col(cfg.ts))).alias("_x")
    )
    j = last.join(params, cfg.station).withColumn("at", best_set(F.col("_x"), cfg))
    start = F.struct(F.col("at").alias("at"), F.array().cast("array<double>").alias("out"))

    def advance(acc, _):
        here = F.get("map", acc["at"])
        return F.struct(here["next_no"].alias("at"), F.concat(acc["out"], F.array(here["value"])).alias("out"))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, advance, lambda acc: acc["out"])
    out = j.select(cfg.station, "last_ts", F.posexplode(path).alias("i", "prediction"))
    return out.select(cfg.station, "last_ts", (F.col("i") + 1).alias("step"), "prediction")
