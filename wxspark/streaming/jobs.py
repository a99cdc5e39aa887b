"""Structured Streaming versions of the stateful operators.

All state is the engine's own: windows and duplicates through its operators, folds that compare event times (rules, recent errors,
provider health) as keyed states of bounded size. Where a fold allows it, tasks combine their rows before the shuffle, so a key that
holds a third of a batch reaches its state as a few rows. A batch that is run again leaves the same rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wxspark.session import scratch
from wxspark.sources.panel import hour_sums, to_observations


def read_events_stream(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """The events table as a file stream with an event-time column."""
    schema = spark.read.parquet(f"{path}/events.parquet").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, path: str, *, checkpoint: str | None = None) -> DataFrame:
    """Process what is available, append to a Parquet table and read it back."""
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch(spark, "stream-checkpoint")
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    q.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def st_panel(events: DataFrame, *, delay: str = "1 hour") -> DataFrame:
    """Hourly station panel; an hour is emitted once the watermark has passed its end."""
    hour = F.window("ts", "1 hour")
    sums = hour_sums(events.withWatermark("ts", delay), hour)
    return to_observations(sums.withColumn("ts", F.col("ts.start")))


def st_ingest(observations: DataFrame, *, keys=("station", "obs_ts"), ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each key once, as long as its copies arrive within the watermark delay."""
    return observations.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


# ---- folds in the engine's state ----------------------------------------------------------------------------------


def run_changes(changes: DataFrame, path: str, *, checkpoint: str) -> DataFrame:
    """Run a stateful stream on what is available; the changed keys of each batch are appended to a table at ``path``.

    The state itself lies in the engine's state store under ``checkpoint``. The folder of a batch carries the batch's number and is written
    whole, so a batch that is run again leaves the same rows. ``newest`` reads the last word on every key.
    """
    spark = changes.sparkSession
    schema = changes.schema
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)


def newest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key in a table of changes; combined before the shuffle, so long histories move little."""
    rest = [c for c in changes.columns if c not in (*keys, "batch")]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def _micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


# Labels and requests wait this long for late ones before their order counts as settled.
DELAY = "1 day"
PAIRS = "array<struct<antecedent:string,consequent:string,n:long>>"


def _pairs(labels: list) -> Counter:
    return Counter((a, b) for a, b in zip(labels, labels[1:]) if a is not None)


def st_rules(labels: DataFrame, *, delay: str = DELAY) -> DataFrame:
    """Transition counts per station as they grow: station, settled, open. labels: station, ts, label.

    A pair of neighbours settles once both are older than the newest label of their station by more than ``delay``; until then a
    late label may come between them. The state of a station is its counts (at most one per pair of labels), the labels that
    wait and the last settled one. A label that is not newer than that one is too late and left out, as are labels without
    a time. Equal times stand in the order of their labels. A task sorts one station's labels of one batch; the size of a batch is the reader's
    to set (``files_per_trigger``).
    """
    wait = int(pd.Timedelta(delay) / pd.Timedelta(microseconds=1))

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, waiting, last = state.get if state.exists else ([], [], None)
        counts = Counter({(a, b): n for a, b, n in known})
        last = None if last is None else tuple(last)
        rows = [tuple(w) for w in waiting]
        for p in parts:
            fresh = p if last is None else p[p["at"] > last[0]]
            rows += zip(fresh["at"].tolist(), [None if pd.isna(x) else x for x in fresh["label"]])
        rows.sort(key=lambda r: (r[0], r[1] is not None, r[1] or ""))
        chain = rows if last is None else [last, *rows]
        edge = rows[-1][0] - wait if rows else None
        done = sum(r[0] < edge for r in chain) if rows else len(chain)
        counts.update(_pairs([r[1] for r in chain[:done]]))
        last = chain[done - 1] if done else None
        rows = chain[done:]
        listed = lambda c: [(*k, n) for k, n in c.items()]
        state.update((listed(counts), rows, last))
        shown = lambda c: [{"antecedent": a, "consequent": b, "n": n} for (a, b), n in c.items()]
        still = _pairs([r[1] for r in ([last] if last else []) + rows])
        yield pd.DataFrame({"station": [key[0]], "settled": [shown(counts)], "open": [shown(still)]})

    label = "struct<at:long,label:string>"
    rows = labels.select("station", _micros().alias("at"), "label").filter("at IS NOT NULL")
    kind = labels.schema["station"].dataType.simpleString()
    return rows.groupBy("station").applyInPandasWithState(
        fold, f"station {kind}, settled {PAIRS}, open {PAIRS}", f"counts {PAIRS}, waiting array<{label}>, last {label}", "update", GroupStateTimeout.NoTimeout
    )


def rule_counts(stations: DataFrame) -> DataFrame:
    """Counts as they stand: the settled pairs and those among the waiting labels."""
    each = stations.select("station", F.explode(F.concat("settled", "open")).alias("p")).select("station", "p.*")
    return each.groupBy("station", "antecedent", "consequent").agg(F.sum("n").alias("n"))


def _last(rows: pd.DataFrame, keep: int) -> pd.DataFrame:
    return rows.nlargest(keep, ["at", "abs_error"]) if len(rows) > keep else rows


def st_errors(log: DataFrame, *, keep: int = 100) -> DataFrame:
    """The last ``keep`` scored predictions of each station and model: station, model, errors (array of ts, abs_error).

    log: station, model, ts, abs_error. Tasks cut their rows to the last ``keep`` per key before the shuffle, so a key that holds most
    rows sends a few of each Arrow batch. Of equal times the larger errors stay. Rows without an error or a time are left out.
    """
    keys = ["station", "model"]

    def ahead(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.sort_values(["at", "abs_error"]).groupby(keys, dropna=False, sort=False).tail(keep)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, errors = state.get if state.exists else ([], [])
        have = pd.DataFrame({"at": pd.Series(at, dtype="int64"), "abs_error": pd.Series(errors, dtype="float64")})
        for p in parts:
            have = _last(pd.concat([have, p[["at", "abs_error"]]]), keep)
        at, errors = have["at"].tolist(), have["abs_error"].tolist()
        state.update((at, errors))
        yield pd.DataFrame({"station": [key[0]], "model": [key[1]], "at": [at], "abs_error": [errors]})

    rows = log.select(*keys, _micros().alias("at"), F.col("abs_error").cast("double").alias("abs_error")).dropna(subset=["at", "abs_error"])
    few = rows.mapInPandas(ahead, rows.schema)
    named = ", ".join(f"{k} {log.schema[k].dataType.simpleString()}" for k in keys)
    return few.groupBy(*keys).applyInPandasWithState(
        fold, f"{named}, at array<long>, abs_error array<double>", "at array<long>, abs_error array<double>", "update", GroupStateTimeout.NoTimeout
    )


def recent_errors(state: DataFrame, ts_type: str = "timestamp") -> DataFrame:
    """station, model, ts, abs_error of the kept predictions."""
    each = state.select("station", "model", F.explode(F.arrays_zip("at", "abs_error")).alias("e"))
    return each.select("station", "model", F.timestamp_micros("e.at").cast(ts_type).alias("ts"), "e.abs_error")


HEALTH = "total_requests long, successful_requests long, last_success long, last_failure long, seen long, times array<long>, counts array<long>"


def st_provider_health(log: DataFrame, *, delay: str = DELAY) -> DataFrame:
    """Totals and trailing failures of each provider, compared by event time. log: provider, ts, success.

    Tasks combine each Arrow batch into one row per provider before the shuffle: totals, newest times, and the failures after the newest
    success counted by time. The state adds those up, so late requests change it as if they had been on time. Failures older than
    the newest request by more than ``delay`` are kept as one number, which bounds the state of a provider that is down for good; a success that
    comes later still does not undo them. Requests without a time or an outcome are left out.
    """
    wait = int(pd.Timedelta(delay) / pd.Timedelta(microseconds=1))
    newer = lambda *xs: max((int(x) for x in xs if x is not None and not pd.isna(x)), default=None)

    def ahead(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for provider, g in p.groupby("provider", dropna=False, sort=False):
                good, bad = g.loc[g["success"], "at"], g.loc[~g["success"], "at"]
                after = (bad if good.empty else bad[bad > good.max()]).value_counts()
                rows.append((None if pd.isna(provider) else provider, len(g), len(good), newer(*good.nlargest(1)), newer(*bad.nlargest(1)), int(g["at"].max()), after.index.tolist(), after.tolist()))
            out = pd.DataFrame(rows, columns=["provider", *[c.split()[0] for c in HEALTH.split(", ")]])
            yield out.astype({"last_success": "Int64", "last_failure": "Int64"})

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, good, last_good, last_bad, seen, settled, edge, times, counts = state.get if state.exists else (0, 0, None, None, None, 0, None, [], [])
        failed = Counter(dict(zip(times, counts)))
        reset = None
        for p in parts:
            total, good = total + int(p["total_requests"].sum()), good + int(p["successful_requests"].sum())
            reset, last_bad, seen = newer(reset, *p["last_success"]), newer(last_bad, *p["last_failure"]), newer(seen, *p["seen"])
            for t, n in zip(p["times"], p["counts"]):
                failed.update({int(a): int(b) for a, b in zip(t, n)})
        last_good = newer(last_good, reset)
        if reset is not None and (edge is None or reset >= edge):
            settled = 0
        failed = {t: n for t, n in failed.items() if last_good is None or t > last_good}
        edge = newer(edge, seen - wait)
        settled += sum(n for t, n in failed.items() if t < edge)
        failed = {t: n for t, n in failed.items() if t >= edge}
        state.update((total, good, last_good, last_bad, seen, settled, edge, list(failed), list(failed.values())))
        row = (key[0], total, good, last_good, last_bad, seen, settled + sum(failed.values()))
        out = pd.DataFrame([row], columns=["provider", "total_requests", "successful_requests", "last_success", "last_failure", "seen", "run"])
        yield out.astype({"last_success": "Int64", "last_failure": "Int64"})

    kind = log.schema["provider"].dataType.simpleString()
    rows = log.select("provider", _micros().alias("at"), "success").dropna(subset=["at", "success"])
    few = rows.mapInPandas(ahead, f"provider {kind}, {HEALTH}")
    numbers = "total_requests long, successful_requests long, last_success long, last_failure long, seen long"
    return few.groupBy("provider").applyInPandasWithState(
        fold, f"provider {kind}, {numbers}, run long", f"{numbers}, settled long, edge long, times array<long>, counts array<long>", "update", GroupStateTimeout.NoTimeout
    )


def health_status(state: DataFrame, *, unhealthy_at: int = 3, reset_after: int = 300, ts_type: str = "timestamp") -> DataFrame:
    """The state as agg_provider_health reports it, as of the newest request. One row per provider meets in the window."""
    now = F.max("seen").over(Window.partitionBy(F.lit(0)))
    down = F.col("run") >= unhealthy_at
    # Whole seconds, as agg_provider_health compares them.
    seconds = lambda c: F.floor(c / 1_000_000)
    out = state.withColumn("_reset", down & (seconds(now) - seconds(F.col("last_failure")) > reset_after))
    return out.select(
        "provider", "total_requests", "successful_requests", F.timestamp_micros("last_failure").cast(ts_type).alias("last_failure"),
        F.when(F.col("_reset"), F.lit(0)).otherwise(F.col("run")).alias("consecutive_failures"), (~down | F.col("_reset")).alias("is_healthy"),
    )


def in_two_parts(df: DataFrame, first, build: Callable[[DataFrame], DataFrame], keys: list[str], label: str) -> DataFrame:
    """Write a table in two steps and run the stream after each: a restart from the checkpoint with new files."""
    spark = df.sparkSession
    source, path, checkpoint = (scratch(spark, f"{label}-{x}") for x in ("source", "changes", "checkpoint"))
    for part in (df.filter(first), df.filter(~first)):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        out = run_changes(build(stream), path, checkpoint=checkpoint)
    return newest(out, keys)
