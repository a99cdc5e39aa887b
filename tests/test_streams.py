from pyspark.sql import functions as F

from conftest import as_set
from wxspark.operators import fuzzy, places
from wxspark.operators.fuzzy import FuzzyConfig
from wxspark.session import scratch
from wxspark.streaming import jobs


def test_rules_over_two_runs(full):
    labels = fuzzy.prepare(full)[1].select("station", "ts", "label")
    got = jobs.in_two_parts(labels, F.dayofmonth("ts") <= 3, jobs.st_rules, ["station"], "t-rules")
    want = fuzzy.agg_rule_counts(fuzzy.prepare(full)[1], FuzzyConfig(min_support=1)).select("station", "antecedent", "consequent", "n")
    assert as_set(jobs.rule_counts(got)) == as_set(want)


def test_late_label_comes_between(spark):
    rows = [("s", 1, "A", 0), ("s", 2, "B", 0), ("s", 10, "C", 0), ("s", 5, "D", 1), ("t", 1, "A", 0), ("t", 100, "B", 0), ("t", 0, "C", 1), ("t", 120, "A", 1)]
    labels = spark.createDataFrame(rows, "station string, h int, label string, part int").select("station", F.timestamp_seconds(F.col("h") * 3600).alias("ts"), "label", "part")
    got = jobs.rule_counts(jobs.in_two_parts(labels, F.col("part") == 0, jobs.st_rules, ["station"], "t-late"))
    # C of t is older than its last settled label by the time it comes.
    assert as_set(got) == sorted([(p, q, 1, s) for s, p, q in [("s", "A", "B"), ("s", "B", "D"), ("s", "D", "C"), ("t", "A", "B"), ("t", "B", "A")]], key=str)


def test_health_over_two_runs(spark):
    rows = [("a", i, i % 4 == 0) for i in range(23)] + [("b", i, i < 10) for i in range(20)] + [("c", i, True) for i in range(5)] + [("d", i, False) for i in range(12, 15)]
    log = spark.createDataFrame(rows, "provider string, n int, success boolean").select("provider", F.timestamp_seconds(F.col("n") * 60).alias("ts"), "success")
    state = jobs.in_two_parts(log, F.col("ts") < F.timestamp_seconds(F.lit(12 * 60)), jobs.st_provider_health, ["provider"], "t-health")
    cols = ["provider", "total_requests", "successful_requests", "consecutive_failures", "is_healthy", "last_failure"]
    assert as_set(jobs.health_status(state).select(cols)) == as_set(places.agg_provider_health(log).select(cols))


def test_health_with_late_requests(spark):
    rows = [("a", 10, True, 0), ("a", 3, False, 1), ("a", 4, False, 1), ("a", 5, False, 1), ("b", 1, False, 0), ("b", 5, False, 0), ("b", 6, False, 0), ("b", 4, True, 1), ("c", 9, False, 0), ("c", 8, False, 1), ("c", 7, False, 1)]
    log = spark.createDataFrame(rows, "provider string, n int, success boolean, part int").select("provider", F.timestamp_seconds(F.col("n") * 60).alias("ts"), "success", "part")
    state = jobs.in_two_parts(log, F.col("part") == 0, jobs.st_provider_health, ["provider"], "t-late")
    cols = ["provider", "total_requests", "successful_requests", "consecutive_failures", "is_healthy", "last_failure"]
    assert as_set(jobs.health_status(state).select(cols)) == as_set(places.agg_provider_health(log).select(cols))


def test_repeated_batch_is_harmless(spark, full):
    labels = fuzzy.prepare(full)[1].select("station", "ts", "label").persist()
    where = scratch(spark, "t-repeat")
    source = scratch(spark, "t-source")
    labels.write.parquet(source)
    for _ in range(2):
        # A lost checkpoint replays batch 0; the rows of that number are written again, not added.
        stream = spark.readStream.schema(labels.schema).parquet(source)
        out = jobs.run_changes(jobs.st_rules(stream), where, checkpoint=scratch(spark, "t-cp"))
    assert jobs.rule_counts(jobs.newest(out, ["station"])).agg(F.sum("n")).first()[0] == 199 + 130


def test_errors_keep_the_newest(spark):
    log = spark.range(500).select(
        F.lit("s").alias("station"), F.lit("m").alias("model"), F.timestamp_seconds("id").alias("ts"), F.col("id").cast("double").alias("abs_error")
    )
    out = jobs.recent_errors(jobs.in_two_parts(log, F.col("abs_error") < 450, jobs.st_errors, ["station", "model"], "t-errors"))
    assert out.count() == 100 and out.agg(F.min("abs_error")).first()[0] == 400.0


def test_states_of_odd_rows(spark):
    labels = spark.createDataFrame([("s", 3, "B"), ("s", None, "X"), ("s", 1, "A"), ("s", 2, None), (None, 1, "A"), (None, 2, "A"), ("u", 1, "A")], "station string, h int, label string")
    labels = labels.select("station", F.timestamp_seconds(F.col("h") * 3600).alias("ts"), "label")
    got = jobs.rule_counts(jobs.in_two_parts(labels, F.coalesce(F.col("label") == "A", F.lit(False)), jobs.st_rules, ["station"], "t-odd"))
    # A label that is missing ends a chain: it follows A, nothing follows it.
    assert as_set(got) == sorted([("A", None, 1, "s"), ("A", "A", 1, None)], key=str)
    none = jobs.in_two_parts(labels.limit(0), F.lit(True), jobs.st_rules, ["station"], "t-none")
    assert jobs.rule_counts(none).isEmpty()


def test_long_failures_settle_into_one_number(spark):
    # Two days without a success, an hour apart; a success older than the delay no longer undoes them, a new one does.
    rows = [("a", h, False, 0) for h in range(48)] + [("a", 5, True, 1)] + [("b", h, False, 0) for h in range(48)] + [("b", 40, True, 1)]
    log = spark.createDataFrame(rows, "provider string, h int, success boolean, part int").select("provider", F.timestamp_seconds(F.col("h") * 3600).alias("ts"), "success", "part")
    state = jobs.in_two_parts(log, F.col("part") == 0, jobs.st_provider_health, ["provider"], "t-settle")
    assert {r["provider"]: r["run"] for r in state.collect()} == {"a": 48, "b": 7}
