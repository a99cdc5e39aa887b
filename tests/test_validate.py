import numpy as np
from pyspark.sql import functions as F

from wxspark.operators import fuzzy
from wxspark.plans import validate


def test_models_over_folds_equal_a_loop(full):
    splits = 2
    models = {"arima": validate.by_autoregression(), "fuzzy": validate.by_rules()}
    got = {(r["station"], r["fold"], r["model"]): r for r in validate.cv_folds(full, "temperature", models, n_splits=splits).collect()}
    want = set()
    for s in ("a", "b"):
        part = full.filter(F.col("station") == s)
        rows = part.orderBy("ts").select("ts", "temperature").collect()
        y = np.array([r["temperature"] for r in rows])
        size = len(y) // (splits + 1)
        for fold in range(splits):
            n = size * (fold + 1)
            x, t = y[n - 1 : n + size - 1], y[n : n + size]
            params = fuzzy.fz_fit(part.filter(F.col("ts") < rows[n]["ts"]))
            values = full.sparkSession.createDataFrame([(s, i, float(v)) for i, v in enumerate(x)], "station string, i int, v double").join(params, "station")
            led = [r[0] for r in values.orderBy("i").select(F.get("map", fuzzy.best_set(F.col("v"), fuzzy.FuzzyConfig()))["value"]).collect()]
            found = got[s, fold, "fuzzy"]
            assert found["n"] == size and abs(found["mae"] - np.abs(np.array(led) - t).mean()) < 1e-9
            want.add((s, fold, "fuzzy"))
            if n - 1 < 50:
                continue
            b, a = np.polyfit(y[: n - 1], y[1:n], 1)
            assert abs(got[s, fold, "arima"]["rmse"] - np.sqrt(((a + b * x - t) ** 2).mean())) < 1e-8
            want.add((s, fold, "arima"))
    assert set(got) == want


def test_empty_and_nameless_series(full):
    assert validate.cv_models(full.limit(0), "temperature").isEmpty()
    assert validate.cv_models(full.filter("station = 'a'").withColumn("station", F.lit(None).cast("string")), "temperature").isEmpty()
