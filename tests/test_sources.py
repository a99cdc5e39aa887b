import json
from datetime import datetime

import pytest

from wxspark.session import scratch
from wxspark.sources import providers as P
from wxspark.sources import stores as S


def write(tmp_path, name, *payloads):
    d = tmp_path / name
    d.mkdir()
    for i, p in enumerate(payloads):
        (d / f"{i}.json").write_text(p if isinstance(p, str) else json.dumps(p))
    return str(d)


def test_hourly_defaults(spark, tmp_path):
    hourly = {
        "time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.5, None], "relative_humidity_2m": [80, 0],
        "surface_pressure": [None, 0], "wind_speed_10m": [3, 4], "wind_direction_10m": [10, 20], "cloud_cover": [5, None],
        "precipitation": [None, 0.4],
    }
    rows = P.read_openmeteo_hourly(spark, write(tmp_path, "h", {"latitude": 1.234, "longitude": 5.0, "hourly": hourly})).orderBy("timestamp").collect()
    assert [r["timestamp"] for r in rows] == [datetime(2024, 1, 1, 0), datetime(2024, 1, 1, 1)]
    assert [r["temperature"] for r in rows] == [1.5, 0.0] and [r["pressure"] for r in rows] == [1013.25, 1013.25]
    assert [r["precipitation"] for r in rows] == [0.0, 0.4] and rows[0]["location"]["name"] == "Location (1.23, 5.00)"


def test_current_payloads(spark, tmp_path):
    a = {"latitude": 10.0, "longitude": 20.0, "current": {"time": "2024-01-01T05:00Z", "temperature_2m": 7.0, "relative_humidity_2m": 50.0, "surface_pressure": 1000.0, "wind_speed_10m": 1.0, "wind_direction_10m": 2.0, "cloud_cover": 3.0}}
    r = P.read_openmeteo_current(spark, write(tmp_path, "a", a)).first()
    assert r["precipitation"] == 0.0 and r["timestamp"] == datetime(2024, 1, 1, 5) and r["location"]["country"] == "Unknown"
    b = {"location": {"name": "X", "lat": 1.0, "lon": 2.0, "country": "Y", "region": "Z", "localtime": "2024-01-01 6:00"}, "current": {"temp_c": 5.0, "humidity": 40, "pressure_mb": 1010, "wind_kph": 36.0, "wind_degree": 90, "cloud": 10, "precip_mm": 0.2}}
    r = P.read_weatherapi_current(spark, write(tmp_path, "b", b)).first()
    assert r["wind_speed"] == 10.0 and r["location"]["region"] == "Z" and r["timestamp"] == datetime(2024, 1, 1, 6)
    c = {"name": "N", "coord": {"lat": 1.0, "lon": 2.0}, "sys": {"country": "IN"}, "dt": 1704067200, "main": {"temp": 9.0, "humidity": 1, "pressure": 2}, "wind": {"speed": 3.0}, "clouds": {"all": 4}}
    r = P.read_owm_current(spark, write(tmp_path, "c", c)).first()
    assert (r["wind_direction"], r["precipitation"], r["timestamp"]) == (0.0, 0.0, datetime(2024, 1, 1))


def test_broken_day_is_skipped(spark, tmp_path):
    hour = {"time": "2024-01-0{} 00:00", "temp_c": 1.0, "humidity": 1, "pressure_mb": 1, "wind_kph": 3.6, "wind_degree": 1, "cloud": 1}
    day = lambda n: {"location": {"name": "X", "lat": 1.0, "lon": 2.0, "country": "Y"}, "forecast": {"forecastday": [{"hour": [dict(hour, time=f"2024-01-0{n} 00:00")]}]}}
    rows = P.read_weatherapi_history(spark, write(tmp_path, "d", day(1), '{"location": {"name": ', day(3))).collect()
    assert sorted(r["timestamp"].day for r in rows) == [1, 3] and rows[0]["wind_speed"] == 1.0


def test_geocoding(spark, tmp_path):
    d = tmp_path / "g"
    d.mkdir()
    (d / "delhi.json").write_text(json.dumps({"results": [{"name": "Delhi", "latitude": 28.6, "longitude": 77.2, "admin1": "DL"}, {"name": "New Delhi", "latitude": 28.7, "longitude": 77.1, "country": "India"}]}))
    (d / "nowhere.json").write_text("{}")
    rows = P.geocode_openmeteo((spark, str(d))).orderBy("rank").collect()
    assert [(r["query"], r["rank"], r["name"], r["country"]) for r in rows] == [("delhi", 1, "Delhi", "Unknown"), ("delhi", 2, "New Delhi", "India")]
    for read, field, name in ((P.geocode_weatherapi, "region", "w"), (P.geocode_owm, "state", "o")):
        e = tmp_path / name
        e.mkdir()
        (e / "x y.json").write_text(json.dumps([{"name": "A", "lat": 1.0, "lon": 2.0, "country": "C", field: "R"}, {"name": "B", "lat": 1.0, "lon": 2.0, "country": "C"}]))
        rows = read((spark, str(e)), limit=1).collect()
        assert len(rows) == 1 and rows[0]["region"] == "R" and rows[0]["query"] == "x y"


def test_upsert_is_idempotent(spark, full):
    obs = full.selectExpr("1.0D AS latitude", "2.0D AS longitude", "ts", "temperature", "station").filter("station = 'a'").drop("station")
    where = scratch(spark, "upsert-test")
    for _ in range(3):
        S.upsert_obs(spark, obs.unionByName(obs), where, source="s")
    assert spark.read.parquet(where).count() == obs.count()


def test_snapshots(spark, full):
    where = scratch(spark, "snap")
    for i, day in ((1, 1), (2, 5), (3, 3)):
        S.write_snapshot(full.limit(i), where, snapshot_id=f"s{i}", model="m", lat=1.0, lon=2.0, created_at=datetime(2024, 1, day), features=["a"], config={"k": "v"})
    assert S.read_snapshot(spark, where, "m", 1.0, 2.0).count() == 2
    assert S.active_snapshots(spark.read.parquet(f"{where}/headers")).first()["config"] == {"k": "v"}
    assert S.read_snapshot(spark, where, "other", 1.0, 2.0).count() == 0


def entry(i, kind, created, mae=1.0, active=True, lat=1.0):
    return (i, kind, "1", lat, 2.0, created, created, {}, ["f"], ["t"], mae, mae, mae, "p", 1, active, True)


def test_registry(spark):
    where = scratch(spark, "registry")
    d = lambda n: datetime(2024, 1, n)
    S.registry_append(spark, [entry("a", "fuzzy", d(1)), entry("b", "arima", d(2), 0.5), entry("c", "fuzzy", d(3), None), entry("far", "fuzzy", d(4), lat=9.0)], where)
    log = spark.read.parquet(where)
    assert [r["model_id"] for r in S.registry_active(log, 1.05, 2.0).collect()] == ["c", "b", "a"]
    best = {r["model_type"]: r["model_id"] for r in S.registry_best(log).collect()}
    assert best["arima"] == "b" and best["fuzzy"] in ("a", "far")
    S.registry_append(spark, S.registry_deactivate(log, 1.0, 2.0, datetime(2024, 2, 1), model_type="fuzzy"), where)
    log = spark.read.parquet(where)
    assert [r["model_id"] for r in S.registry_active(log, 1.0, 2.0).collect()] == ["b"]
    kept = S.model_cleanup(log, datetime(2024, 2, 2))
    assert {r["model_id"] for r in kept.select("model_id").distinct().collect()} == {"b", "c", "far"}


def test_saved_models(spark, full):
    root = scratch(spark, "models")
    assert S.list_models(spark, root) == []
    S.save_model(full.limit(3), root, "m1", {"p": "1"})
    S.save_model(full.limit(2), root, "m2")
    assert S.list_models(spark, root) == ["m1", "m2"] and S.model_exists(spark, root, "m1")
    params, meta = S.load_model(spark, root, "m1")
    assert params.count() == 3 and meta == {"p": "1"}
    assert S.delete_model(spark, root, "m1") and S.list_models(spark, root) == ["m2"]


def test_reads_push_down(spark, full):
    where = scratch(spark, "push")
    full.selectExpr("*", "1.0D AS latitude", "2.0D AS longitude").write.parquet(where)
    plan = S.read_obs(spark, where, 1.0, 2.0, "2024-01-01", "2024-01-02").select("ts", "temperature")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(latitude" in plan and "humidity" not in plan


@pytest.mark.parametrize("empty", [True])
def test_empty_input_flattens_to_empty(spark, empty):
    from wxspark.schema import OBSERVATION

    assert S.flatten_obs(spark.createDataFrame([], OBSERVATION)).count() == 0
