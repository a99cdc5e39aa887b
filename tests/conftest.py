import math
import os
import random
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wxspark.schema import BASE  # noqa: E402
from wxspark.session import build  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = build(f"local[{os.environ.get('TEST_CPUS', '8')}]", "tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def weather_rows(station="s", n=200, seed=42):
    """A daily and a half-day wave with noise, hourly."""
    rnd = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        day = 2 * math.pi * i / 24
        rows.append(
            (
                station,
                start + timedelta(hours=i),
                20 + 10 * math.sin(day) + rnd.gauss(0, 2),
                50 + 20 * math.sin(day + math.pi / 4) + rnd.gauss(0, 5),
                1013 + 10 * math.sin(day / 2) + rnd.gauss(0, 3),
                abs(5 + 3 * abs(math.sin(2 * day)) + rnd.gauss(0, 1)),
                (15.0 * i) % 360,
                30 + 40 * rnd.random(),
                rnd.expovariate(2),
            )
        )
    return rows


OBS_SCHEMA = "station string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in BASE)


@pytest.fixture(scope="session")
def obs(spark):
    """Two stations of different length; the longer one misses some temperatures."""
    rows = weather_rows("a", 200) + weather_rows("b", 131, 7)
    rows = [r if i % 11 else (*r[:2], None, *r[3:]) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, OBS_SCHEMA).persist()


@pytest.fixture(scope="session")
def full(spark):
    return spark.createDataFrame(weather_rows("a", 200) + weather_rows("b", 131, 7), OBS_SCHEMA).persist()


def as_set(df, digits=9):
    def plain(v):
        if isinstance(v, float):
            return round(v, digits)
        if isinstance(v, list):
            return tuple(plain(x) for x in v)
        return v

    cols = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
