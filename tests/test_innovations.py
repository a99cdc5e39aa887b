"""Innovations, seasonal orders and the blocked recurrence next to plain loops."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from wxspark.operators import innovations as I
from wxspark.operators.innovations import Order


def simulated(order, x, n, seed):
    rnd = np.random.default_rng(seed)
    c, ar, ma = order.polynomials(np.array(x, float))
    e, w = rnd.normal(0, 1, n), np.zeros(n)
    for t in range(n):
        w[t] = c + sum(-ar[k] * (w[t - k] - c) for k in range(1, min(t, len(ar) - 1) + 1)) + sum(ma[k] * e[t - k] for k in range(min(t, len(ma) - 1) + 1))
    y = w
    diff = order.difference
    out = list(rnd.normal(0, 1, len(diff) - 1))
    for v in y:
        out.append(v - sum(diff[k] * out[-k] for k in range(1, len(diff))))
    return np.array(out)


def plain_innovations(y, order, x):
    diff = order.difference
    w = [sum(diff[k] * y[t - k] for k in range(len(diff))) for t in range(len(diff) - 1, len(y))]
    c, ar, ma = order.polynomials(np.array(x, float))
    e = [0.0] * len(w)
    for t in range(order.reach, len(w)):
        e[t] = sum(ar[k] * (w[t - k] - c) for k in range(len(ar))) - sum(ma[k] * e[t - k] for k in range(1, min(t, len(ma) - 1) + 1))
    return np.array(e)


ORDERS = [Order(1, 0, 1), Order(2, 1, 2), Order(0, 0, 2), Order(1, 0, 1, 1, 0, 1, 6), Order(0, 1, 1, 0, 1, 1, 4), Order(2, 0, 0, 2, 0, 2, 5)]


@pytest.mark.parametrize("order", ORDERS)
def test_innovations_and_derivatives(order):
    rnd = np.random.default_rng(2)
    x = np.r_[0.3, rnd.uniform(-0.4, 0.4, order.size - 1)]
    y = simulated(order, x, 700, 5)
    w = np.convolve(y, order.difference, "valid")
    e, j = I.innovations_of(w, order, x)
    assert np.allclose(e, plain_innovations(y, order, x), atol=1e-8)
    for k in range(order.size):
        up, down = x.copy(), x.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert np.allclose(j[:, k], (plain_innovations(y, order, up) - plain_innovations(y, order, down)) / 2e-6, atol=1e-4)


@pytest.mark.parametrize(("order", "x"), [(Order(1, 0, 1), (2.0, 0.6, 0.5)), (Order(0, 1, 1, 0, 1, 1, 6), (0.0, -0.5, -0.6)), (Order(1, 0, 0, 1, 0, 1, 6), (1.0, 0.4, 0.7, -0.4))])
def test_known_parameters_are_found(order, x):
    y = simulated(order, x, 6000, 11)
    found, sse, n = I.fit_series(y, order)
    assert np.allclose(found[1:], x[1:], atol=0.06) and abs(sse / n - 1) < 0.06
    # No neighbour fits better.
    w = np.convolve(y, order.difference, "valid")
    for k in range(order.size):
        for step in (-1e-3, 1e-3):
            other = found.copy()
            other[k] += step
            assert float((I.innovations_of(w, order, other)[0][order.reach :] ** 2).sum()) >= sse - 1e-6 * sse


def test_autoregression_equals_least_squares():
    y = simulated(Order(2), (1.0, 0.5, 0.2), 400, 3)
    found, sse, _ = I.fit_series(y, Order(2))
    m = np.column_stack([np.ones(398), y[1:-1], y[:-2]])
    want, left = np.linalg.lstsq(m, y[2:], rcond=None)[:2]
    assert np.allclose(found[1:], want[1:], atol=1e-6) and abs(sse - left[0]) < 1e-6


def frame(spark, series):
    start = datetime(2024, 1, 1)
    rows = [(s, start + timedelta(hours=i), float(v)) for s, ys in series.items() for i, v in enumerate(ys)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "station string, ts timestamp_ntz, y double").repartition(5)


@pytest.mark.parametrize("block", [None, 37])
@pytest.mark.parametrize("order", [Order(1, 1, 2), Order(1, 0, 1, 1, 0, 1, 6), Order(2, 0, 0)])
def test_residuals_of_blocks_equal_a_plain_loop(spark, order, block):
    series = {"a": simulated(order, np.r_[0.5, np.full(order.size - 1, 0.3)], 300, 1), "b": simulated(order, np.r_[0.0, np.full(order.size - 1, -0.2)], 111, 2)}
    df = frame(spark, series)
    fits = I.fit_orders(df, "y", [order]).persist()
    assert fits.count() == 2
    got = {}
    for r in I.residuals(df, "y", fits, order, block=block).orderBy("ts").collect():
        got.setdefault(r.station, []).append(r.e)
    for f in fits.collect():
        want = plain_innovations(series[f.station], order, f.params)[order.reach :]
        assert np.allclose(got[f.station], want, atol=1e-8)
        assert abs(f.sigma**2 - (want**2).mean()) < 1e-9


def test_seasonal_search_finds_the_season(spark):
    series = {"a": simulated(Order(0, 0, 0, 1, 0, 0, 6), (0.0, 0.8), 600, 4), "b": simulated(Order(1, 0, 0), (0.0, 0.7), 600, 6), "short": np.arange(8.0)}
    fits = I.fit_orders(frame(spark, series), "y", I.order_grid(p=(0, 1), d=(0,), q=(0, 1), D=(0,), period=6)).persist()
    best = {r.station: r for r in I.best_seasonal(fits, criterion="bic").collect()}
    assert set(best) == {"a", "b"} and (best["a"].sp, best["a"].p) == (1, 0) and (best["b"].p, best["b"].sp) == (1, 0)
    assert fits.where("station = 'a'").count() == 16 and fits.select("n").distinct().count() == 1
    assert fits.where("station = 'a'").agg({"aic": "min"}).first()[0] <= best["a"].aic


@pytest.mark.parametrize("order", [Order(1, 0, 1), Order(0, 1, 1, 1, 0, 1, 4)])
def test_long_fit_equals_the_fit_in_one_task(spark, monkeypatch, order):
    """Blocks of 90 rows and a start from a part of the series lead to the same parameters."""
    monkeypatch.setattr(I, "START_ROWS", 120)
    series = {"a": simulated(order, np.r_[0.5, np.full(order.size - 1, 0.3)], 400, 1), "b": simulated(order, np.r_[0.0, np.full(order.size - 1, -0.2)], 300, 2), "c": np.arange(6.0)}
    df = frame(spark, series)
    want = {r.station: r for r in I.fit_orders(df, "y", [order]).collect()}
    got = {r.station: r for r in I.fit_long(df, "y", order, block=90).collect()}
    assert set(got) == set(want) == {"a", "b"}
    for s in got:
        assert np.allclose(got[s].params, want[s].params, atol=1e-3) and abs(got[s].sigma - want[s].sigma) < 1e-6 and got[s].n == want[s].n
