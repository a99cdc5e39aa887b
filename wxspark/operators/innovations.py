"""Moving-average terms by true innovations: seasonal ARMA by conditional least squares, on series of any length.

The innovations of a model follow a linear recurrence, e(t) = x(t) - m1 e(t-1) - m2 e(t-2) ..., which looks back to the start of the
series. A block of rows maps the state before it to the state after it by an affine map, so blocks are run from a zero state side by side,
their maps are composed in order (one small row per block), and every block is run again from its own start state. The
derivatives of the innovations by the parameters obey the same recurrence and take the same path, and Gauss-Newton steps follow from sums over
all rows. Series that fit a task are fitted there in one go, by the same formulas.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wxspark.operators import timeline
from wxspark.operators.timeline import POS, Shape, measure
from wxspark.schema import STATION, TS
from wxspark.session import stored

#: Rows of a block, and rows that a step of the recurrence works out at once.
BLOCK, CHUNK = 65_536, 256
#: First rows of a long series that give its start values.
START_ROWS = 50_000


@dataclass(frozen=True)
class Order:
    """Orders of a multiplicative model: (p, d, q) and seasonal (P, D, Q) with a period."""

    p: int = 1
    d: int = 0
    q: int = 0
    P: int = 0
    D: int = 0
    Q: int = 0
    period: int = 24

    @property
    def size(self) -> int:
        return 1 + self.p + self.q + self.P + self.Q

    @property
    def difference(self) -> np.ndarray:
        """Coefficients of (1 - B)^d (1 - B^period)^D."""
        out = np.ones(1)
        for _ in range(self.d):
            out = np.convolve(out, [1, -1])
        for _ in range(self.D):
            out = np.convolve(out, [1, *[0] * (self.period - 1), -1])
        return out

    def parts(self, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Constant and the polynomials of the plain and seasonal autoregression and moving average."""
        p, q, P, Q = self.p, self.q, self.P, self.Q
        season = lambda c: np.concatenate([[1.0], *[[0.0] * (self.period - 1) + [v] for v in c]])
        phi, theta, big_phi, big_theta = np.split(np.asarray(x[1:], float), np.cumsum([p, q, P]))
        return float(x[0]), np.r_[1.0, -phi], np.r_[1.0, theta], season(-big_phi), season(big_theta)

    def polynomials(self, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Constant, autoregressive and moving-average polynomial, multiplied out."""
        c, phi, theta, big_phi, big_theta = self.parts(x)
        return c, np.convolve(phi, big_phi), np.convolve(theta, big_theta)

    @property
    def reach(self) -> int:
        """Rows of the differenced series before the first innovation."""
        return self.p + self.P * self.period


def lagged(x: np.ndarray, poly: np.ndarray, shift: int = 0) -> np.ndarray:
    """poly(B) B^shift x with zeros before the first row."""
    out = np.zeros(len(x))
    for k in np.flatnonzero(poly):
        at = int(k) + shift
        if at < len(x):
            out[at:] += poly[k] * x[: len(x) - at]
    return out


def run_recurrence(x: np.ndarray, ma: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """y(t) = x(t) - sum over j >= 1 of ma[j] y(t - j) for every column; ``start[j]`` is y(-1 - j)."""
    q = len(ma) - 1
    if not q or not len(x):
        return x.astype(float)
    size = min(CHUNK, len(x))
    # Responses of a chunk to a unit input and to each row of the state before it, from the same recurrence.
    unit, back = np.zeros(size), np.zeros((size + q, q))
    back[np.arange(q - 1, -1, -1), np.arange(q)] = 1
    for t in range(size):
        unit[t] = (t == 0) - sum(ma[j] * unit[t - j] for j in range(1, min(q, t) + 1))
        back[q + t] = -ma[1:] @ back[q + t - 1 :: -1][:q] if t + q > 0 else 0
    lower = np.tril(unit[np.abs(np.subtract.outer(np.arange(size), np.arange(size)))])
    state = np.zeros((q, x.shape[1])) if start is None else np.array(start, float)
    out = np.empty(x.shape)
    for s in range(0, len(x), size):
        part = x[s : s + size]
        n = len(part)
        y = lower[:n, :n] @ part + back[q : q + n] @ state
        out[s : s + n] = y
        state = np.vstack([y[::-1], state])[:q]
    return out


def transition(ma: np.ndarray, n: int) -> np.ndarray:
    """What ``n`` rows make of the state, without input."""
    q = len(ma) - 1
    one = np.eye(q, k=-1)
    one[0] = -ma[1:]
    return np.linalg.matrix_power(one, n)


def recurrence(df: DataFrame, columns: Sequence[str], coefs: DataFrame, *, station=STATION, ts=TS, shape: Shape | None = None, block: int | None = None) -> DataFrame:
    """``df`` with ``columns`` run through each station's recurrence; ``coefs`` (station, ma) holds polynomials that start with 1.

    Three passes: blocks from a zero state, the composition of their maps, blocks from their own state. Rows of stations without
    coefficients go; the state before a series is zero. Null inputs are not allowed.
    """
    block, columns = block or BLOCK, list(columns)
    placed = timeline.with_position(df, station=station, ts=ts, shape=shape or measure(df, station)).drop(timeline.COUNT)
    placed = stored(placed.withColumn("_block", F.floor(F.col(POS) / block)).join(coefs.select(station, F.col("ma").alias("_ma")), station), "recurrence")
    kinds, n = dict(placed.dtypes), len(columns)

    def ends(key, part):
        part = part.sort_values(POS)
        ma = np.array(part["_ma"].iloc[0])
        y = run_recurrence(part[columns].to_numpy(float), ma)
        last = np.vstack([y[::-1], np.zeros((len(ma), n))])[: len(ma) - 1]
        return pd.DataFrame({station: [key[0]], "_block": [key[1]], "_rows": [len(part)], "_ma": [ma.tolist()], "_end": [last.ravel().tolist()]})

    def compose(key, maps):
        maps = maps.sort_values("_block")
        ma = np.array(maps["_ma"].iloc[0])
        state, starts = np.zeros((len(ma) - 1, n)), []
        for rows, end in zip(maps["_rows"], maps["_end"]):
            starts.append(state.ravel().tolist())
            state = transition(ma, rows) @ state + np.reshape(end, state.shape) if len(ma) > 1 else state
        return pd.DataFrame({station: maps[station], "_block": maps["_block"], "_start": starts})

    def whole(key, part):
        part = part.sort_values(POS)
        ma = np.array(part["_ma"].iloc[0])
        start = np.reshape(part["_start"].iloc[0], (len(ma) - 1, n))
        part[columns] = run_recurrence(part[columns].to_numpy(float), ma, start)
        return part[[c for c in kinds if c not in ("_block", "_ma")]]

    named = ", ".join(f"`{c}` {t}" for c, t in kinds.items() if c not in ("_block", "_ma"))
    few = [station, "_block", POS, "_ma", *columns]
    maps = placed.select(*few).groupBy(station, "_block").applyInPandas(ends, f"`{station}` {kinds[station]}, _block long, _rows long, _ma array<double>, _end array<double>")
    starts = maps.groupBy(station).applyInPandas(compose, f"`{station}` {kinds[station]}, _block long, _start array<double>")
    return placed.join(starts, [station, "_block"]).groupBy(station, "_block").applyInPandas(whole, named).drop(POS)


# ---- fitting ------------------------------------------------------------------------------------------------------


def innovations_of(w: np.ndarray, order: Order, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Innovations of the differenced series and their derivatives by the parameters; the first ``reach`` rows are 0."""
    c, phi, theta, big_phi, big_theta = order.parts(x)
    _, ar, ma = order.polynomials(x)
    level, r = w - c, order.reach
    u = lagged(level, ar)
    u[:r] = 0
    e = run_recurrence(u[:, None], ma)[:, 0]
    given = [np.full(len(w), -ar.sum())]
    given += [-lagged(level, big_phi, i) for i in range(1, order.p + 1)] + [-lagged(e, big_theta, j) for j in range(1, order.q + 1)]
    given += [-lagged(level, phi, i * order.period) for i in range(1, order.P + 1)] + [-lagged(e, theta, j * order.period) for j in range(1, order.Q + 1)]
    inputs = np.column_stack(given)
    inputs[:r] = 0
    return e, run_recurrence(inputs, ma)


def start_values(w: np.ndarray, order: Order) -> np.ndarray:
    """Regression on lags of the series and of the residuals of a long autoregression."""
    level = w - w.mean()
    long = min(max(order.p + order.q + 2, 1) + (order.period if order.P or order.Q else 0), max(1, len(w) // 4))
    past = np.column_stack([lagged(level, np.ones(1), k) for k in range(1, long + 1)])
    resid = level - past @ np.linalg.lstsq(past[long:], level[long:], rcond=None)[0]
    resid[:long] = 0
    lags = [lagged(level, np.ones(1), i) for i in range(1, order.p + 1)] + [lagged(resid, np.ones(1), j) for j in range(1, order.q + 1)]
    lags += [lagged(level, np.ones(1), i * order.period) for i in range(1, order.P + 1)] + [lagged(resid, np.ones(1), j * order.period) for j in range(1, order.Q + 1)]
    out = np.zeros(order.size)
    out[0] = w.mean()
    if lags:
        found = np.linalg.lstsq(np.column_stack(lags)[long:], level[long:], rcond=None)[0]
        out[1:] = np.clip(found, -0.95, 0.95)
        if not stable(order, out):
            out[1:] *= 0.5 / max(0.5, np.abs(out[1:]).sum())
    return out


def stable(order: Order, x: np.ndarray) -> bool:
    """Whether the moving average can be inverted: every root of its plain and seasonal polynomial lies outside the unit circle."""
    _, _, theta, _, big_theta = order.parts(x)
    seasonal = big_theta[:: order.period]
    return all(len(p) < 2 or np.all(np.abs(np.roots(p)) < 1 - 1e-6) for p in (theta, seasonal))


def search(evaluate, order: Order, x: np.ndarray, steps: int = 60, tolerance: float = 1e-12) -> tuple[np.ndarray, float, int]:
    """Damped Gauss-Newton: parameters, sum of squares, rows. ``evaluate`` gives (J'J, J'e, e'e, rows) at a point."""
    jj, je, sse, n = evaluate(x)
    damp = 1e-3
    for _ in range(steps):
        scale = np.maximum(np.diag(jj), 1e-12)
        move = np.linalg.solve(jj + damp * np.diag(scale), je)
        to = x - move
        if stable(order, to):
            got = evaluate(to)
            if np.isfinite(got[2]) and got[2] <= sse:
                done = sse - got[2] <= tolerance * max(sse, 1e-300)
                x, (jj, je, sse, n), damp = to, got, max(damp / 10, 1e-12)
                if done:
                    break
                continue
        damp *= 10
        if damp > 1e12:
            break
    return x, sse, n


def fit_series(y: np.ndarray, order: Order, skip: int | None = None) -> tuple[np.ndarray, float, int] | None:
    """Parameters, sum of squared innovations and their number for one series; the first ``skip`` rows of ``y`` are not summed.

    None for a series with fewer than three summed rows per parameter.
    """
    diff = order.difference
    first = max(order.reach, (skip or 0) - (len(diff) - 1))
    if len(y) < len(diff) - 1 + first + 3 * order.size:
        return None
    w = np.convolve(y, diff, "valid")

    def evaluate(x: np.ndarray):
        e, j = innovations_of(w, order, x)
        e, j = e[first:], j[first:]
        return j.T @ j, j.T @ e, float(e @ e), len(e)

    return search(evaluate, order, start_values(w, order))


#: ``sp``, ``sd`` and ``sq`` are the seasonal orders.
FITTED = "p int, d int, q int, sp int, sd int, sq int, period int, params array<double>, ar array<double>, ma array<double>, sigma double, n long, aic double, bic double"


def _row(order: Order, x: np.ndarray, sse: float, n: int) -> dict:
    _, ar, ma = order.polynomials(x)
    sigma2 = max(sse / n, 1e-300)
    fit = n * math.log(sigma2)
    names = {"p": order.p, "d": order.d, "q": order.q, "sp": order.P, "sd": order.D, "sq": order.Q, "period": order.period}
    return {**names, "params": x.tolist(), "ar": ar.tolist(), "ma": ma.tolist(), "sigma": math.sqrt(sigma2), "n": n,
            "aic": fit + 2 * (order.size + 1), "bic": fit + math.log(n) * (order.size + 1)}


def fit_orders(df: DataFrame, target: str, orders: Sequence[Order], *, station=STATION, ts=TS, shape: Shape | None = None, parts: int = 8) -> DataFrame:
    """One row per station and order: parameters (constant, phi, theta, seasonal phi, seasonal theta), polynomials, sigma, aic, bic.

    All orders of a station are summed over the same rows, so that their criteria compare. A station's orders are dealt over
    ``parts`` tasks. Rows with a null target are left out. Stations with too few rows for an order have no row for it. For series beyond
    the size of a task use ``fit_long``.
    """
    shape = shape or measure(df, station)
    if not shape.whole:
        raise ValueError("a series is longer than a task may hold; fit_long takes one order at a time")
    skip = max(len(o.difference) - 1 + o.reach for o in orders)
    kind = dict(df.dtypes)[station]
    rows = df.select(station, ts, F.col(target).cast("double").alias("y")).dropna(subset=["y"])
    spread = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(min(parts, len(orders)) - 1))))

    def fit(key, f):
        y, out = f.sort_values(ts)["y"].to_numpy(), []
        for order in orders[int(key[1]) :: min(parts, len(orders))]:
            found = fit_series(y, order, skip)
            if found is not None:
                out.append({station: key[0], **_row(order, *found)})
        return pd.DataFrame(out, columns=[station, *[c.split()[0] for c in FITTED.split(", ")]])

    return spread.groupBy(station, "part").applyInPandas(fit, f"`{station}` {kind}, {FITTED}")


def order_grid(p=(0, 1, 2), d=(0, 1), q=(0, 1, 2), P=(0, 1), D=(0, 1), Q=(0, 1), period: int = 24) -> list[Order]:  # noqa: N803
    return [Order(*o, period) for o in product(p, d, q, P, D, Q)]


def best_seasonal(fits: DataFrame, *, criterion: str = "aic", station=STATION) -> DataFrame:
    """The order with the least criterion of each station; ties go to fewer parameters, then to the smaller orders."""
    rank = F.struct(criterion, F.size("params"), "sd", "sp", "sq", "d", "p", "q")
    rest = [c for c in fits.columns if c != station]
    return fits.groupBy(station).agg(F.min_by(F.struct(*rest), rank).alias("_b")).select(station, "_b.*")


def differenced_rows(df: DataFrame, target: str, order: Order, *, station=STATION, ts=TS, shape: Shape | None = None) -> DataFrame:
    """station, ts, w: the differenced series without its first rows."""
    rows = df.select(station, ts, F.col(target).cast("double").alias("y")).dropna(subset=["y"])
    diff = order.difference
    wide = timeline.over_rows(rows, lambda o: {"w": sum((F.lag("y", int(k)).over(o) if k else F.col("y")) * float(diff[k]) for k in np.flatnonzero(diff))}, back=len(diff), station=station, ts=ts, shape=shape)
    return wide.dropna(subset=["w"]).select(station, ts, "w")


def residuals(df: DataFrame, target: str, fits: DataFrame, order: Order, *, station=STATION, ts=TS, shape: Shape | None = None, block: int | None = None) -> DataFrame:
    """station, ts, e: the innovations of every row after the first ``reach`` of the differenced series, for series of any length."""
    w = differenced_rows(df, target, order, station=station, ts=ts, shape=shape)
    wide = _with_lags(w, order, station, ts, shape)
    own = fits.select(station, F.col("params")[0].alias("_c"), F.col("ar").alias("_ar"), "ma")
    j = wide.join(own.drop("ma"), station)
    return recurrence(j.select(station, ts, _filtered("_ar").alias("e")), ["e"], own.select(station, "ma"), station=station, ts=ts, block=block)


def _with_lags(w: DataFrame, order: Order, station: str, ts: str, shape: Shape | None) -> DataFrame:
    """``_l``: the differenced value and the ``reach`` values before it, for rows that have all of them."""
    r = order.reach
    wide = timeline.over_rows(w, lambda o: {"_l": F.array(*[F.lag("w", k).over(o) if k else F.col("w") for k in range(r + 1)])}, back=max(r, 1), station=station, ts=ts, shape=shape)
    return wide.filter(F.get("_l", F.lit(r)).isNotNull())


def _filtered(poly: str, values: str = "_l", shift: int = 0, centre: str | None = "_c") -> Column:
    """poly(B) B^shift of the newest value of an array of lags, values taken around ``centre``."""
    past = F.slice(values, shift + 1, F.size(poly)) if shift else F.col(values)
    around = F.col(centre) if centre else F.lit(0.0)
    return F.aggregate(F.zip_with(past, poly, lambda x, a: F.coalesce((x - around) * a, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)


def _normal_equations(wide: DataFrame, points: DataFrame, order: Order, station: str, ts: str, shape: Shape, block: int | None) -> DataFrame:
    """station, jj, je, sse, n at each station's ``params``: the innovations, then their derivatives, then sums over all rows."""

    def expand(batches):
        for b in batches:
            made = []
            for x in b["params"]:
                c, phi, theta, big_phi, big_theta = order.parts(np.array(x))
                _, ar, ma = order.polynomials(np.array(x))
                made.append((c, *[v.tolist() for v in (phi, theta, big_phi, big_theta, ar, ma)]))
            yield pd.concat([b[[station]].reset_index(drop=True), pd.DataFrame(made, columns=["_c", "_phi", "_theta", "_bphi", "_btheta", "_ar", "ma"])], axis=1)

    kind = dict(points.dtypes)[station]
    arrays = ", ".join(f"{c} array<double>" for c in ("_phi", "_theta", "_bphi", "_btheta", "_ar", "ma"))
    own = stored(points.select(station, "params").mapInPandas(expand, f"`{station}` {kind}, _c double, {arrays}"), "points")
    j = wide.join(own, station)
    given = {"d0": -F.aggregate("_ar", F.lit(0.0), lambda s, v: s + v)}
    given |= {f"d{i}": -_filtered("_bphi", shift=i) for i in range(1, order.p + 1)}
    at = 1 + order.p + order.q
    given |= {f"d{at + i}": -_filtered("_phi", shift=(i + 1) * order.period) for i in range(order.P)}
    coefs = own.select(station, "ma")
    rows = recurrence(j.select(station, ts, _filtered("_ar").alias("e"), *[v.alias(k) for k, v in given.items()]), ["e"], coefs, station=station, ts=ts, shape=shape, block=block)
    back = order.q + order.Q * order.period
    if back:
        rows = timeline.over_rows(rows, lambda o: {"_e": F.array(*[F.lag("e", k).over(o) for k in range(back + 1)])}, back=back, station=station, ts=ts, shape=shape)
        rows = rows.join(own.select(station, "_theta", "_btheta"), station)
        more = {f"d{1 + order.p + i}": -_filtered("_btheta", "_e", i + 1, None) for i in range(order.q)}
        more |= {f"d{at + order.P + i}": -_filtered("_theta", "_e", (i + 1) * order.period, None) for i in range(order.Q)}
        rows = rows.select(station, ts, "e", *given, *[v.alias(k) for k, v in more.items()])
    names = [f"d{i}" for i in range(order.size)]
    slopes = recurrence(rows.select(station, ts, "e", *names), names, coefs, station=station, ts=ts, shape=shape, block=block)
    k = order.size
    sums = [F.sum(F.col(a) * F.col(b)) for a in names for b in names]
    return slopes.groupBy(station).agg(F.array(*sums).alias("jj"), F.array(*[F.sum(F.col(a) * F.col("e")) for a in names]).alias("je"), F.sum(F.col("e") * F.col("e")).alias("sse"), F.count(F.lit(1)).alias("n"))


def fit_long(df: DataFrame, target: str, order: Order, *, steps: int = 12, tolerance: float = 1e-10, station=STATION, ts=TS, shape: Shape | None = None, block: int | None = None) -> DataFrame:
    """``fit_orders`` for one order and series of any length: every step is a few passes over blocks, for all stations together.

    Start values come from a fit of the first START_ROWS rows; all rows count from the first step on. Stations whose sum of squares no longer
    falls keep their parameters while others go on. Rows with a null target are left out.
    """
    shape = shape or measure(df, station)
    kind = dict(df.dtypes)[station]
    known = df.select(station, ts, F.col(target).cast("double").alias("y")).dropna(subset=["y"])
    first = timeline.with_position(known, station=station, ts=ts, shape=shape).filter(F.col(POS) < START_ROWS).select(station, ts, "y")

    def start(key, f):
        found = fit_series(f.sort_values(ts)["y"].to_numpy(), order)
        return pd.DataFrame([(key[0], found[0].tolist())] if found else [], columns=[station, "params"])

    points = stored(first.groupBy(station).applyInPandas(start, f"`{station}` {kind}, params array<double>"), "starts")
    w = differenced_rows(known.withColumnRenamed("y", target), target, order, station=station, ts=ts, shape=shape)
    wide = stored(_with_lags(w, order, station, ts, shape), "lagged")
    k = order.size

    def propose(batches):
        for b in batches:
            to = []
            for x, jj, je, damp in zip(b["params"], b["jj"], b["je"], b["damp"]):
                a = np.reshape(jj, (k, k))
                x = np.array(x)
                move = np.linalg.solve(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), np.array(je))
                while not stable(order, x - move):
                    move = move / 2
                to.append((x - move).tolist())
            yield pd.DataFrame({station: b[station], "params": to})

    best = stored(points.join(_normal_equations(wide, points, order, station, ts, shape, block), station).withColumn("damp", F.lit(1e-6)).withColumn("done", F.lit(False)), "steps")
    for _ in range(steps):
        if best.filter("not done").isEmpty():
            break
        tried = stored(best.filter("not done").mapInPandas(propose, f"`{station}` {kind}, params array<double>"), "tried")
        got = tried.join(_normal_equations(wide, tried, order, station, ts, shape, block), station)
        new = got.select(station, *[F.col(c).alias(f"_{c}") for c in ("params", "jj", "je", "sse", "n")])
        j = best.join(new, station, "left")
        better = F.coalesce(F.col("_sse") <= F.col("sse"), F.lit(False))
        ended = F.col("done") | (F.abs(F.col("sse") - F.col("_sse")) <= tolerance * F.col("sse")) | (F.col("damp") > 1e6)
        picked = [F.when(better, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("params", "jj", "je", "sse", "n")]
        best = stored(j.select(station, *picked, F.when(better, F.col("damp") / 10).otherwise(F.col("damp") * 100).alias("damp"), F.coalesce(ended, F.lit(True)).alias("done")), "steps")

    def finish(batches):
        for b in batches:
            rows = [{station: s, **_row(order, np.array(x), sse, n)} for s, x, sse, n in zip(b[station], b["params"], b["sse"], b["n"])]
            yield pd.DataFrame(rows, columns=[station, *[c.split()[0] for c in FITTED.split(", ")]])

    return best.select(station, "params", "sse", "n").mapInPandas(finish, f"`{station}` {kind}, {FITTED}")
