"""Forest search over the binned table against trees grown one at a time by plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wxspark.operators import binned, forest
from wxspark.operators.hashes import poisson_counts

FEATURES = ["humidity", "pressure", "wind_speed", "cloud_cover"]
BINS, SEED = 16, 42


@pytest.fixture(scope="module")
def train(full):
    # Whole labels make sums exact in any order.
    rows = full.withColumn("temperature", F.round("temperature"))
    return forest.training_frame(rows, FEATURES, ["temperature"], forest.ForestConfig()).persist()


def grown(x, y, w, number, name, levels, min_leaf, width):
    """(mean, feature, cut, left, right) by trying every place; the first best one wins."""
    n, s = w.sum(), (w * y).sum()
    best = (1e-9, None)
    for feature in binned.drawn(SEED, number, [name], x.shape[1], width)[0] if levels else ():
        for cut in range(BINS - 1):
            low = x[:, feature] <= cut
            nl, sl = w[low].sum(), (w * y)[low].sum()
            if min(nl, n - nl) < min_leaf:
                continue
            gain = nl * (n - nl) * (sl / nl - (s - sl) / (n - nl)) ** 2 / n
            if gain > best[0]:
                best = (gain, (feature, cut, low))
    if best[1] is None:
        return s / n, None
    feature, cut, low = best[1]
    sides = [grown(x[m], y[m], w[m], number, binned._child(name, i), levels - 1, min_leaf, width) for i, m in enumerate((low, ~low))]
    return s / n, (feature, cut, *sides)


def guess(node, row):
    while node[1]:
        feature, cut, left, right = node[1]
        node = left if row[feature] <= cut else right
    return node[0]


def plain_mse(rows, folds, trees, depth, min_leaf, width):
    x, y, part, k = rows
    w = poisson_counts(k, trees)
    out = []
    for fold in range(folds):
        own, later = part <= fold, part == fold + 1
        forest_ = []
        for i in range(trees):
            used = own & (w[:, i] > 0)
            forest_.append(grown(x[used], y[used], w[used, i], i, 1, depth, min_leaf, width))
        votes = np.array([[guess(t, r) for t in forest_] for r in x[later]])
        out.append(((votes.mean(axis=1) - y[later]) ** 2).mean())
    return np.mean(out)


def collected(table):
    got = table.toPandas()
    return np.frombuffer(b"".join(got.x), np.uint8).reshape(len(got), -1), got.y.to_numpy(), got.part.to_numpy(), got.k.to_numpy()


def test_search_equals_plain_trees(train):
    grid = {"trees": [2, 4], "depth": [0, 2, 5], "min_leaf": [1, 6], "subset": ["sqrt", "all"]}
    defaults = {"trees": 3, "depth": 3, "min_leaf": 1, "subset": "all"}
    table, features = binned.fold_table(train, "temperature", 2, BINS)
    rows = collected(table)
    assert features == 4 and set(rows[2]) == {0, 1, 2}
    want = {
        str({"trees": t, "depth": d, "min_leaf": m, "subset": s}): plain_mse(rows, 2, t, d, m, binned.subset_width(s, 4))
        for t in (2, 4) for d in (0, 2, 5) for m in (1, 6) for s in ("sqrt", "all")
    }
    got = binned.search(train, "temperature", grid, defaults, n_splits=2, bins=BINS).collect()
    assert {r["params"]: r["mse"] for r in got} == pytest.approx(want)
    assert [r["mse"] for r in got] == sorted(r["mse"] for r in got)
    # Histograms of any number of passes give the same trees.
    small = binned.search(train, "temperature", {"depth": [5], "min_leaf": [1]}, defaults | {"trees": 2}, n_splits=2, bins=BINS, cells=5 * 4 * BINS).collect()
    assert small[0]["mse"] == pytest.approx(plain_mse(rows, 2, 2, 5, 1, 4))


def test_folds_and_bins(train):
    table, _ = binned.fold_table(train, "temperature", 2, BINS)
    x, _, part, _ = collected(table)
    values = train.where("station = 'a'").count(), train.where("station = 'b'").count()
    assert np.bincount(part).tolist() == [sum(n // 3 for n in values)] * 3
    counts = np.array([np.bincount(c, minlength=BINS) for c in x.T])
    assert (np.abs(counts - len(x) / BINS) <= 2).all()


def test_few_bins_hold_repeated_values(spark):
    rows = spark.createDataFrame([([float(i % 3), 7.0],) for i in range(30)], "x array<double>")
    edges = binned.edges_of(rows, 2, 8)
    got = {bytes(r["x"]) for r in binned.binned(rows, edges).collect()}
    assert len(got) == 3 and len({g[1] for g in got}) == 1


def test_histograms_of_many_rows_per_node_stay_in_their_pieces(train, monkeypatch):
    monkeypatch.setattr(binned, "PIECE", 4 * BINS)  # one node per row of partial sums
    defaults = {"trees": 2, "depth": 4, "min_leaf": 1, "subset": "all"}
    table, _ = binned.fold_table(train, "temperature", 2, BINS)
    got = binned.search(train, "temperature", {"depth": [4]}, defaults, n_splits=2, bins=BINS).first()
    assert got["mse"] == pytest.approx(plain_mse(collected(table), 2, 2, 4, 1, 4))


def test_without_rows(train):
    defaults = {"trees": 2, "depth": 2, "min_leaf": 1, "subset": "all"}
    none = binned.search(train.limit(0), "temperature", {"depth": [1, 2]}, defaults, n_splits=2).collect()
    assert [r["mse"] for r in none] == [float("inf")] * 2
    # Series shorter than their parts have no folds.
    assert binned.search(train.limit(2), "temperature", {"depth": [1]}, defaults, n_splits=5).first()["mse"] == float("inf")


def test_depth_of_a_search_does_not_change_shallower_points(train):
    """The top of a deep tree is the shallow tree, the first trees of a large forest are the small one."""
    defaults = {"trees": 5, "depth": 6, "min_leaf": 2, "subset": "sqrt"}
    wide = binned.search(train, "temperature", {"trees": [2, 5], "depth": [3, 6]}, defaults, n_splits=2).collect()
    alone = binned.search(train, "temperature", {"trees": [2], "depth": [3]}, defaults, n_splits=2).first()
    assert {r["params"]: r["mse"] for r in wide}[alone["params"]] == pytest.approx(alone["mse"])
