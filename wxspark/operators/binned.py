"""Search over forests on one binned table.

Every value becomes the one-byte number of its quantile bin, once. Trees grow level by level from histograms over bins, all grid
points, folds and trees together: a level is one pass over the rows, or a few where its histograms exceed CELLS. Two kinds of grid
points cost nothing more: the forest of 50 trees is the first 50 of the 200, and a tree of 10 levels is the top of one of 30. So trees
grow once for each (min_leaf, subset) and fold, and each node keeps the mean that it predicts where a shallower tree ends.

Bootstrap counts and the features of a node follow from hashes of row keys and node numbers, so a task that runs again does the
same. The driver holds the trees, as Spark ML does; tasks get the trees of their pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wxspark.operators import timeline
from wxspark.operators.hashes import mixed, poisson_counts
from wxspark.operators.timeline import COUNT, POS, Shape
from wxspark.schema import STATION, TS
from wxspark.session import stored

#: Bins of a feature, at most 256.
BINS = 64
#: Histogram cells of one pass (16 bytes each in every task), and of one row of partial sums.
CELLS, PIECE = 4_000_000, 16_384
#: Nodes of the trees that one scoring pass sends out.
SENT = 2_000_000


@dataclass
class Tree:
    """A tree that is growing. Node 0 is the root; the children of a node follow each other from ``left``, 0 in leaves."""

    fold: int
    number: int
    min_leaf: int
    width: int
    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    mean: list[float] = field(default_factory=lambda: [float("nan")])
    name: list[int] = field(default_factory=lambda: [1])

    def split(self, node: int, feature: int, cut: int, left_mean: float, right_mean: float) -> tuple[int, int]:
        at = len(self.left)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, at
        for i, m in enumerate((left_mean, right_mean)):
            self.feature.append(0), self.cut.append(0), self.left.append(0), self.mean.append(m)
            self.name.append(_child(self.name[node], i))
        return at, at + 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.mean)


def _child(name: int, side: int) -> int:
    """Numbers of nodes for drawing features; they mix instead of doubling, so no depth is too deep."""
    return (name * 6364136223846793005 + 1442695040888963407 + side) % 2**64


def drawn(seed: int, tree: int, names: Sequence[int], features: int, width: int) -> np.ndarray:
    """The features each node may split on, in the order in which equal gains are decided: one row per node."""
    keys = np.array(names, np.uint64)[:, None] + mixed(np.array([seed * 1_000_003 + tree], np.uint64))
    order = mixed(mixed(keys) + np.arange(1, features + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return order.argsort(axis=1, kind="stable")[:, :width]


def subset_width(subset: str, features: int) -> int:
    widths = {"all": features, "sqrt": np.ceil(np.sqrt(features)), "log2": np.ceil(np.log2(features))}
    return max(1, int(widths[subset]))


def _walk(arrays: tuple[np.ndarray, ...], x: np.ndarray) -> Iterator[np.ndarray]:
    """The node of every row at level 0, 1, ... until all rows are in leaves; rows in leaves stay."""
    feature, cut, left, _ = arrays
    at = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    while True:
        yield at
        to = left[at]
        if not to.any():
            return
        at = np.where(to > 0, to + (x[rows, feature[at]] > cut[at]), at)


def edges_of(rows: DataFrame, features: int, bins: int = BINS) -> np.ndarray:
    """Upper edges of all bins but the last, one row per feature, from one aggregate of mergeable sketches."""
    at = [i / bins for i in range(1, bins)]
    got = rows.agg(*[F.percentile_approx(F.get("x", F.lit(i)), at, 10_000).alias(f"e{i}") for i in range(features)]).first()
    return np.array([e if e is not None else [np.inf] * (bins - 1) for e in got])


def binned(rows: DataFrame, edges: np.ndarray) -> DataFrame:
    """``rows`` whose array x became one byte per feature: the number of edges below the value."""

    @F.pandas_udf("binary")
    def place(x: pd.Series) -> pd.Series:
        m = np.array(x.tolist(), float).reshape(len(x), len(edges))
        out = np.column_stack([np.searchsorted(e, m[:, i], side="left") for i, e in enumerate(edges)]).astype(np.uint8)
        return pd.Series([r.tobytes() for r in out])

    return rows.withColumn("x", place("x"))


def best_splits(h: np.ndarray, least: int):
    """Per node of a histogram (node, feature, bin, (count, sum)): totals, best place (-1: none) in feature-major order, and what lies left of it.

    A split must leave ``least`` counted rows on both sides and lower the squared error by more than rounding does.
    """
    total = h[:, 0].sum(axis=1)
    low = np.cumsum(h, axis=2)[:, :, :-1]
    nl, sl = low[..., 0], low[..., 1]
    n, s = total[:, None, None, 0], total[:, None, None, 1]
    nr, sr = n - nl, s - sl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = nl * nr * (sl / nl - sr / nr) ** 2 / n
    gain = np.where((nl >= max(least, 1)) & (nr >= max(least, 1)), gain, 0.0).reshape(len(h), -1)
    where = gain.argmax(axis=1)
    rows = np.arange(len(h))
    where = np.where(gain[rows, where] > 1e-9, where, -1)
    return total, where, low.reshape(len(h), -1, 2)[rows, where]


def _pass(table: DataFrame, trees: list[Tree], chunk: list[tuple[int, list[int]]], features: int, bins: int, seed: int) -> list:
    """One pass over the rows: the best split of every node of ``chunk`` (tree, its nodes)."""
    plan = []
    for t, nodes in chunk:
        tree = trees[t]
        slot = np.full(len(tree.left), -1)
        slot[nodes] = np.arange(len(nodes))
        plan.append((t, tree.fold, tree.number, tree.arrays(), slot, drawn(seed, tree.number, [tree.name[n] for n in nodes], features, tree.width)))
    sent = table.sparkSession.sparkContext.broadcast(plan)
    most = 1 + max(p[2] for p in plan)
    least = {t: trees[t].min_leaf for t, _ in chunk}

    def per_piece(width: int) -> int:
        return max(1, PIECE // (width * bins))

    def add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for f in frames:
            if not len(f):
                continue
            x = np.frombuffer(b"".join(f["x"]), np.uint8).reshape(len(f), -1)
            y, part = f["y"].to_numpy(float), f["part"].to_numpy()
            counts = poisson_counts(f["k"].to_numpy(), most).astype(np.uint8)
            for t, fold, number, arrays, slot, feats in sent.value:
                rows = np.flatnonzero((part <= fold) & (counts[:, number] > 0))
                for at in _walk(arrays, x[rows]):
                    pass
                here = slot[at]
                rows, here = rows[here >= 0], here[here >= 0]
                width = feats.shape[1]
                cell = (here[:, None] * width + np.arange(width)) * bins + np.take_along_axis(x[rows], feats[here], 1)
                w = np.repeat(counts[rows, number].astype(float), width)
                size = feats.size * bins
                both = [np.bincount(cell.ravel(), v, size) for v in (w, w * np.repeat(y[rows], width))]
                h = np.stack(both, axis=-1).reshape(len(feats), width, bins, 2)
                sums[t] = sums[t] + h if t in sums else h
        for t, h in sums.items():
            step = per_piece(h.shape[1])
            # Deep nodes hold few rows: cells without any are left out.
            h, span = h.reshape(-1, 2), step * h[0, ..., 0].size
            cells = np.flatnonzero(h[:, 0])
            ends = np.searchsorted(cells, np.arange(0, len(h) + span, span))
            used = [(i, cells[a:b]) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
            yield pd.DataFrame({
                "tree": t, "piece": [i for i, _ in used], "cell": [(c - i * span).astype(np.int32).tobytes() for i, c in used],
                "h": [h[c].tobytes() for _, c in used],
            })

    def choose(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        t, piece = key
        feats = next(p[5] for p in sent.value if p[0] == t)
        step = per_piece(feats.shape[1])
        nodes = min(step, len(feats) - piece * step)
        h = np.zeros((nodes * feats.shape[1] * bins, 2))
        for cell, part in zip(f["cell"], f["h"]):
            h[np.frombuffer(cell, np.int32)] += np.frombuffer(part).reshape(-1, 2)
        h = h.reshape(nodes, feats.shape[1], bins, 2)
        total, where, low = best_splits(h, least[t])
        place = np.arange(len(h)) + piece * step
        chosen = feats[place, np.maximum(where, 0) // (bins - 1)]
        return pd.DataFrame({
            "tree": t, "place": place, "n": total[:, 0], "s": total[:, 1], "feature": np.where(where < 0, -1, chosen),
            "cut": np.maximum(where, 0) % (bins - 1), "nl": low[:, 0], "sl": low[:, 1],
        })

    partial = table.mapInPandas(add_up, "tree int, piece int, cell binary, h binary")
    out = "tree int, place int, n double, s double, feature int, cut int, nl double, sl double"
    found = partial.groupBy("tree", "piece").applyInPandas(choose, out).collect()
    sent.destroy()
    return found


def grow(table: DataFrame, trees: list[Tree], features: int, depth: int, *, bins: int = BINS, seed: int = 42, cells: int = CELLS) -> int:
    """Grow ``trees`` to ``depth`` levels below their roots from ``table`` (x, y, part, k); returns the number of passes.

    A row trains the folds from its part on.
    """
    active = [(t, [0]) for t in range(len(trees))]
    passes = 0
    for level in range(max(depth, 1)):
        following: dict[int, list[int]] = {}
        for chunk in _chunks(active, lambda t: trees[t].width * bins, cells):
            nodes = dict(chunk)
            passes += 1
            for r in sorted(_pass(table, trees, chunk, features, bins, seed), key=lambda r: (r["tree"], r["place"])):
                tree, node = trees[r["tree"]], nodes[r["tree"]][r["place"]]
                if node == 0 and r["n"]:
                    tree.mean[0] = r["s"] / r["n"]
                if r["feature"] >= 0 and level < depth:
                    nr = r["n"] - r["nl"]
                    made = tree.split(node, r["feature"], r["cut"], r["sl"] / r["nl"], (r["s"] - r["sl"]) / nr)
                    following.setdefault(r["tree"], []).extend(made)
        active = list(following.items())
        if not active:
            break
    return passes


def _chunks(active, cost, cells: int):
    """``active`` (tree, nodes) in runs of at most ``cells`` histogram cells, one node at least; a tree's nodes may be in several."""
    chunk, room = [], cells
    for t, nodes in active:
        at = 0
        while at < len(nodes):
            fit = room // cost(t)
            if not fit and chunk:
                yield chunk
                chunk, room = [], cells
                continue
            part = nodes[at : at + max(1, fit)]
            chunk.append((t, part))
            room -= len(part) * cost(t)
            at += len(part)
            if at < len(nodes):
                yield chunk
                chunk, room = [], cells
    if chunk:
        yield chunk


def errors(table: DataFrame, trees: list[Tree], depths: Sequence[int], counts: Sequence[int]) -> list[tuple[int, int, int, float, int]]:
    """(fold, depth, trees, sum of squared errors, rows) of one forest per fold on the rows after the fold's own."""
    depths, counts = sorted(set(depths)), set(counts)
    plan: dict[int, list] = {}
    for tree in sorted(trees, key=lambda t: (t.fold, t.number)):
        plan.setdefault(tree.fold, []).append(tree.arrays())
    out = []
    for folds in _chunks([(f, [f]) for f in plan], lambda f: sum(len(a[0]) for a in plan[f]), SENT):
        sent = table.sparkSession.sparkContext.broadcast({f: plan[f] for f, _ in folds})

        def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[tuple, list] = {}
            for f in frames:
                for fold, forest in sent.value.items():
                    own = f[f["part"] == fold + 1]
                    if not len(own):
                        continue
                    x, y = np.frombuffer(b"".join(own["x"]), np.uint8).reshape(len(own), -1), own["y"].to_numpy(float)
                    votes = np.zeros((len(depths), len(own)))
                    for number, arrays in enumerate(forest, 1):
                        levels = list(_walk(arrays, x))
                        votes += [arrays[3][levels[min(d, len(levels) - 1)]] for d in depths]
                        if number in counts:
                            for d, v in zip(depths, votes):
                                at = sums.setdefault((fold, d, number), [0.0, 0])
                                at[0] += float(((v / number - y) ** 2).sum())
                                at[1] += len(own)
            yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["fold", "depth", "trees", "sse", "n"])

        scored = table.mapInPandas(score, "fold int, depth int, trees int, sse double, n long")
        summed = scored.groupBy("fold", "depth", "trees").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n"))
        out += [tuple(r) for r in summed.collect()]  # one row per fold and grid point
        sent.destroy()
    return out


def fold_table(train: DataFrame, target: str, n_splits: int, bins: int, *, station=STATION, ts=TS, shape: Shape | None = None) -> tuple[DataFrame, int]:
    """(x, y, part, k) once per row: bins of its features, its label, which part of its series it is in and a hash of its key.

    Part i validates fold i - 1 and trains the folds from i on; rows after the last part are left out, as in win_cv_folds.
    """
    placed = timeline.with_position(train, station=station, ts=ts, shape=shape)
    size = F.floor(F.col(COUNT) / (n_splits + 1))
    part = F.when(size > 0, F.floor(F.col(POS) / size)).cast("int")
    rows = placed.select(
        vector_to_array("features").alias("x"), F.col(f"label_{target}").cast("double").alias("y"), part.alias("part"), F.xxhash64(station, ts).alias("k"),
    ).where(F.col("part") <= n_splits).dropna()
    rows = stored(rows, "folds")
    first = rows.first()
    if first is None:
        return rows, 0
    features = len(first["x"])
    made = binned(rows, edges_of(rows, features, bins))
    # Every level is a pass over these rows, so few of them are spread over all cores too.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return stored(made.repartition(cores) if rows.rdd.getNumPartitions() < cores else made, "binned"), features


def search(
    train: DataFrame, target: str, grid: dict[str, list], defaults: dict, *, n_splits: int = 3, bins: int = BINS, seed: int = 42, cells: int = CELLS,
    station=STATION, ts=TS, shape: Shape | None = None,
) -> DataFrame:
    """params, mse of each grid point over expanding folds, best first; infinite where no fold has rows to train and to validate on.

    Bin edges come from the features of all rows, labels are seen by fold.
    """
    table, features = fold_table(train, target, n_splits, bins, station=station, ts=ts, shape=shape)
    full = {k: grid.get(k, [v]) for k, v in defaults.items()}
    mse: dict[tuple, list[float]] = {}
    if features:
        # Subsets of equal width are one forest.
        kinds = dict.fromkeys(product(full["min_leaf"], [subset_width(s, features) for s in full["subset"]]))
        forests = {kind: [Tree(f, i, *kind) for f in range(n_splits) for i in range(max(full["trees"]))] for kind in kinds}
        grow(table, [t for forest in forests.values() for t in forest], features, max(full["depth"]), bins=bins, seed=seed, cells=cells)
        for kind, forest in forests.items():
            for _, depth, trees, sse, n in errors(table, forest, full["depth"], full["trees"]):
                if not np.isnan(sse):
                    mse.setdefault((*kind, depth, trees), []).append(sse / n)
    rows = []
    for values in product(*grid.values()):
        point = dict(zip(grid, values))
        whole = defaults | point
        known = mse.get((whole["min_leaf"], subset_width(whole["subset"], max(features, 1)), whole["depth"], whole["trees"]), [])
        rows.append((str(point), sum(known) / len(known) if known else float("inf")))
    return train.sparkSession.createDataFrame(rows, "params string, mse double").orderBy("mse", "params")
