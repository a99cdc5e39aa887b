"""Exact search over many blocks: what it writes, how work is dealt, and products of every width."""

from __future__ import annotations

import glob
import os

import numpy as np
import pytest

import brute
from wxspark.llm import topk
from wxspark.session import shared_dir


def _frame(spark, v: np.ndarray, parts: int, ids=None):
    rows = [(i, r) for i, r in zip(range(len(v)) if ids is None else ids, v.tolist())]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "vec_id long, v array<long>")


def _written(spark) -> dict[str, int]:
    """Bytes by file of shuffles and of the shared folder."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    out = {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle")}
    shared = glob.glob(f"{shared_dir(spark).removeprefix('file://')}/**/*", recursive=True)
    return out | {p: os.path.getsize(p) for p in shared if os.path.isfile(p)}


def _got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_disk_does_not_grow_with_pairs_of_blocks(spark):
    v = np.random.default_rng(2).integers(-60, 60, (8000, 16))
    df = _frame(spark, v, 16).persist()
    df.count()
    before = _written(spark)
    assert len(topk.top_k(df, "vec_id % 20 = 0", 5).collect()) == 400 * 5
    made = sum(n for f, n in _written(spark).items() if f not in before)
    # Vectors of four-byte components are half a megabyte; each of 256 pairs of blocks would be up to 128 kB more.
    assert made < 2 * v.size * 4, made


@pytest.mark.parametrize("few", [False, True])
def test_groups_and_runs(spark, monkeypatch, few):
    for name, value in {"BLOCK_ROWS": 7, "QUERY_ROWS": 3, "CANDIDATE_ROWS": 20, "RUN_ROWS": 40, "GROUP_ROWS": 5, "GROUPS": 4, "TASKS": 60}.items():
        monkeypatch.setattr(topk, name, value)
    rnd = np.random.default_rng(3)
    v = rnd.integers(-5, 5, (200, 6))
    v[50:90] = v[50]
    query = "vec_id = 60" if few else "vec_id % 3 = 0"
    rows = [(i, r) for i, r in enumerate(v.tolist())] + [(1000 + i, r[:4]) for i, r in enumerate(v.tolist()[:30])] + [(2001, [1]), (2004, [])]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 5), "vec_id long, v array<long>")
    assert _got(topk.top_k(df, query, 6)) == brute.top(rows, 6, lambda i: i == 60 if few else i % 3 == 0)


def test_rows_that_repeat_an_id(spark):
    v = np.array([[1, 2], [3, 1], [3, 1], [2, 2]])
    df = _frame(spark, v, 2, ids=[20, 20, 5, None])
    got = sorted((tuple(r) for r in topk.top_k(df, "vec_id % 20 = 0", 2).collect()), key=str)
    assert got == sorted([(20, 1, None, 6), (20, 2, 5, 5), (20, 1, 5, 10), (20, 2, None, 8)], key=str)


def _cases():
    rnd = np.random.default_rng(4)
    plain = rnd.integers(-40, 40, (6000, 64))
    near = np.repeat(rnd.integers(-40, 40, (60, 64)), 100, axis=0) + rnd.integers(-1, 2, (6000, 64))
    one = np.repeat(rnd.integers(-40, 40, (1, 9)), 6000, axis=0)
    mixed = plain[:, :8] * np.where(np.arange(6000) % 3 == 0, 10**6, 1)[:, None]
    return {
        "plain": plain, "near copies": near, "near copies, shuffled": rnd.permutation(near), "all the same": one, "zeros": one * 0, "one component": plain[:, :1], "no component": plain[:, :0],
        "doubles": plain[:, :20] * 30_000, "long integers": plain[:, :5] * 20_000_000 + 7, "of all sizes": mixed, "below zero": -abs(plain) - 1,
    }


@pytest.mark.parametrize("name", _cases())
def test_blocks_one_after_another(name):
    v, k = _cases()[name], 7
    rnd = np.random.default_rng(5)
    ids = rnd.permutation(len(v)) if "shuffled" in name or name == "all the same" else np.arange(len(v))
    asks = np.arange(0, len(v), 170)
    a = topk.Asking(asks // 2500, asks % 2500, ids[asks], v[asks], k)
    for block, s in enumerate(range(0, len(v), 2500)):
        order = np.argsort(ids[s : s + 2500])
        a.see(topk.Side(v[s : s + 2500][order]), ids[s : s + 2500][order], {block: np.argsort(order)})
    out = a.result().to_pydict()
    got = list(zip(out["query"], out["score"], out["vec_id"]))
    want = []
    for i in asks.tolist():
        scores = v @ v[i]
        want += [(ids[i], scores[j], ids[j]) for j in [j for j in np.lexsort((ids, -scores)).tolist() if j != i][:k]]
    assert got == want


def test_block_top_takes_candidates_in_any_order():
    rnd = np.random.default_rng(6)
    q, c, ids = rnd.integers(-9, 9, (10, 12)), rnd.integers(-9, 9, (500, 12)), rnd.permutation(500)
    own = np.array([3, -1] * 5)
    for i, at, s in topk.block_top(q, c, ids, own, 8, np.full(10, -np.inf)):
        scores = c @ q[i]
        places = [j for j in topk.best(scores, ids, 9).tolist() if j != own[i]][:8]
        assert at.tolist() == places and s.tolist() == scores[places].tolist()
