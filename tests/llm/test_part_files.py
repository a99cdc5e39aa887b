"""Loops over small tables write few part files, also where the engine leaves small shuffle partitions as they are."""

from __future__ import annotations

import glob

import pytest

from wxspark.llm import mixing, simhash
from wxspark.llm.common import connected
from wxspark.session import shared_dir

SETTINGS = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def uncombined(spark):
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def _part_files(spark) -> set[str]:
    """Of checkpoints, too; those lie one folder deeper."""
    return set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/**/part-*", recursive=True))


def test_components_write_few_files(uncombined):
    edges = uncombined.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    before = _part_files(uncombined)
    got = {(r["node"], r["root"]) for r in connected(edges).collect()}
    assert got == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    # The first table is as wide as its shuffle, each of the steps is one file.
    assert len(_part_files(uncombined) - before) < 24 + 24


def test_mixing_writes_few_files(uncombined):
    docs = [(i, f"s{i % 3}", "word " * (1 + i % 17)) for i in range(120)]
    before = _part_files(uncombined)
    got = mixing.report(uncombined.createDataFrame(docs, "doc_id long, source string, text string")).collect()
    assert len(got) == 120
    taken = {s: sum(r["taken"] for r in got if docs[r["doc_id"]][1] == s) for s in ("s0", "s1", "s2")}
    goal = {docs[r["doc_id"]][1]: r["target"] for r in got}
    assert all(abs(taken[s] - goal[s]) < 17 for s in goal)
    # Documents, their ranks, and some twenty tables with a row or a few per source.
    assert len(_part_files(uncombined) - before) < 100


def test_near_copies_write_few_files(uncombined):
    docs = [(i, None if i == 5 else f"text {i // 2} with a few words of its own {i // 2}") for i in range(60)]
    before = _part_files(uncombined)
    kept = simhash.one_per_component(uncombined.createDataFrame(docs, "doc_id long, text string")).select("doc_id").collect()
    ids = {r["doc_id"] for r in kept}
    assert 5 in ids and 0 in ids and 1 not in ids and len(ids) >= 2
    assert len(_part_files(uncombined) - before) < 40
