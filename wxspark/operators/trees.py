"""Forests as tables of nodes: saved and read like any other table, scored by one vectorised walk over all trees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wxspark.operators.intervals import int_samples
from wxspark.schema import STATION, TS
from wxspark.session import scratch

NODES = "target string, tree int, node int, feature int, threshold double, left int, right int, prediction double"


def node_table(models: dict[str, RandomForestRegressionModel], spark: SparkSession) -> DataFrame:
    """One row per node of every tree of every target's forest; ``feature`` is -1 in leaves. Splits are on numbers only."""
    out = None
    for target, model in models.items():
        path = scratch(spark, "forest")
        model.write().overwrite().save(path)
        n = F.col("nodeData")
        part = spark.read.parquet(f"{path}/data").select(
            F.lit(target).alias("target"), F.col("treeID").alias("tree"), n["id"].alias("node"), n["split"]["featureIndex"].alias("feature"),
            F.try_element_at(n["split"]["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold"),
            n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["prediction"].alias("prediction"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class Forest:
    """All trees of one forest in flat arrays; the nodes of a tree follow each other, children are places in the arrays."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    prediction: np.ndarray

    @classmethod
    def of(cls, nodes: pd.DataFrame) -> Forest:
        nodes = nodes.sort_values(["tree", "node"])
        tree = nodes["tree"].to_numpy()
        starts = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if len(tree) else np.empty(0, int)
        base = np.repeat(starts, np.diff(np.r_[starts, len(tree)]))
        leaf = nodes["feature"].to_numpy() < 0
        child = lambda c: np.where(leaf, np.arange(len(tree)), base + nodes[c].to_numpy())
        return cls(
            starts, np.where(leaf, 0, nodes["feature"].to_numpy()), np.where(leaf, np.inf, nodes["threshold"].to_numpy(float)),
            child("left"), child("right"), nodes["prediction"].to_numpy(float),
        )

    def votes(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        """Prediction of every tree for every row. All trees go down one level per step; leaves stay where they are."""
        out = np.empty((len(x), len(self.roots)))
        for s in range(0, len(x), rows):
            part = x[s : s + rows]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            while True:
                goes_left = np.take_along_axis(part, self.feature[at], 1) <= self.threshold[at]
                to = np.where(goes_left, self.left[at], self.right[at])
                if (to == at).all():
                    break
                at = to
            out[s : s + rows] = self.prediction[at]
        return out


def forests(nodes: DataFrame) -> dict[str, Forest]:
    """Forests by target, on the driver: as many rows as the fitted forests have nodes, which the driver grew itself."""
    return {t: Forest.of(part) for t, part in nodes.toPandas().groupby("target")}


def tree_votes(rows: DataFrame, nodes: DataFrame, *, features: str = "features", station=STATION, ts=TS) -> DataFrame:
    """station, ts, target, samples: the votes of all trees, for all targets in one stage and without a shuffle."""
    made = rows.sparkSession.sparkContext.broadcast(forests(nodes))

    @F.pandas_udf("array<struct<target: string, samples: array<double>>>")
    def walk(x: pd.Series) -> pd.Series:
        m = np.array(x.tolist(), float).reshape(len(x), -1)
        votes = {t: f.votes(m).tolist() for t, f in made.value.items()}
        return pd.Series([[{"target": t, "samples": v[i]} for t, v in votes.items()] for i in range(len(m))])

    return rows.select(station, ts, F.inline(walk(vector_to_array(features))))


def tree_spread(rows: DataFrame, nodes: DataFrame, *, features: str = "features", station=STATION, ts=TS) -> DataFrame:
    """Mean of the trees and +- 1.96 population deviations, per target, for any number of trees."""
    return int_samples(tree_votes(rows, nodes, features=features, station=station, ts=ts)).drop("samples")
