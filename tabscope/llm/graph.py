"""Connected components of a distributed edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def local_roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of ``n`` items over the pairs (a, b); ``label`` holds earlier links."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node``, ``root``: for every node of ``edges`` (a, b long) but the roots, its component's smallest node.

    Alternates the large-star and small-star steps until the edges are stars. Both group with a minimum,
    which combines before the shuffle, so a node with many neighbours is no list in one task; the joins that
    give the minimum back are plain equi-joins that adaptive execution splits at hot keys. Each round is
    written to the shared folder. Nodes without edges are not returned.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
                      .distinct(), name)
    state = None
    while True:
        both = now.union(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = both.groupBy("node").agg(F.min("root").alias("low")).select("node", F.least("node", "low").alias("low"))
        large = (both.join(low, "node").where("root > node")
                 .select(F.col("root").alias("node"), F.col("low").alias("root")).distinct())
        least = large.groupBy("node").agg(F.min("root").alias("low"))
        small = (large.join(least, "node").where("root > low")
                 .select(F.col("root").alias("node"), F.col("low").alias("root"))
                 .union(least.select("node", F.col("low").alias("root"))).distinct())
        now = materialize(small, name)
        new = now.agg(F.count("*").alias("n"),
                      F.sum((F.xxhash64("node", "root") % 1_000_000_007).cast("decimal(38,0)")).alias("h")).first()
        if state == (new["n"], new["h"]):
            return now
        state = (new["n"], new["h"])
