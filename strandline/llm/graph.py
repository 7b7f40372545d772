"""Connected components of a large edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.hot import spread_join
from strandline.llm.store import discard, written

MAX_ROUNDS = 60


def _lead(edges: DataFrame, total: int) -> DataFrame:
    """Adds the least neighbour m of u (itself included). The minimum is combined before the shuffle, and hubs are split in the join."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
    return spread_join(edges, least, ["u"], "c", total).drop("c")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge, component being the least node reachable.

    edges: (u, v) of any comparable type; order, repetition and loops do not matter. Each round is written to the shared
    folder and the one before deleted, so lineage stays short and nothing is collected but three numbers a round.
    """
    both = edges.where("u <> v").select("u", "v")
    now = written(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(now)
    for _ in range(MAX_ROUNDS):
        two_way = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lead(two_way, 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        led = _lead(large, 2 * before[0])  # every row has v < u here
        small = led.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(led.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, now = now, written(small, "edges")
        discard(last)
        state = _state(now)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.xxhash64("v", "u") % 998244353)).first())


def small_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable index of each of n nodes, for a graph that is in memory."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label
