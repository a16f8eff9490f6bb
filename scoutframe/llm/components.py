"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutframe.session import cut_lineage


def star_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``labels`` (each node's representative, itself at first) after joining the ends of every edge."""
    while len(a):
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            break
        la, lb = la[open_], lb[open_]
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(mixed), F.bit_xor(F.xxhash64(mixed))).first())


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long) but the roots, the smallest of each component.

    Minima are pre-aggregated, so a node with very many edges costs no task more than its share; only a count
    and a checksum reach the driver.  Every round is written to the shared folder.
    """
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(e)
    for _ in range(most_rounds):
        if not before[0]:
            break
        # large star: every larger neighbour is tied to the node's smallest neighbour (or to the node)
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the smaller neighbours and the node itself are tied to the smallest of them
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        tied = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = cut_lineage(tied.union(low.select("a", F.col("m").alias("b"))).distinct())
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
