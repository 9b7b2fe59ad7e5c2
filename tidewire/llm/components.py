"""Distributed connected components over an edge table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.session import discard, materialize


def min_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the edges (u, v) held in memory."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, jump := new[new]):
            new = jump
        new = new[label]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(frames):
    """Replace the edges of a partition by a star around each local component's smallest node."""
    parts = [f for f in frames if len(f)]
    if parts:
        edges = pd.concat(parts)
        node, low = min_labels(edges.u.to_numpy(), edges.v.to_numpy())
        moved = node != low
        yield pd.DataFrame({"u": node[moved], "v": low[moved]})


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node with an edge; ``component`` is its smallest reachable node.

    ``edges`` has long columns u and v. Alternates a *large-star* step (each node hands its smallest neighbour to
    its larger neighbours) and a *small-star* step, as min-aggregations, until the edges are stars. A node's
    neighbours are never gathered: each step is a grouped minimum, pre-aggregated before the shuffle, and a join.
    Local contraction before the first round makes most groups stars already. Each round's edges are written to the
    shared folder. Null ends and self-loops are ignored, repeated edges count once; no edges give no rows.
    """
    clean = edges.where("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    star = materialize(clean.mapInPandas(_contract, "u long, v long"), "edges")
    for _ in range(rounds):
        # a forest of stars: each node has one link, and no link leads to a node that has one
        count, sources = star.agg(F.count("*"), F.countDistinct("u")).first()
        if count == sources and not star.join(star.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count():
            break
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        # larger neighbours of u (large-star), then u's smaller ones and u (small-star), go to the smallest around u
        near = both.join(low, "u")
        moved = near.select(F.col("v").alias("u"), F.col("low").alias("v"))
        own = low.select("u", F.col("low").alias("v"))
        edges_now = moved.union(own).where("u <> v").distinct()
        # a node has one link at most after the steps, and no new ones appear
        before, star = star, materialize(edges_now.mapInPandas(_contract, "u long, v long").distinct(), "edges", rows=2 * count)
        discard(before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).union(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
