"""Connected components, and the dealing of groups into pairs of blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (src, dst); a component's id is its least node.

    Alternates large-star and small-star steps: each links a node's neighbours
    to the least of them, so the depth shrinks while the number of edges does
    not grow. Every round is cut off by a checkpoint in the shared folder.
    Minima are aggregated before they are shuffled. A hub's rows meet its minimum
    in a join of two shuffles of their own, which Spark splits where they are skewed:
    the key of the minima is written as an expression, so that their aggregation's
    partitioning is not taken for the join's.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    links = edges.where("src <> dst").select(F.greatest("src", "dst").alias("node"), F.least("src", "dst").alias("parent")).distinct().checkpoint()
    state = _state(links)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = links.union(links.select(F.col("parent").alias("node"), F.col("node").alias("parent")))
        least = both.groupBy("node").agg(F.min("parent").alias("m")).select(F.bitwise_not(F.bitwise_not("node")).alias("node"), F.least("node", "m").alias("m"))
        large = both.where("parent > node").join(least, "node").select(F.col("parent").alias("node"), F.col("m").alias("parent")).distinct()
        least = large.groupBy("node").agg(F.min("parent").alias("m"))
        small = large.join(least, "node").select(F.explode(F.array(F.struct("parent", "m"), F.struct(F.col("node").alias("parent"), "m"))).alias("e"))
        links = small.select(F.col("e.parent").alias("node"), F.col("e.m").alias("parent")).where("node <> parent").distinct().checkpoint()
        before, state = state, _state(links)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    # Settled links are stars around the least nodes.
    return links.select("node", F.col("parent").alias("component")).union(links.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct())


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "parent").cast("decimal(20,0)"))).first()
    return row[0], int(row[1] or 0)


def deal_blocks(members: DataFrame, id_col: str, n_col: str, block: int) -> DataFrame:
    """Deals each group's members into blocks of about ``block`` rows, and each pair of blocks to rows of its own.

    Adds ``mine`` (the row's block), ``lo`` and ``hi`` (the pair). A group of n rows
    becomes pairs of at most about 2 ``block`` rows each, so no task holds a whole
    large group, and every pair of rows meets exactly once.
    """
    blocks = F.ceil(F.col(n_col) / block).cast("int")
    with_block = members.withColumn("mine", F.pmod(F.xxhash64(F.col(id_col)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return with_block.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).drop("other")


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links (i, j): the least node of each one's component."""
    root = np.arange(n)
    while len(i):
        least = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            break
    return root
