"""Personalised PageRank for many questions at once: by steps of vectors, and by diffused vectors with a local push."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scores import clamp_reset
from ..session import cut_lineage
from .columns import Columns, NumberedGraph, numbered
from .blocks import ROWS_AT_ONCE, SIZE, block_sums, matrix_of, pack, question_places, unpack, vector_batch, vectors_of

#: Edges in one list of a node (a node of many edges has many lists), and sums a task holds before it passes them on.
LIST_SIZE, SUMS_HELD = 64, 65_536


def _sums(ids, blocks: np.ndarray, values: np.ndarray):
    """Each (id, block) once, in the order of the ids' first rows, with the sum of its rows."""
    import pyarrow as pa

    keys = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64) * (int(blocks.max()) + 1) + blocks
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.diff(keys[order], prepend=-1))
    first = order[starts]
    return ids.take(pa.array(first)), blocks[first], np.add.reduceat(values[order], starts, axis=0)


def _together(parts: list):
    import pyarrow as pa

    return pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])


def _spread(batches):
    """Vectors times the weights of their nodes' edges, summed by receiving node as far as a task can hold the sums."""
    held: list = []
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(start, ROWS_AT_ONCE)
            to, weight = part.column("dst"), part.column("p").flatten().to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(part.num_rows), to.value_lengths().to_numpy(zero_copy_only=False))
            blocks = part.column("block").to_numpy(zero_copy_only=False)
            held.append(_sums(to.flatten(), blocks[at], matrix_of(part.column("v"))[at] * weight[:, None]))
            if sum(len(h[1]) for h in held) > 2 * SUMS_HELD:
                held = [_sums(*_together(held))]
                if len(held[0][1]) > SUMS_HELD:
                    yield vector_batch(*held.pop())
    if held:
        yield vector_batch(*_sums(*_together(held)))


def _total(batches):
    """Sums of rows that come ordered by (id, block); only the last key is open from one batch to the next."""
    last: list = []
    for batch in batches:
        if batch.num_rows:
            rows = (batch.column("id"), batch.column("block").to_numpy(zero_copy_only=False), matrix_of(batch.column("v")))
            ids, blocks, values = _sums(*_together([*last, rows]))
            n = len(blocks) - 1
            if n:
                yield vector_batch(ids.slice(0, n), blocks[:n], values[:n])
            last = [(ids.slice(n), blocks[n:], values[n:])]
    if last:
        yield vector_batch(*last[0])


def edge_shares(edges: DataFrame) -> DataFrame:
    """(src, dst, p): both directions of every edge with its share of the source's weight; p sums to 1 over a source."""
    ways = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    both = cut_lineage(edges.where("weight > 0").select(ways.alias("e"), "weight").select("e.*", "weight"))
    strength = both.groupBy("src").agg(F.sum("weight").alias("strength"))
    return both.join(strength, "src").groupBy("src", "dst").agg((F.sum("weight") / F.first("strength")).alias("p"))


def edge_lists(shares: DataFrame, factor: float) -> DataFrame:
    """(src, part, dst, p): the edges of a node in lists of about LIST_SIZE, their shares times ``factor``."""
    lists = shares.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / LIST_SIZE).alias("lists"))
    parts = shares.join(lists, "src").groupBy("src", F.pmod(F.xxhash64("dst"), F.col("lists")).alias("part"), "lists").agg(F.collect_list(F.struct("dst", (F.col("p") * factor).alias("p"))).alias("to"))
    return cut_lineage(parts.select("src", "part", "lists", F.col("to.dst").alias("dst"), F.col("to.p").alias("p")))


#: Lists of one node that a vector meets in one join key; a node of more has as many keys as it needs.
LISTS_A_KEY = 16


def _steps(rows: DataFrame, out: DataFrame, restart: Callable[[int], DataFrame], steps: int, cut_every: int) -> DataFrame:
    """state = restart(k) + (state times edges), ``steps`` times.

    A hub's lists are dealt to several join keys, and its vector is sent to each of them, so no key holds all of them.
    """
    keyed = out.withColumn("key", F.floor(F.col("part") / LISTS_A_KEY).cast("int"))
    keys = cut_lineage(out.select("src", F.ceil(F.col("lists") / LISTS_A_KEY).cast("int").alias("keys")).where("keys > 1").distinct())
    hubs = keys.count()
    state = restart(0)
    for k in range(1, steps + 1):
        told = state.select(F.col("id").alias("src"), "block", "v")
        if hubs:
            told = told.join(keys, "src", "left").select("src", "block", "v", F.explode(F.sequence(F.lit(0), F.coalesce("keys", F.lit(1)) - 1)).alias("key"))
        else:
            told = told.withColumn("key", F.lit(0))
        sent = told.join(keyed, ["src", "key"]).select("block", "v", "dst", "p").mapInArrow(_spread, rows.schema)
        state = sent.unionByName(restart(k)).repartition("id", "block").sortWithinPartitions("id", "block").mapInArrow(_total, rows.schema)
        if k % cut_every == 0 or k == steps:
            state = cut_lineage(state)
    return state


def pagerank_blocks(restarts: DataFrame, edges: DataFrame, damping: float = 0.5, steps: int = 30, cut_every: int = 6, wanted: DataFrame | None = None) -> DataFrame:
    """(id, block, v): scores of the undirected weighted graph with restarts in proportion to clamped weights (id, block, v).

    With ``wanted`` (id) only those nodes' scores. A graph whose edges a task can hold goes by columns (``columns``).
    Rows of one node and block add up. Nodes without edges give their mass back to the
    restart: they receive from the restart alone, so what they give back follows from
    their share R of it: before step k their mass is R c_k-1 with c_0 = 1 and
    c_k = 1 - d + d R c_k-1, which has a closed form. What comes to the driver are two
    numbers a question.
    """

    def clamp(batches):
        for batch in batches:
            if batch.num_rows:
                values = matrix_of(batch.column("v"))
                yield vector_batch(batch.column("id"), batch.column("block").to_numpy(zero_copy_only=False), np.where(values > 0, values, 0.0))

    rows = cut_lineage(restarts.mapInArrow(clamp, restarts.schema))
    edges = cut_lineage(edges)
    graph = numbered(edges, rows.select("id"))
    if graph is not None:
        scores = _pagerank_columns(rows, graph, damping, steps, wanted)
        return scores if wanted is None else scores.join(wanted.select("id"), "id", "left_semi")
    out = edge_lists(edge_shares(edges), damping)
    linked = rows.join(out.select(F.col("src").alias("id"), F.lit(True).alias("linked")).distinct(), "id", "left")
    known = block_sums(linked.select("block", "v", F.coalesce("linked", F.lit(False)).alias("linked")))
    shared = rows.sparkSession.sparkContext.broadcast({b: (np.where(t > 0, t, 1.0), a / np.where(t > 0, t, 1.0) * damping) for b, (t, a) in known.items()})

    def restart(k: int) -> DataFrame:
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    blocks = batch.column("block").to_numpy(zero_copy_only=False)
                    values = np.array(matrix_of(batch.column("v")))
                    for b in np.unique(blocks).tolist():
                        total, dr = shared.value[b]
                        power = dr**k
                        values[blocks == b] *= ((1 - damping) * (1 - power) / (1 - dr) + power) / total
                    yield vector_batch(batch.column("id"), blocks, values)

        return rows.mapInArrow(run, rows.schema)

    scores = _steps(rows, out, restart, steps, cut_every)
    return scores if wanted is None else scores.join(wanted.select("id"), "id", "left_semi")


def ends_of(graph: NumberedGraph, wanted: DataFrame | None) -> tuple[int, int]:
    """Least and largest number of the wanted nodes."""
    if wanted is None:
        return 0, graph.size - 1
    low, high = graph.nodes.join(wanted.select("id"), "id", "left_semi").agg(F.min("n"), F.max("n")).first()
    return (0, -1) if low is None else (low, high)


def _pagerank_columns(rows: DataFrame, graph: NumberedGraph, damping: float, steps: int, wanted: DataFrame | None) -> DataFrame:
    first = rows.select("block", F.length("v").alias("size")).agg(F.max("block"), F.max("size")).first()
    if first[0] is None:
        return rows

    def way(x, send, own):
        for v in x:
            total = v.sum()
            if total <= 0:
                continue
            r = v / total
            state = r
            for _ in range(steps):  # what nodes without edges hold goes back to the restart
                moved = damping * send(state)
                state = moved + r * (1.0 - moved.sum())
            v[:] = state
        return x, np.zeros(len(x))

    return Columns(rows, graph, first[1] // 8, first[0] + 1).solve(way, *ends_of(graph, wanted))[0]


def personalized_pagerank(resets: DataFrame, edges: DataFrame, damping: float = 0.5, steps: int = 30, block: int = SIZE, cut_every: int = 6) -> DataFrame:
    """(qid, id, score): scores of the undirected weighted graph with restarts in proportion to clamped reset weights.

    ``resets`` has qid, id and weight; ids are nodes. The error is at most 2 damping^steps.
    Questions whose reset is all zero have no rows; callers fall back to the dense ranking.

    A node's scores for ``block`` questions are one vector, so a step is one join
    of nodes with lists of their edges and one weighted vector sum, combined
    before it is shuffled, whatever the number of questions in a block.
    """
    clamped = cut_lineage(resets.select("qid", "id", clamp_reset(F.col("weight")).alias("weight")).where("weight > 0"))
    places = cut_lineage(question_places(clamped.select("qid").distinct(), block))
    return unpack(pagerank_blocks(pack(clamped, places, block), edges, damping, steps, cut_every), places)


def rank_passages(scores: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """The ``k`` passages of highest score per question."""
    of_passages = scores.join(passages.select(F.col("passage_id").alias("id")), "id", "left_semi")
    ranked = W.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id")
    return of_passages.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("qid", F.col("id").alias("passage_id"), "score", "rank")


def push_columns(residuals: DataFrame, graph: NumberedGraph, limits: np.ndarray, width: int, damping: float, rounds: int, wanted: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """As ``push``, by columns: (mass of the ``wanted`` nodes as rows (id, block, v), what is left of each column), from residuals (id, block, v) and a limit a column."""
    shared = residuals.sparkSession.sparkContext.broadcast(limits)

    def way(x, send, own):
        left = np.zeros(len(x))
        for j, (v, eps) in enumerate(zip(x, shared.value[own], strict=True)):
            r, mass = v.copy(), np.zeros(len(v))
            for _ in range(rounds):
                front = r > eps
                if not front.any():
                    break
                sent = np.where(front, r, 0.0)
                mass += sent
                r = np.where(front, 0.0, r) + damping * send(sent)
            v[:], left[j] = mass + r, r.sum()
        return x, left

    return Columns(residuals, graph, width, -(-len(limits) // width)).solve(way, *ends_of(graph, wanted))


def diffuse_columns(vectors: DataFrame, graph: NumberedGraph, damping: float, steps: int) -> DataFrame:
    """As ``diffuse``, by columns, for the nodes of ``vectors``."""
    size = vectors.agg(F.max(F.length("v"))).first()[0]
    if size is None:
        return vectors

    def way(x, send, own):
        for v in x:
            state = v
            for _ in range(steps):
                state = v + damping * send(state)
            v[:] = state
        return x, np.zeros(len(x))

    rows = vectors.select("id", F.lit(0).cast("long").alias("block"), "v")
    return Columns(rows, graph, size // 8, 1).solve(way, *ends_of(graph, vectors))[0].select("id", "v")


def diffuse(vectors: DataFrame, lists: DataFrame, steps: int, cut_every: int = 6) -> DataFrame:
    """(id, v): sum over k <= ``steps`` of damping^k M^k x, for vectors (id, v) of one length; ``lists`` as of ``edge_lists``."""
    rows = vectors.select("id", F.lit(0).cast("long").alias("block"), "v")
    return _steps(rows, lists, lambda k: rows, steps, cut_every).select("id", "v")


def push(residuals: DataFrame, shares: DataFrame, limits: DataFrame, damping: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(mass, left) of residuals (qid, id, r >= 0): what came to each node, and what is left of each question.

    A round sends on the residual of every (question, node) over the question's ``eps``
    (``limits``: qid, eps): it is added to the node's mass, and damping times its share
    goes along each edge. What stays below, or is left after the last round, is added to
    its own node's mass and goes no further, so the mass that is missing is nowhere
    negative and sums to at most left * damping / (1 - damping).
    """
    state = residuals.join(limits, "qid").select("qid", "id", "r", F.lit(0.0).alias("mass"), "eps")
    for k in range(1, rounds + 1):
        front = F.col("r") > F.col("eps")
        sent = state.where(front).join(shares, state["id"] == shares["src"]).select("qid", F.col("dst").alias("id"), (F.col("r") * F.col("p") * damping).alias("r"), F.lit(0.0).alias("mass"), "eps")
        kept = state.select("qid", "id", F.when(front, 0.0).otherwise(F.col("r")).alias("r"), (F.col("mass") + F.when(front, F.col("r")).otherwise(0.0)).alias("mass"), "eps")
        state = sent.unionByName(kept).groupBy("qid", "id").agg(F.sum("r").alias("r"), F.sum("mass").alias("mass"), F.first("eps").alias("eps"))
        state = cut_lineage(state)
        if k < rounds and state.where(F.col("r") > F.col("eps")).isEmpty():
            break
    return state.select("qid", "id", (F.col("mass") + F.col("r")).alias("mass")).where("mass > 0"), state.groupBy("qid").agg(F.sum("r").alias("left"))
