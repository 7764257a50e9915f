"""Scores as columns: one row holds the numbers of a few questions (or dimensions) for every node of a graph.

Columns of a graph do not depend on each other. Where all edges fit into a task
(``EDGES_HELD``), a task takes a few columns through all their steps: no score is
shuffled from node to node. Larger graphs go by ``pagerank._steps``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import matrix_of, vector_batch, vectors_of
from .keys import dense_index

#: Edges (16 bytes each) that a task holds, and that are in one row; columns in one row, and numbers in it; nodes in one row of results.
EDGES_HELD, EDGES_AT_ONCE, COLUMNS, NUMBERS, NODES_AT_ONCE = 1 << 24, 1 << 21, 8, 1 << 23, 1 << 12


@dataclass
class NumberedGraph:
    """``nodes`` (id, n, linked), numbered in ascending order of ids, and ``edges`` (a, b, w) in a few rows of many edges."""

    nodes: DataFrame
    edges: DataFrame
    size: int


def numbered(edges: DataFrame, more: DataFrame) -> NumberedGraph | None:
    """The graph of ``edges`` (src, dst, weight) and of ``more`` ids; None where it has more edges than a task holds."""
    held = cut_lineage(edges.where("weight > 0").select("src", "dst", "weight"))
    if held.count() > EDGES_HELD:
        return None
    ends = held.select(F.explode(F.array("src", "dst")).alias("id"), F.lit(True).alias("linked"))
    known = cut_lineage(ends.unionByName(more.select("id", F.lit(False).alias("linked"))).where("id IS NOT NULL").groupBy("id").agg(F.max("linked").alias("linked")))
    nodes = cut_lineage(known.join(dense_index(known, "id", "n"), "id").select("id", F.col("n").cast("int").alias("n"), "linked"))
    size = nodes.count()
    a, b = (nodes.select(F.col("id").alias(c), F.col("n").alias(to)) for c, to in (("src", "a"), ("dst", "b")))

    def run(batches):
        import pyarrow as pa

        parts: list = []

        def packed():
            whole = pa.Table.from_batches(parts)
            return pa.RecordBatch.from_arrays([pa.array([whole.column(c).to_numpy().astype(kind).tobytes()], pa.binary()) for c, kind in (("a", "<i4"), ("b", "<i4"), ("weight", "<f8"))], names=["a", "b", "w"])

        for batch in batches:
            parts.append(batch)
            if sum(p.num_rows for p in parts) >= EDGES_AT_ONCE:
                yield packed()
                parts = []
        if parts:
            yield packed()

    rows = held.join(a, "src").select("a", "dst", "weight").join(b, "dst").select("a", "b", "weight")
    few = rows.coalesce(max(1, edges.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, "a binary, b binary, w binary")
    none = edges.sparkSession.createDataFrame([(b"", b"", b"")], "a binary, b binary, w binary")  # so that a graph without edges keeps its columns
    return NumberedGraph(nodes, cut_lineage(few.union(none)).coalesce(1), size)


def _even_keys(spark: SparkSession, n: int) -> list[int]:
    """A key for each of ``n`` groups, so that each group has a partition of its own."""
    found: dict[int, int] = {}
    for r in spark.range(40 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).collect():
        found.setdefault(r.p, r.id)
    spare = iter(range(40 * n, 42 * n))
    return [found[p] if p in found else next(spare) for p in range(n)]


class Columns:
    """The columns of vectors (id, block, v) of ``width`` numbers a block, ``blocks`` blocks, over a numbered graph."""

    def __init__(self, rows: DataFrame, graph: NumberedGraph, width: int, blocks: int):
        spark = rows.sparkSession
        self.graph, self.width, self.blocks, self.kind = graph, width, blocks, dict(rows.dtypes)["id"]
        n, size = width * blocks, graph.size
        tasks = spark.sparkContext.defaultParallelism
        own = max(1, min(COLUMNS, NUMBERS // max(1, size), -(-n // (2 * tasks))))
        self.columns = [np.arange(c, min(c + own, n)) for c in range(0, n, own)]
        self.keys = _even_keys(spark, len(self.columns))
        columns, keys = self.columns, self.keys

        def deal(batches):
            import pyarrow as pa

            for batch in batches:
                if not batch.num_rows:
                    continue
                nodes, at, values = batch.column("n").to_numpy().astype("<i4"), batch.column("block").to_numpy(), matrix_of(batch.column("v"))
                for k, own in zip(keys, columns, strict=True):
                    for b in np.unique(own // width).tolist():
                        mine = own[own // width == b]
                        part = values[:, mine - b * width]
                        chosen = np.flatnonzero((at == b) & (part != 0).any(axis=1))
                        if len(chosen):
                            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([int(mine[0] - own[0])], pa.int32()), pa.array([nodes[chosen].tobytes()], pa.binary()), pa.array([np.ascontiguousarray(part[chosen].T).tobytes()], pa.binary())], names=["g", "first", "nodes", "values"])
            # Every group is there, whatever its numbers.
            for k in keys:
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([0], pa.int32()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary())], names=["g", "first", "nodes", "values"])

        def gather(batches):
            import pyarrow as pa

            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for r in range(batch.num_rows):
                    k = batch.column("g")[r].as_py()
                    if k not in held:
                        held[k] = np.zeros((len(columns[keys.index(k)]), size))
                    nodes = np.frombuffer(batch.column("nodes")[r].as_buffer(), dtype="<i4")
                    if len(nodes):
                        values = np.frombuffer(batch.column("values")[r].as_buffer(), dtype="<f8").reshape(-1, len(nodes))
                        first = batch.column("first")[r].as_py()
                        for j, v in enumerate(values):
                            np.add.at(held[k][first + j], nodes, v)
            for k, x in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([x.tobytes()], pa.binary())], names=["g", "x"])

        placed = rows.join(graph.nodes.select("id", "n"), "id").select("n", "block", "v")
        dealt = placed.mapInArrow(deal, "g long, first int, nodes binary, values binary").repartition(len(keys), "g")
        self.rows = dealt.mapInArrow(gather, "g long, x binary")

    def solve(self, way: Callable, low: int, high: int) -> tuple[DataFrame, dict[int, float]]:
        """(vectors, numbers): ``way(x, send, columns)`` of every group of columns, for nodes numbered ``low`` to ``high``, as rows (id, block, v).

        ``x`` has a row a column, ``send(v)`` gives what arrives at the nodes when each sends the number v along its
        edges in proportion to their weights. ``way`` returns such rows and a number a column.
        """
        graph, keys, columns, size, width = self.graph, self.keys, self.columns, self.graph.size, self.width

        def run(batches):
            import pyarrow as pa

            edges: list = []
            held: list = []  # the columns whose edges are being read

            def solved():
                if len(held) == 1:
                    parts, some = [], []
                    while edges:  # large parts, so that sums over all nodes are few; not one, so that products of edges are small
                        some.append(edges.pop())
                        if not edges or sum(len(x[0]) for x in some) >= EDGES_AT_ONCE:
                            parts.append(tuple(np.concatenate(x) for x in zip(*some, strict=True)))
                            some = []
                    strength = sum(np.bincount(a, weights=w, minlength=size) + np.bincount(b, weights=w, minlength=size) for a, b, w in parts)
                    held.extend((parts, np.where(strength > 0, 1.0 / np.where(strength > 0, strength, 1.0), 0.0)))
                k, (parts, inverse) = held[0][0], held[1:]

                def send(v: np.ndarray) -> np.ndarray:
                    u, got = v * inverse, np.zeros(size)
                    for a, b, w in parts:
                        got += np.bincount(b, weights=w * u[a], minlength=size)
                        got += np.bincount(a, weights=w * u[b], minlength=size)
                    return got

                own = columns[keys.index(k)]
                out, numbers = way(np.frombuffer(held[0][1], dtype="<f8").reshape(len(own), size).copy(), send, own)
                for start in range(low - low % NODES_AT_ONCE, high + 1, NODES_AT_ONCE):
                    part = np.ascontiguousarray(out[:, start : start + NODES_AT_ONCE])
                    if part.any():
                        yield pa.RecordBatch.from_arrays([pa.array([start]), pa.array([k]), pa.array([part.tobytes()], pa.binary()), pa.array([None], pa.list_(pa.float64()))], names=["start", "g", "x", "numbers"])
                yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([k]), pa.array([None], pa.binary()), pa.array([np.asarray(numbers, dtype=float).tolist()])], names=["start", "g", "x", "numbers"])

            for batch in batches:
                for r in range(batch.num_rows):
                    k = batch.column("g")[r].as_py()
                    if held and held[0][0] != k:
                        yield from solved()
                        held[0] = (k, batch.column("x")[r].as_py())
                    elif not held:
                        held.append((k, batch.column("x")[r].as_py()))
                    if len(held) == 1:
                        edges.append(tuple(np.frombuffer(batch.column(c)[r].as_py(), dtype=kind) for c, kind in (("a", "<i4"), ("b", "<i4"), ("w", "<f8"))))
            if held:
                yield from solved()

        pairs = self.rows.join(graph.edges.hint("shuffle_replicate_nl")).select("g", "x", "a", "b", "w")
        found = cut_lineage(pairs.mapInArrow(run, "start long, g long, x binary, numbers array<double>"))
        numbers = {int(c): v for r in found.where("start < 0").select("g", "numbers").collect() for c, v in zip(columns[keys.index(r.g)], r.numbers, strict=True)}

        n_blocks = self.blocks

        def rows_of(batches):
            held: list = []

            def told():
                at, matrix = held[0][0], np.zeros((NODES_AT_ONCE, width * n_blocks))
                for _, k, x in held:
                    own = columns[keys.index(k)]
                    values = np.frombuffer(x, dtype="<f8").reshape(len(own), -1)
                    matrix[: values.shape[1], own] = values.T
                import pyarrow as pa

                for b in range(n_blocks):
                    part = matrix[:, b * width : (b + 1) * width]
                    some = np.flatnonzero(part.any(axis=1))
                    some = some[(some + at >= low) & (some + at <= high)]
                    if len(some):
                        yield vector_batch(pa.array((some + at).astype(np.int32)), np.full(len(some), b), np.ascontiguousarray(part[some]))

            for batch in batches:
                for r in range(batch.num_rows):
                    row = tuple(batch.column(c)[r].as_py() for c in ("start", "g", "x"))
                    if held and held[0][0] != row[0]:
                        yield from told()
                        held = []
                    held.append(row)
            if held:
                yield from told()

        chunks = found.where("start >= 0").select("start", "g", "x").repartition("start").sortWithinPartitions("start")
        vectors = chunks.mapInArrow(rows_of, vectors_of("int")).withColumnRenamed("id", "n")
        return vectors.join(graph.nodes.select("id", "n"), "n").select("id", "block", "v"), numbers
