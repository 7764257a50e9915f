"""Retrieval by personalised PageRank without steps over all nodes for each question.

A question's restart weights are a dense part, the scaled similarity of every
passage, and a sparse part: its entities and the passages that name them. The
similarity is linear in the question's vector, and so is PageRank in the restart:
the dense part of all questions follows from one diffused vector a passage, made of
the passages' vectors and a constant once for the graph. The sparse part is pushed
along edges from the few nodes that hold it; where a task holds the graph's edges,
both go by columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scores import entity_bonus
from ..functions.vector import dot
from ..session import cut_lineage
from .batches import list_arrays
from .blocks import block_sums, bonus_blocks, pack, question_places, question_sets, score_ends
from .columns import NumberedGraph, numbered
from .dense import top_k
from .pagerank import diffuse, diffuse_columns, edge_lists, edge_shares, push, push_columns
from .prior import occurrences


@dataclass
class DiffusedGraph:
    """What a graph keeps for its questions: ``vectors`` (id, x, g, linked): a passage's vector with a 1 behind it, the same diffused, and whether it has edges; and the graph ``numbered`` or, if a task cannot hold its edges, their ``shares`` (src, dst, p)."""

    vectors: DataFrame
    damping: float
    steps: int
    numbered: NumberedGraph | None = None
    shares: DataFrame | None = None


def diffuse_passages(edges: DataFrame, passages: DataFrame, damping: float = 0.5, steps: int = 8) -> DiffusedGraph:
    """``passages`` has passage_id and vector. The tail that ``steps`` leave out is damping^(steps + 1) / (1 - damping) of the mass at most."""
    edges = cut_lineage(edges)
    x = F.concat(F.col("vector").cast("array<double>"), F.array(F.lit(1.0)))
    rows = cut_lineage(passages.where("passage_id IS NOT NULL AND vector IS NOT NULL").select(F.col("passage_id").alias("id"), x.alias("x")))

    def to_bytes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([np.array(v, dtype="<f8").tobytes() for v in batch.column("x").to_pylist()], pa.binary())], names=["id", "v"])

    def to_lists(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([np.frombuffer(v, dtype="<f8").tolist() for v in batch.column("v").to_pylist()], pa.list_(pa.float64()))], names=["id", "g"])

    graph, packed, shares = numbered(edges, rows.select("id")), rows.mapInArrow(to_bytes, "id string, v binary"), None
    if graph is not None:
        spread = diffuse_columns(packed, graph, damping, steps)
        linked = graph.nodes.where("linked").select("id", "linked")
    else:
        shares = cut_lineage(edge_shares(edges))
        spread = diffuse(packed, edge_lists(shares, damping), steps)
        linked = shares.select(F.col("src").alias("id")).distinct().withColumn("linked", F.lit(True))
    own = spread.join(rows.select("id"), "id", "left_semi").mapInArrow(to_lists, "id string, g array<double>")
    # A vector of zeros has no columns, and stays.
    vectors = rows.join(own, "id", "left").join(linked, "id", "left").select("id", "x", F.coalesce("g", F.transform("x", lambda v: F.lit(0.0))).alias("g"), F.coalesce("linked", F.lit(False)).alias("linked"))
    return DiffusedGraph(cut_lineage(vectors), damping, steps, graph, shares)


def _sums(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sums of x over all passages and over those without edges; a row a task comes back."""

    def run(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                x, alone = np.array(batch.column("x").to_pylist()), ~batch.column("linked").to_numpy(zero_copy_only=False).astype(bool)
                own = np.stack([x.sum(axis=0), x[alone].sum(axis=0)])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total[0].tolist()]), pa.array([total[1].tolist()])], names=["whole", "alone"])

    rows = vectors.select("x", "linked").mapInArrow(run, "whole array<double>, alone array<double>").collect()
    if not rows:
        return np.zeros(1), np.zeros(1)
    return np.sum([r.whole for r in rows], axis=0), np.sum([r.alone for r in rows], axis=0)


def _dense_parts(spark, questions: DataFrame, graph: DiffusedGraph, scale: float) -> DataFrame:
    """(qid, a, total, alone): ``a`` gives a passage's dense restart weight as its product with x, and their sums."""
    places = cut_lineage(question_places(questions))
    whole, alone = _sums(graph.vectors)
    items = graph.vectors.select(F.col("id").alias("iid"), F.slice("x", F.lit(1), F.size("x") - 1).alias("vector"))
    parts = []
    for _, _, known, matrix in question_sets(places, questions):
        ends = score_ends(matrix, items)
        rows = []
        for at, qid in known.items():
            low, high = ends[at]
            slope = 0.0 if high == low else scale / (high - low)
            a = np.append(slope * matrix[at], scale if high == low else -slope * low)
            rows.append((qid, a.tolist(), float(a @ whole), float(a @ alone)))
        parts.append(spark.createDataFrame(rows, f"qid {dict(questions.dtypes)['qid']}, a array<double>, total double, alone double"))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], f"qid {dict(questions.dtypes)['qid']}, a array<double>, total double, alone double")


def retrieve_by_push(weights: DataFrame, active: DataFrame, questions: DataFrame, passages: DataFrame, graph: DiffusedGraph, k: int = 5, ratio: float = 1.5, weight: float = 0.05, eps: float = 1e-5, rounds: int = 12) -> tuple[DataFrame, DataFrame]:
    """(ranked, bounds): (qid, passage_id, score, rank), and (qid, bound) of what the scores of a question lack in sum.

    ``weights`` has qid, id, weight; ``active`` qid, entity, score, tier; ``questions`` qid
    and vector; ``passages`` passage_id and text. Restart weights are those of the priors,
    but a sum of bonuses below 0 counts as 0. Residuals over ``eps`` of a question's mass are pushed. Only passages
    that the push reaches are listed, and the k best of the dense part of each question:
    pushed mass is never negative, so no other can be among the k best.
    """
    spark = questions.sparkSession
    asked = cut_lineage(_dense_parts(spark, questions, graph, ratio * weight))
    if graph.numbered is not None:
        return _by_columns(weights, active, asked, passages, graph, k, weight, eps, rounds)
    needles = active.select("qid", F.lower("entity").alias("needle"), "score", "tier")
    hits = needles.join(occurrences(needles, passages), "needle")
    bonus = hits.groupBy("qid", F.col("passage_id").alias("id")).agg((F.log1p(F.greatest(F.sum(entity_bonus(F.col("score"), F.col("n"), F.col("tier"))), F.lit(0.0))) * weight).alias("r"))
    bonus = bonus.join(graph.vectors.select("id"), "id", "left_semi").select("qid", "id", "r")
    sparse = weights.where("weight > 0 AND NOT isnan(weight)").groupBy("qid", "id").agg(F.sum("weight").alias("r")).unionByName(bonus)
    sparse = cut_lineage(sparse.where("r > 0").join(asked.select("qid"), "qid", "left_semi"))
    linked = graph.shares.select(F.col("src").alias("id"), F.lit(True).alias("linked")).distinct()
    sums = sparse.join(linked, "id", "left").groupBy("qid").agg(F.sum("r").alias("more"), F.sum(F.when(F.col("linked").isNull(), F.col("r")).otherwise(0.0)).alias("more_alone"))
    d = graph.damping
    told = asked.join(sums, "qid", "left").select("qid", "a", (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), (F.col("alone") + F.coalesce("more_alone", F.lit(0.0))).alias("alone"))
    told = cut_lineage(told.where("total > 0").withColumn("f", F.lit(1 - d) / (F.lit(1.0) - F.lit(d) * F.col("alone") / F.col("total")) / F.col("total")))
    mass, left = push(sparse, graph.shares, told.select("qid", (F.col("total") * eps).alias("eps")), d, rounds)
    of_passages = cut_lineage(mass.withColumnRenamed("mass", "pushed").join(graph.vectors.select("id", "g"), "id"))
    scored = of_passages.join(told.select("qid", "a", "f"), "qid").select("qid", F.col("id").alias("passage_id"), ((dot(F.col("a"), F.col("g")) + F.col("pushed")) * F.col("f")).alias("score"))
    best = top_k(told.select("qid", F.transform("a", lambda x: x * F.col("f")).alias("vector")), graph.vectors.select(F.col("id").alias("iid"), F.col("g").alias("vector")), k, digits=15)
    rest = best.select("qid", F.col("iid").alias("passage_id"), "score").join(of_passages.select("qid", F.col("id").alias("passage_id")), ["qid", "passage_id"], "left_anti")
    ranked = W.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "passage_id")
    rows = scored.unionByName(rest).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    bounds = told.join(left, "qid", "left").select("qid", (F.coalesce("left", F.lit(0.0)) * d / (1 - d) * F.col("f") + 2 * F.lit(d) ** (graph.steps + 1)).alias("bound"))
    return rows, bounds


#: Questions whose pushed mass is in one vector.
WIDTH = 512


def _by_columns(weights: DataFrame, active: DataFrame, asked: DataFrame, passages: DataFrame, graph: DiffusedGraph, k: int, weight: float, eps: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """``retrieve_by_push`` where a task holds the edges: sparse weights, what is pushed and the scores are vectors of questions; no row a question and passage is made."""
    spark, d, kind = asked.sparkSession, graph.damping, dict(asked.dtypes)["qid"]
    n = asked.count()
    if not n:
        return spark.createDataFrame([], f"qid {kind}, passage_id string, score double, rank int"), spark.createDataFrame([], f"qid {kind}, bound double")
    width = min(WIDTH, n)
    places = cut_lineage(question_places(asked, width))
    count = -(-n // width)
    of_passages = graph.vectors.select("id")
    bonus = bonus_blocks(active, places, passages, weight, width).join(of_passages, "id", "left_semi")
    named = pack(weights.where("weight > 0 AND NOT isnan(weight)").select("qid", "id", "weight"), places, width)
    sparse = cut_lineage(named.select("id", "block", "v").unionByName(bonus.select("id", "block", "v")))
    linked = sparse.join(graph.numbered.nodes.select("id", "linked"), "id", "left").select("block", "v", F.coalesce("linked", F.lit(False)).alias("linked"))
    sums = block_sums(linked)
    total, alone, factor, slopes = np.zeros(count * width), np.zeros(count * width), np.zeros(count * width), None
    for b, (whole, lonely) in sums.items():
        total[b * width : (b + 1) * width], alone[b * width : (b + 1) * width] = whole, lonely
    names = {}
    for r in asked.join(places, "qid").toLocalIterator():
        at = r.block * width + r.pos
        slopes = np.zeros((count * width, len(r.a))) if slopes is None else slopes
        slopes[at], names[at] = r.a, r.qid
        total[at], alone[at] = total[at] + r.total, alone[at] + r.alone
        if total[at] > 0:
            factor[at] = (1 - d) / (1.0 - d * alone[at] / total[at]) / total[at]
    pushed, left = push_columns(sparse, graph.numbered, total * eps, width, d, rounds, of_passages)
    blocks = spark.range(count).select(F.col("id").alias("block"))
    every = graph.vectors.select("id", "g").crossJoin(F.broadcast(blocks)).join(pushed, ["id", "block"], "left")
    shared = spark.sparkContext.broadcast((slopes, factor))

    def run(batches):
        import pyarrow as pa

        slopes, factor = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, blocks = np.array(batch.column("id").to_pylist(), dtype=object), batch.column("block").to_numpy()
            for b in np.unique(blocks).tolist():
                own = np.flatnonzero(blocks == b)
                own = own[np.argsort(ids[own], kind="stable")]  # so that ties go to the smaller id
                part = batch.take(pa.array(own))
                g = list_arrays(part.column("g"))[0].reshape(len(own), -1)
                columns = slice(b * width, (b + 1) * width)
                scores = g @ slopes[columns].T
                for row, v in enumerate(part.column("v").to_pylist()):
                    if v is not None:
                        scores[row] += np.frombuffer(v, dtype="<f8")
                scores *= factor[columns]
                best = np.argsort(-np.round(scores, 9), axis=0, kind="stable")[:k].T
                pos, at = np.repeat(np.arange(width), best.shape[1]), best.ravel()
                chosen = factor[columns][pos] > 0
                pos, at = pos[chosen], at[chosen]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at)), pa.array(np.full(len(at), b)), pa.array(pos, pa.int32()), pa.array(scores[at, pos])], names=["passage_id", "block", "pos", "score"])

    few = every.select("id", "g", "block", "v").mapInArrow(run, "passage_id string, block long, pos int, score double")
    ranked = W.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "passage_id")
    rows = few.join(F.broadcast(places), ["block", "pos"]).select("qid", "passage_id", "score").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    bounds = [(qid, float(left.get(at, 0.0) * d / (1 - d) * factor[at] + 2 * d ** (graph.steps + 1))) for at, qid in names.items() if factor[at] > 0]
    return rows, spark.createDataFrame(bounds, f"qid {kind}, bound double")
