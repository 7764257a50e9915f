"""Multi-hop entity activation for many questions at once.

Questions are rows. Both modes start from seeds (qid, entity, score) and hop
over (sentence, entity) pairs by joins; only the loop over hops is on the
driver, and every hop is cut off by a checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage
from .dense import top_k


def seed_entities(question_entities: DataFrame, entity_vectors: DataFrame) -> DataFrame:
    """(qid, entity, score): for each vector of a question's entities the most similar entity; ties to the first by name.

    ``question_entities`` has qid, mention and vector; equal mentions are looked up once for all questions.
    """
    mentions = question_entities.select(F.col("mention").alias("qid"), "vector").dropDuplicates(["qid"])
    best = top_k(mentions, entity_vectors.select(F.col("entity").alias("iid"), "vector"), 1).select(F.col("qid").alias("mention"), F.col("iid").alias("entity"), "score")
    return question_entities.select("qid", "mention").distinct().join(best, "mention").groupBy("qid", "entity").agg(F.max("score").alias("score"))


def _similarities(candidates: DataFrame, similarity: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds ``sim`` to rows with qid and sentence; each pair is computed once."""
    return candidates.join(similarity(candidates.select("qid", "sentence").distinct()), ["qid", "sentence"])


def activate_vectorized(seeds: DataFrame, pairs: DataFrame, similarity: Callable[[DataFrame], DataFrame], max_iterations: int = 3, top_k_sentence: int = 1, threshold: float = 0.5):
    """(weights, active): summed scores per (qid, entity), and (qid, entity, score, tier) of the last activation.

    In a hop all frontier entities choose their unused sentences side by side, a
    chosen sentence sums all frontier entities in it, and the threshold applies
    to an entity's sum. ``similarity`` maps (qid, sentence) to (qid, sentence, sim).
    """
    frontier = seeds.select("qid", "entity", "score")
    gained = [frontier]
    active = [frontier.withColumn("tier", F.lit(0))]
    used = None
    for hop in range(1, max_iterations):
        frontier = cut_lineage(frontier.where(F.col("score") >= threshold).where("score > 0"))
        if frontier.isEmpty():
            break
        reach = frontier.join(pairs, "entity")
        if used is not None:
            reach = reach.join(used, ["qid", "sentence"], "left_anti")
        reach = _similarities(reach, similarity)
        ranked = W.partitionBy("qid", "entity").orderBy(F.desc(F.round("sim", 9)), "sentence")
        chosen = reach.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= top_k_sentence).select("qid", "sentence").distinct()
        lit = reach.join(chosen, ["qid", "sentence"], "left_semi").groupBy("qid", "sentence").agg((F.sum("score") * F.first("sim")).alias("w"))
        lit = cut_lineage(lit)
        following = lit.where("w > 0").join(pairs, "sentence").groupBy("qid", "entity").agg(F.sum("w").alias("score"))
        following = cut_lineage(following)
        used = lit.select("qid", "sentence") if used is None else used.union(lit.select("qid", "sentence"))
        gained.append(following)
        active.append(following.where(F.col("score") >= threshold).withColumn("tier", F.lit(hop)))
        frontier = following
    return _collect(gained, active)


def activate_bfs(seeds: DataFrame, pairs: DataFrame, similarity: Callable[[DataFrame], DataFrame], max_iterations: int = 3, top_k_sentence: int = 1, threshold: float = 0.5):
    """(weights, active) as above, with the exact order of a breadth-first walk.

    Frontier entities choose one after another, and a chosen sentence is gone
    for those that follow (``choose_in_turn``). Each contribution must reach the
    threshold by itself; the last one sets an entity's score in the next hop.
    """
    frontier = seeds.select("qid", "entity", "score", F.row_number().over(W.partitionBy("qid").orderBy("entity")).cast("long").alias("turn"))
    gained = [frontier.select("qid", "entity", "score")]
    active = [frontier.select("qid", "entity", "score", F.lit(1).alias("tier"))]
    used = None
    for hop in range(1, max_iterations):
        frontier = cut_lineage(frontier.where(F.col("score") >= threshold))
        if frontier.isEmpty():
            break
        reach = frontier.join(pairs, "entity")
        if used is not None:
            reach = reach.join(used, ["qid", "sentence"], "left_anti")
        picks = cut_lineage(choose_in_turn(_similarities(reach, similarity), top_k_sentence))
        used = picks.select("qid", "sentence") if used is None else used.union(picks.select("qid", "sentence"))
        given = picks.join(pairs.withColumnRenamed("entity", "to"), "sentence").withColumn("gain", F.col("score") * F.col("sim")).where(F.col("gain") >= threshold)
        given = given.withColumn("pick", F.struct("turn", "r"))
        per = given.groupBy("qid", F.col("to").alias("entity")).agg(F.sum("gain").alias("total"), F.max_by("gain", "pick").alias("score"), F.min(F.struct("pick", "to")).alias("place"))
        per = cut_lineage(per)
        gained.append(per.select("qid", "entity", F.col("total").alias("score")))
        active.append(per.select("qid", "entity", "score", F.lit(hop + 1).alias("tier")))
        frontier = per.select("qid", "entity", "score", F.row_number().over(W.partitionBy("qid").orderBy("place")).cast("long").alias("turn"))
    return _collect(gained, active)


def choose_in_turn(wishes: DataFrame, k: int) -> DataFrame:
    """The rows of ``wishes`` (qid, entity, turn, sentence, sim, ...) that are chosen, with ``r``, the place of the choice.

    As if a question's entities chose in the order of ``turn``, each its ``k`` most similar sentences that are left
    (ties by sentence). Done in rounds for all at once: each entity names its k best; a sentence is held by the least turn that
    names it, and is out of reach for all later ones. A holder only ever changes to an
    earlier turn, so what is out of reach stays so; when nobody names a sentence held
    by another, the holders are those of the walk. A question's r-th entity is settled after r rounds at the latest.
    """
    best = W.partitionBy("qid", "entity").orderBy(F.desc(F.round("sim", 9)), "sentence")
    sizes = wishes.select("qid", "entity").distinct().groupBy("qid").agg((F.count(F.lit(1)) * k).alias("enough"))
    # Others can take no more than k sentences each: an entity needs no more than its first k times the number of entities.
    alive = wishes.withColumn("r", F.row_number().over(best)).join(sizes, "qid").where(F.col("r") <= F.col("enough")).drop("enough", "r")
    alive = cut_lineage(alive)
    while True:
        named = cut_lineage(alive.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k))
        held = named.groupBy("qid", "sentence").agg(F.min("turn").alias("holder"))
        if named.join(held, ["qid", "sentence"]).where("turn > holder").isEmpty():
            return named
        alive = cut_lineage(alive.join(held, ["qid", "sentence"], "left").where("holder IS NULL OR turn <= holder").drop("holder"))


def _collect(gained: list[DataFrame], active: list[DataFrame]):
    weights = gained[0]
    for df in gained[1:]:
        weights = weights.union(df)
    all_active = active[0]
    for df in active[1:]:
        all_active = all_active.union(df)
    last = all_active.groupBy("qid", "entity").agg(F.max(F.struct("tier", "score")).alias("last"))
    return weights.groupBy("qid", "entity").agg(F.sum("score").alias("weight")), last.select("qid", "entity", F.col("last.score").alias("score"), F.col("last.tier").alias("tier"))
