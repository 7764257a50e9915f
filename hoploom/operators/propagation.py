"""Score propagation over propositions, modulated by guidance vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vector import scaled
from ..session import cut_lineage
from .affinity import spread
from .dense import all_scores, top_k
from .masking import mask, top_clusters


def attention(guidance: DataFrame, propositions: DataFrame, temperature: float = 0.1) -> DataFrame:
    """(qid, hop, prop_idx, attention): softmax of cosine over all propositions, times their number.

    ``guidance`` has qid, hop and vector; ``propositions`` prop_idx and vector. The mean is 1.
    """
    queries = guidance.select("qid", "hop", scaled(F.col("vector")).alias("vector"))
    items = propositions.select(F.col("prop_idx").alias("iid"), scaled(F.col("vector")).alias("vector"))
    found = all_scores(queries, items, keys=("qid", "hop"), scale="softmax", temperature=temperature)
    return found.select("qid", "hop", F.col("iid").alias("prop_idx"), F.col("score").alias("attention"))


def hop(scores: DataFrame, incidence: DataFrame, weights: DataFrame | None, affinity: DataFrame | None, factor: float = 0.3) -> DataFrame:
    """One step H D H'x + factor A x, divided by its maximum per question where that is positive.

    ``weights`` (qid, prop_idx, attention) holds the propositions that the mask lets pass; None: all, with 1.
    """
    y = scores.join(incidence, "entity_idx").groupBy("qid", "prop_idx").agg(F.sum("score").alias("y"))
    z = y.withColumn("z", F.col("y")) if weights is None else y.join(weights, ["qid", "prop_idx"]).withColumn("z", F.col("y") * F.col("attention"))
    x = z.join(incidence, "prop_idx").groupBy("qid", "entity_idx").agg(F.sum("z").alias("score"))
    if affinity is not None:
        x = x.unionByName(spread(scores, affinity, factor)).groupBy("qid", "entity_idx").agg(F.sum("score").alias("score"))
    x = cut_lineage(x)
    top = x.groupBy("qid").agg(F.max("score").alias("top"))
    return x.join(top, "qid").select("qid", "entity_idx", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(F.col("score")).alias("score"))


def change(before: DataFrame, after: DataFrame) -> DataFrame:
    """(qid, diff): Euclidean distance of two states; absent entities are 0."""
    both = before.select("qid", "entity_idx", (-F.col("score")).alias("score")).unionByName(after.select("qid", "entity_idx", "score"))
    return both.groupBy("qid", "entity_idx").agg(F.sum("score").alias("d")).groupBy("qid").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("diff"))


def propagate(seeds: DataFrame, incidence: DataFrame, propositions: DataFrame, guidance: DataFrame, affinity: DataFrame | None = None, centroids: DataFrame | None = None, prop_cluster: DataFrame | None = None, max_hops: int = 5, factor: float = 0.3, top_p: int = 10, tolerance: float = 1e-4, temperature: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(state, hops): scores (qid, entity_idx, score) and the number of hops taken per question.

    A question stops after its last guidance vector, after ``max_hops``, or after the
    hop that changed its state by less than ``tolerance``.
    """
    guidance = cut_lineage(guidance.where(F.col("hop") < max_hops))
    state = seeds.select("qid", "entity_idx", "score")
    going = seeds.select("qid").distinct()
    hops = going.select("qid", F.lit(0).alias("num_hops"))
    last = guidance.agg(F.max("hop")).first()[0]
    for t in range(0 if last is None else last + 1):
        own = guidance.where(F.col("hop") == t).join(going, "qid", "left_semi")
        weights = attention(own, propositions, temperature)
        if centroids is not None and prop_cluster is not None:
            weights = weights.join(mask(top_clusters(own, centroids, top_p), prop_cluster), ["qid", "hop", "prop_idx"], "left_semi")
        moving = own.select("qid")
        old = state.join(moving, "qid", "left_semi")
        new = cut_lineage(hop(old, incidence, weights.select("qid", "prop_idx", "attention"), affinity, factor))
        state = state.join(moving, "qid", "left_anti").unionByName(new)
        diff = change(old, new)
        hops = cut_lineage(hops.join(moving.withColumn("took", F.lit(t + 1)), "qid", "left").select("qid", F.coalesce("took", "num_hops").alias("num_hops")))
        state = cut_lineage(state)
        going = cut_lineage(moving.join(diff, "qid", "left").where(F.coalesce("diff", F.lit(0.0)) >= tolerance).select("qid"))
        if going.isEmpty():
            break
    return state, hops


def proposition_scores(state: DataFrame, incidence: DataFrame) -> DataFrame:
    """(qid, prop_idx, score): sums of member entities' scores, without mask and attention."""
    return state.join(incidence, "entity_idx").groupBy("qid", "prop_idx").agg(F.sum("score").alias("score"))


def top_rows(scores: DataFrame, id_col: str, k: int, all_ids: DataFrame | None = None) -> DataFrame:
    """The ``k`` best ids per question; with ``all_ids`` zero rows fill up where too few have scores."""
    ranked = W.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), id_col)
    if all_ids is not None:
        # The first k ids fill up at most, beside what has a score.
        few = [r[0] for r in all_ids.select(id_col).orderBy(id_col).limit(k).collect()]
        zero = scores.select("qid").distinct().select("qid", F.explode(F.array(*map(F.lit, few)).cast(f"array<{dict(all_ids.dtypes)[id_col]}>")).alias(id_col), F.lit(0.0).alias("score"))
        scores = scores.select("qid", id_col, "score").unionByName(zero.join(scores, ["qid", id_col], "left_anti"))
    return scores.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("qid", id_col, "score", "rank")


def match_seeds(question_entities: DataFrame, entities: DataFrame, question_vectors: DataFrame, entity_vectors: DataFrame, fallback: int = 5) -> DataFrame:
    """(qid, entity_idx, score): entities named exactly, with 1; questions with none take the most similar ones by raw dot product."""
    exact = question_entities.select("qid", F.lower("mention").alias("name")).distinct().join(entities, "name").select("qid", "entity_idx", F.lit(1.0).alias("score"))
    rest = question_vectors.join(exact.select("qid").distinct(), "qid", "left_anti")
    near = top_k(rest, entity_vectors.select(F.col("entity_idx").alias("iid"), "vector"), fallback)
    return exact.unionByName(near.select("qid", F.col("iid").alias("entity_idx"), "score"))
