"""Passage priors: dense similarity and the occurrences of activated entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import entity_bonus, passage_score
from .dense import all_scores


def occurrences(needles: DataFrame, passages: DataFrame, block: int = 50_000) -> DataFrame:
    """(passage_id, needle, n): non-overlapping occurrences of each needle in each lower-cased passage, where there are any.

    Needles are taken in blocks of about ``block``; a task runs one automaton of a
    block over its passages, so the work does not grow with needles times passages.
    """
    spark = needles.sparkSession
    distinct = needles.select("needle").where("needle <> ''").distinct()
    blocks = max(1, -(-distinct.count() // block))
    parts = []
    for b in range(blocks):
        words = [r.needle for r in (distinct.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == b) if blocks > 1 else distinct).collect()]
        if not words:
            continue
        shared = spark.sparkContext.broadcast(words)

        def run(frames, shared=shared):
            import ahocorasick
            import pandas as pd

            automaton = ahocorasick.Automaton()
            for w in shared.value:
                automaton.add_word(w, w)
            automaton.make_automaton()
            for frame in frames:
                ids, found, counts = [], [], []
                for passage_id, text in zip(frame["passage_id"], frame["text"], strict=True):
                    n: dict[str, int] = {}
                    free: dict[str, int] = {}
                    for end, w in automaton.iter(text.lower()):
                        if end - len(w) + 1 >= free.get(w, 0):  # from left to right, without overlap
                            n[w] = n.get(w, 0) + 1
                            free[w] = end + 1
                    ids += [passage_id] * len(n)
                    found += n.keys()
                    counts += n.values()
                if ids:
                    yield pd.DataFrame({"passage_id": pd.Series(ids, dtype=object), "needle": pd.Series(found, dtype=object), "n": counts})

        parts.append(passages.select("passage_id", "text").mapInPandas(run, "passage_id string, needle string, n long"))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "passage_id string, needle string, n long")


def passage_priors(active: DataFrame, questions: DataFrame, passages: DataFrame, ratio: float = 1.5, weight: float = 0.05) -> DataFrame:
    """(qid, passage_id, prior) for every question and passage.

    ``active`` has qid, entity, score, tier; ``questions`` qid and vector; ``passages`` passage_id, text and vector.
    """
    scaled = all_scores(questions, passages.select(F.col("passage_id").alias("iid"), "vector"), scale="minmax")
    normalised = scaled.select("qid", F.col("iid").alias("passage_id"), F.col("score").alias("dense"))
    needles = active.select("qid", F.lower("entity").alias("needle"), "score", "tier")
    hits = needles.join(occurrences(needles, passages), "needle")
    bonus = hits.groupBy("qid", "passage_id").agg(F.sum(entity_bonus(F.col("score"), F.col("n"), F.col("tier"))).alias("bonus"))
    return normalised.join(bonus, ["qid", "passage_id"], "left").select("qid", "passage_id", passage_score(F.col("dense"), F.coalesce("bonus", F.lit(0.0)), ratio, weight).alias("prior"))
