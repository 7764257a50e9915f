"""Additions that only the design notes of such engines name: entropy filter, familiarity router, edit-distance affinity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .dense import top_k


def token_entropy(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_tokens, entropy): Shannon entropy in bits of each text's ASCII words; texts without words have 0.

    A text's words are counted where the text is read, before the shuffle.
    """
    words = docs.select(F.col(id_col).alias("id"), F.explode(F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), "[^a-z]+", -1), lambda w: w != "")).alias("w"))
    counts = words.groupBy("id", "w").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.sum("n").alias("n_tokens"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    found = docs.select(F.col(id_col).alias("id")).join(counts, "id", "left")
    return found.select("id", F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens"), F.coalesce(F.log2("n_tokens") - F.col("s") / F.col("n_tokens"), F.lit(0.0)).alias("entropy"))


def familiar(queries: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(qid, iid, score, familiar): the best item of each query but itself, and whether it is near enough to answer from alone."""
    best = top_k(queries, items, 2).where("qid <> iid").groupBy("qid").agg(F.min(F.struct("rank", "iid", "score")).alias("b"))
    return best.select("qid", "b.iid", "b.score", (F.col("b.score") >= threshold).alias("familiar"))


def familiar_answers(questions: DataFrame, items: DataFrame, threshold: float, k: int) -> DataFrame:
    """(qid, iid, score, rank): the k best items of those questions whose best item scores at least ``threshold``.

    The other questions have no rows: they are left to a costlier way. A question without a vector is never familiar.
    """
    best = cut_lineage(top_k(questions, items, k).select("qid", "iid", "score", "rank"))
    near = best.groupBy("qid").agg(F.max("score").alias("top")).where(F.round("top", 9) >= threshold)
    return best.join(near.select("qid"), "qid", "left_semi")


def edit_similarity(a, b):
    """1 minus the edit distance over the longer length; two empty strings are 1."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(F.lit(1.0))
