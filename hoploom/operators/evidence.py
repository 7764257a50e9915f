"""From ranked propositions to evidence and source chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import answer_context


def evidence(ranked: DataFrame, propositions: DataFrame, evidence_limit: int = 5, chunk_limit: int = 3) -> DataFrame:
    """(qid, evidence, source_chunks, context): first texts and first chunks in rank order, duplicates kept.

    ``ranked`` has qid, prop_idx, rank (few rows per question); ``propositions`` prop_idx, text, chunk_id.
    """
    rows = ranked.join(propositions, "prop_idx").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "chunk_id"))).alias("rows"))
    texts = F.slice(F.transform("rows", lambda r: r["text"]), 1, evidence_limit)
    chunks = F.slice(F.transform(F.filter("rows", lambda r: r["chunk_id"].isNotNull()), lambda r: r["chunk_id"]), 1, chunk_limit)
    return rows.select("qid", texts.alias("evidence"), chunks.alias("source_chunks"), answer_context(texts).alias("context"))


def citations(ranked: DataFrame, propositions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, rank, prop_id, chunk_id, chunk): where each piece of evidence comes from."""
    return ranked.join(propositions, "prop_idx").join(chunks.select("chunk_id", F.col("text").alias("chunk")), "chunk_id", "left").select("qid", "rank", "prop_id", "chunk_id", "chunk")
