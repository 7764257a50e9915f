"""Model replies to propositions and sub-questions; entity-proposition incidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import capitalised_words, content_key, numbered_lines
from .keys import dense_index

MIN_PROPOSITION_CHARS = 10
MIN_SUBQUESTION_CHARS = 6


def parse_propositions(replies: DataFrame, chunk_id: str, reply: str) -> DataFrame:
    """(prop_id, text, chunk_id): one row per distinct proposition; of several sources the least chunk id."""
    lines = replies.select(F.col(chunk_id).alias("chunk_id"), F.explode(numbered_lines(F.col(reply), MIN_PROPOSITION_CHARS)).alias("text"))
    return lines.groupBy("text").agg(F.min("chunk_id").alias("chunk_id")).select(content_key(F.col("text"), "prop_").alias("prop_id"), "text", "chunk_id")


def parse_subquestions(replies: DataFrame, qid: str, reply: str) -> DataFrame:
    """(qid, hop, text) in order; a question without usable lines has one empty sub-question."""
    lines = numbered_lines(F.col(reply), MIN_SUBQUESTION_CHARS)
    return replies.select(F.col(qid).alias("qid"), F.posexplode(F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit("")))).alias("hop", "text"))


def proposition_entities(propositions: DataFrame) -> DataFrame:
    """(prop_id, name): lower-cased entities of every proposition, by the stand-in recogniser on the proposition itself."""
    return propositions.select("prop_id", F.explode(capitalised_words(F.col("text"))).alias("name")).select("prop_id", F.lower("name").alias("name")).distinct()


def entities_by_sentence_match(propositions: DataFrame, entity_sentences: DataFrame) -> DataFrame:
    """The compatible variant: a proposition has the entities of the sentence it equals, else none."""
    return propositions.join(entity_sentences, propositions["text"] == entity_sentences["sentence"]).select("prop_id", F.lower("entity").alias("name")).distinct()


def incidence_of(members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(incidence, entity index, proposition index) of (prop_id, name) pairs."""
    entities = dense_index(members, "name", "entity_idx")
    props = dense_index(members, "prop_id", "prop_idx")
    incidence = members.join(entities, "name").join(props, "prop_id").select("entity_idx", "prop_idx", F.lit(1.0).alias("value")).distinct()
    return incidence, entities, props


def entities_in(members: DataFrame, prop_ids: DataFrame) -> DataFrame:
    """Sorted entities per asked proposition; unknown ids give an empty list."""
    found = members.join(prop_ids, "prop_id", "left_semi").groupBy("prop_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return prop_ids.distinct().join(found, "prop_id", "left").select("prop_id", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def propositions_with(members: DataFrame, names: DataFrame) -> DataFrame:
    """Sorted propositions per asked entity, in any case; unknown names give an empty list."""
    asked = names.select(F.lower("name").alias("name")).distinct()
    found = members.join(asked, "name", "left_semi").groupBy("name").agg(F.array_sort(F.collect_set("prop_id")).alias("prop_ids"))
    return asked.join(found, "name", "left").select("name", F.coalesce("prop_ids", F.array().cast("array<string>")).alias("prop_ids"))
