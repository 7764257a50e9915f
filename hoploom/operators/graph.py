"""Mentions, sentences and the weighted entity-passage graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import capitalised_runs, capitalised_words, content_key, passage_index, sentences_of, substring_count
from ..session import cut_lineage
from .keys import dense_index

#: Entity labels that never become entities.
DROPPED_LABELS = ("ORDINAL", "CARDINAL")


def passages_of(docs: DataFrame, idx: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages "idx:text" with their content keys; the prefix is part of both."""
    whole = F.concat(F.col(idx).cast("string"), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(idx).alias("idx"), whole.alias("text")).withColumn("passage_id", content_key(F.col("text"), "passage-"))


def keep_labels(extracted: DataFrame) -> DataFrame:
    """Recogniser output without the labels that never become entities."""
    return extracted.where(F.col("label").isNull() | ~F.col("label").isin(*DROPPED_LABELS))


def each(df: DataFrame, found: Column, out: str, *keep: str) -> DataFrame:
    """A row for each element of an array, without null elements.

    An outer explode: for a plain one Spark filters out empty arrays first, and for that finds what is in them twice.
    """
    return df.select(*keep, F.explode_outer(found).alias(out)).where(F.col(out).isNotNull())


def mentions_of(passages: DataFrame) -> DataFrame:
    """(passage_id, entity), each pair once, by the stand-in recogniser."""
    return each(passages, capitalised_words(F.col("text")), "entity", "passage_id").distinct()


def entity_sentences_of(passages: DataFrame) -> DataFrame:
    """(sentence, entity), each pair once over all passages.

    A sentence is shuffled once, whatever the number of its entities, and searched for them once.
    """
    sentences = each(passages, sentences_of(F.col("text")), "sentence").distinct()
    return each(sentences, capitalised_words(F.col("sentence")), "entity", "sentence")


def inverted_index(entity_sentences: DataFrame) -> DataFrame:
    """Sentences per entity. The lists are as long as an entity is common; joins use the pairs instead."""
    return entity_sentences.groupBy("entity").agg(F.array_sort(F.collect_set("sentence")).alias("sentences"))


def mention_edges(mentions: DataFrame, passages: DataFrame) -> DataFrame:
    """Entity-passage edges weighted by the entity's share of all counted occurrences in the passage."""
    counted = mentions.join(passages.select("passage_id", "text"), "passage_id").select("passage_id", "entity", substring_count(F.col("text"), F.col("entity")).alias("n"))
    return _shares(counted)


def _shares(counted: DataFrame) -> DataFrame:
    """Edges of (passage_id, entity, n), which come dealt by passage; a passage has few entities: the window needs no other shuffle."""
    return counted.withColumn("total", F.sum("n").over(W.partitionBy("passage_id"))).select(
        content_key(F.col("entity"), "entity-").alias("src"), F.col("passage_id").alias("dst"), (F.col("n") / F.when(F.col("total") > 0, F.col("total"))).alias("weight")
    )


def passage_edges(passages: DataFrame) -> DataFrame:
    """As ``mention_edges`` of the stand-in recogniser's mentions: counted where the text is, so that one shuffle without texts is left.

    Such a word is a capital with small letters behind it, so it occurs where a run of that form begins with it: the text is searched for runs once, not for every word.
    """
    words = each(passages.withColumn("runs", capitalised_runs(F.col("text"))), capitalised_words(F.col("text")), "entity", "passage_id", "runs")
    counted = words.select("passage_id", "entity", F.size(F.filter("runs", lambda run: F.startswith(run, F.col("entity")))).alias("n"))
    counted = counted.repartition("passage_id").dropDuplicates(["passage_id", "entity"])
    return _shares(counted)


def adjacency_edges(passages: DataFrame) -> DataFrame:
    """Each passage linked to the next present index, weight 1. Passages without an index have no neighbours."""
    # The order is a dense position, and the neighbour a join: no window over all rows.
    numbered = passages.select("passage_id", passage_index(F.col("text")).alias("n")).where(F.col("n").isNotNull()).distinct()
    keyed = numbered.withColumn("at", F.concat(F.lpad(F.col("n").cast("string"), 20, "0"), F.lit(" "), F.col("passage_id")))
    # What is sorted holds the passage's id: the texts are read once.
    placed = cut_lineage(dense_index(keyed, "at", "pos").select(F.substr("at", F.lit(22)).alias("passage_id"), "pos"))
    following = placed.select(F.col("passage_id").alias("dst"), (F.col("pos") - 1).alias("pos"))
    return placed.join(following, "pos").select(F.col("passage_id").alias("src"), "dst", F.lit(1.0).alias("weight"))


#: Indices of passages that share a bucket.
BUCKET = 1 << 16


def bucket_of(n: Column, bucket: int = BUCKET) -> Column:
    return F.floor(n / bucket).cast("long")


def linked_places(places: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(passage_id, n, next_id, bucket) of (passage_id, n): each passage with the next one of its bucket, null for the bucket's last."""
    keyed = places.select(F.concat(F.lpad(F.col("n").cast("string"), 20, "0"), F.lit(" "), F.col("passage_id")).alias("at"))
    n = F.substr("at", F.lit(1), F.lit(20)).cast("long")
    placed = cut_lineage(dense_index(keyed, "at", "pos").select(F.substr("at", F.lit(22)).alias("passage_id"), n.alias("n"), bucket_of(n, bucket).alias("bucket"), "pos"))
    following = placed.select(F.col("passage_id").alias("next_id"), "bucket", (F.col("pos") - 1).alias("pos"))
    return placed.join(following, ["pos", "bucket"], "left").select("passage_id", "n", "next_id", "bucket")


def place_edges(places: DataFrame) -> DataFrame:
    """Edges of weight 1 between the passages of ``linked_places`` and from the last of each bucket to the first of the next bucket present."""
    one = F.lit(1.0).alias("weight")
    inside = places.where("next_id IS NOT NULL").select(F.col("passage_id").alias("src"), F.col("next_id").alias("dst"), one)
    ends = places.groupBy("bucket").agg(F.min(F.struct("n", "passage_id")).alias("first"), F.max(F.struct("n", "passage_id")).alias("last"))
    ends = cut_lineage(ends)
    placed = cut_lineage(ends.join(dense_index(ends, "bucket", "pos"), "bucket"))
    following = placed.select(F.col("first.passage_id").alias("dst"), (F.col("pos") - 1).alias("pos"))
    return inside.union(placed.join(following, "pos").select(F.col("last.passage_id").alias("src"), "dst", one))


def graph_nodes(entities: DataFrame, passages: DataFrame) -> DataFrame:
    """Entity and passage nodes, each id once; stored entities without edges stay."""
    e = entities.select(content_key(F.col("entity"), "entity-").alias("id"), F.col("entity").alias("content"), F.lit("entity").alias("kind"))
    return e.unionByName(passages.select(F.col("passage_id").alias("id"), F.col("text").alias("content"), F.lit("passage").alias("kind"))).dropDuplicates(["id"])


def graph_edges(mentions: DataFrame | None, passages: DataFrame) -> DataFrame:
    """All edges without loops; rebuilt as a whole, so repeated runs do not add up. Without mentions those of the stand-in recogniser."""
    return (passage_edges(passages) if mentions is None else mention_edges(mentions, passages)).union(adjacency_edges(passages)).where("src <> dst AND weight IS NOT NULL")


def degrees(edges: DataFrame) -> DataFrame:
    """Number of edges and weighted degree of every node, over both directions."""
    both = edges.select(F.explode(F.array("src", "dst")).alias("id"), "weight")
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))
