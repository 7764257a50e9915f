"""The engine's tables over the data directory, and the same tables as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import each, entity_sentences_of, mentions_of, passages_of
from ..functions.text import capitalised_words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, d: str) -> DataFrame:
    return passages_of(table(spark, d, "documents").select("doc_id", "text"))


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return mentions_of(passages(spark, d))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return entity_sentences_of(passages(spark, d))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def question_mentions(spark: SparkSession, d: str) -> DataFrame:
    return each(questions(spark, d), capitalised_words(F.col("text")), "mention", "qid")


def stand_in_vectors(spark: SparkSession, d: str, df: DataFrame, text: str, out: str = "vector") -> DataFrame:
    """Adds a vector of the embeddings table, chosen by the text's md5: the stand-in for an embedding model."""
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias(out))
    return df.withColumn("vec_id", stand_in_id(F.col(text), vectors.count())).join(vectors, "vec_id").drop("vec_id")


def stand_in_id(text: Column, n: int) -> Column:
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(8)), 16, 10).cast("long") % F.lit(max(1, n))


#: Fragments of WITH clauses.
SQL = {
    "passages": "passages AS (SELECT doc_id AS idx, concat(CAST(doc_id AS VARCHAR), ':', coalesce(text, '')) AS text, 'passage-' || md5(concat(CAST(doc_id AS VARCHAR), ':', coalesce(text, ''))) AS passage_id FROM documents)",
    "mentions": "mentions AS (SELECT DISTINCT passage_id, unnest(list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{3,}'))) AS entity FROM passages)",
    "pairs": r"""sentences AS (SELECT DISTINCT sentence FROM (SELECT unnest(regexp_split_to_array(text, '[.!?]+\s+|\n')) AS sentence FROM passages) WHERE sentence <> ''),
pairs AS (SELECT DISTINCT sentence, unnest(list_filter(regexp_split_to_array(sentence, '[^A-Za-z]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{3,}'))) AS entity FROM sentences)""",
    "vectors": "vectors AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vector FROM embeddings), n_vectors AS (SELECT count(*) AS n FROM embeddings)",
    "questions": "questions AS (SELECT item_id AS qid, text FROM benchmark)",
    "question_mentions": "question_mentions AS (SELECT DISTINCT qid, unnest(list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{3,}'))) AS mention FROM questions)",
}


def stand_in_sql(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % (SELECT n FROM n_vectors))"


def with_(*names: str, more: str = "") -> str:
    return "WITH " + ",\n".join([SQL[n] for n in names] + ([more] if more else [])) + "\n"
