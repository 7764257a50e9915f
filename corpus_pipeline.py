"""From documents to packed training sequences: language, toxicity, near-duplicates, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, all but the last with the columns of documents. ``run``
writes each stage's result as Parquet to the shared checkpoint folder and reads
it again, so a lost executor never costs more than a stage.

Defined results of the three filtering stages: a row that stays is returned with
all its columns unchanged, extra ones included, also those that have the name of a
result of an operator; rows with the same score are treated alike; very long
texts are judged whole; an empty table gives an empty one. Nulls and repeated
rows are in each stage's own docstring.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoploom.llm.common import ensure_checkpoint_dir, free_name, table
from hoploom.llm.language_id import UNKNOWN, fit_language_model, identify
from hoploom.llm.packing import pack_with_public_vocabulary
from hoploom.llm.text_join import row_keys, similar_texts
from hoploom.llm.toxicity import THRESHOLD, fit_toxicity, score_documents


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null and empty texts and texts without a letter.

    Rows with null ids or languages are judged like the others and not learned from; repeated rows all stay or all go.
    """
    pred = free_name(docs, "lang_pred")
    model = fit_language_model(docs.select("doc_id", "text", "lang"))
    return identify(docs, model).where(F.col(pred) != UNKNOWN).select(docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity reaches the threshold.

    Null and empty texts score 0 and stay, and so does everything if the labels do not have both kinds;
    rows with null ids are judged like the others; repeated rows all stay or all go.
    """
    score = free_name(docs, "toxic_score")
    model = fit_toxicity(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score_documents(docs, model).where(F.col(score) < THRESHOLD).select(docs.columns)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of every class of near-duplicates, once.

    A document is an id with its text: different texts of one id are told apart, and come after the other ids of
    their class; rows that repeat both are one document, of which one row stays. Rows without an id cannot be told
    apart and stay; null, empty and blank texts are in no class and stay.
    """
    keyed, key = row_keys(docs)
    found = similar_texts(keyed.select(F.col(key).alias("doc_id"), "text"))
    kept = keyed.join(found.where("kept").select(F.col("doc_id").alias(key)), key, "left_semi").dropDuplicates([key])
    return kept.select(docs.columns).unionByName(keyed.where(F.col(key).isNull()).select(docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; repeated rows are packed one by one, a null text is its end id alone."""
    return pack_with_public_vocabulary(docs)


STAGES = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each_class),
    ("packing", packed),
]

#: Learned models and a tokenizer: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    Stages that stand complete in ``folder`` are not run again; without one a new folder in the checkpoint folder
    is taken. A stage's input is deleted when its own result is written.
    """
    ensure_checkpoint_dir(spark)
    folder = folder or f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    files = path_of(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    results = [f"{folder}/{k}-{name}" for k, (name, _) in enumerate(STAGES)]
    done = max((k + 1 for k, result in enumerate(results) if files.exists(path_of(f"{result}/_SUCCESS"))), default=0)
    docs = spark.read.parquet(results[done - 1]) if done else table(spark, sf_dir, "documents")
    for k in range(done, len(STAGES)):
        STAGES[k][1](spark, docs, sf_dir).write.mode("overwrite").parquet(results[k])
        docs = spark.read.parquet(results[k])
        if k:
            files.delete(path_of(results[k - 1]), True)
    return docs
