"""Incremental indexing as a stream: passages that arrive go into the engine's own index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.trigraph import TriGraphEngine


def read_passages(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of passages from Parquet files (idx, text) that arrive in a folder."""
    return spark.readStream.schema("idx long, text string").parquet(folder)


def add_batch(engine: TriGraphEngine, batch: DataFrame) -> None:
    """Indexes one batch with the engine's embedder and recogniser; a batch that is repeated after a failure adds nothing twice."""
    passages = batch.where("text IS NOT NULL").select(F.concat(F.coalesce(F.col("idx").cast("string"), F.lit("")), F.lit(":"), "text").alias("text"))
    if not passages.isEmpty():
        engine.index(passages)


def index_stream(passages: DataFrame, engine: TriGraphEngine, checkpoint: str):
    """Starts the stream; it stops when all that has arrived is indexed."""
    return passages.writeStream.foreachBatch(lambda batch, _: add_batch(engine, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
