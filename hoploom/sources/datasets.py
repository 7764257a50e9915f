"""Readers and writers of question sets, chunk lists and predictions."""

from __future__ import annotations

import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import content_key, drop_index_prefix
from ..schemas import PREDICTIONS, QUESTIONS


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of question objects; absent fields are null."""
    return spark.read.schema(QUESTIONS).option("multiLine", True).json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(idx, text) of a JSON array of strings; the position is the index. Anything but strings in the array is an error.

    The file is read in splits, however long its lines are: records end at quotes. Whether a quote is escaped is seen
    from its own record, so the quotes before a record are a running count within its split and a sum over the splits
    before; between an odd quote and the next is text. A folder's files are counted one by one.
    """
    split, order = ["file", "split"], ["split", "at"]
    value = F.col("value")
    cuts = spark.read.option("lineSep", '"').text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value"
    )
    # An even number of backslashes before the quote: it is not escaped.
    cuts = cuts.withColumn("quote", 1 - (F.length(value) - F.length(F.rtrim(value, F.lit("\\")))) % 2)
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    starts = cuts.groupBy(*split).agg(F.sum("quote").alias("n")).select(*split, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.coalesce(F.sum("quote").over(W.partitionBy(*split).orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = cuts.withColumn("n", within).join(starts, split).withColumn("n", F.col("n") + F.col("start"))
    is_text = F.when(F.col("n") % 2 == 1, True).when(value.rlike(r"^[\s,\[\]\x{FEFF}]*$"), False).otherwise(F.raise_error(F.concat(F.lit("not an array of strings: "), F.col("file"))).cast("boolean"))
    parts = numbered.where(is_text).groupBy("file", F.floor(F.col("n") / 2).alias("idx")).agg(F.array_sort(F.collect_list(F.struct(*order, "value"))).alias("parts"))
    quoted = F.concat(F.lit('["'), F.array_join(F.transform("parts", lambda x: x["value"]), '"'), F.lit('"]'))
    return parts.select(F.col("idx").cast("long").alias("idx"), F.from_json(quoted, "array<string>")[0].alias("text"))


def chunks_of(passages: DataFrame) -> DataFrame:
    """(chunk_id, text) without the index prefix; equal chunks are one."""
    bare = passages.select(drop_index_prefix(F.col("text")).alias("text"))
    return bare.select(content_key(F.col("text"), "chunk_").alias("chunk_id"), "text").dropDuplicates(["chunk_id"])


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTIONS + ", verdict string, evidence array<string>, source_chunks array<string>, num_hops int").json(path)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes the graph as GraphML lines: a folder of parts that read as one document in order of their names.

    Nodes and edges are formatted where they are; nothing is gathered.
    """

    def text(col):
        for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            col = F.replace(col, F.lit(plain), F.lit(escaped))
        return col

    spark = nodes.sparkSession
    head = '<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="content" for="node" attr.name="content" attr.type="string"/><key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">'
    node = F.concat(F.lit('<node id="'), text(F.col("id")), F.lit('"><data key="content">'), text(F.coalesce("content", F.lit(""))), F.lit("</data></node>"))
    edge = F.concat(F.lit('<edge source="'), text(F.col("src")), F.lit('" target="'), text(F.col("dst")), F.lit('"><data key="weight">'), F.col("weight").cast("string"), F.lit("</data></edge>"))
    line = "value string"
    spark.createDataFrame([(head,)], line).coalesce(1).write.text(f"{path}/part=0")
    nodes.select(node.alias("value")).write.text(f"{path}/part=1")
    edges.select(edge.alias("value")).write.text(f"{path}/part=2")
    spark.createDataFrame([("</graph></graphml>",)], line).coalesce(1).write.text(f"{path}/part=3")


def setup_logging(path: str | None = None) -> logging.Logger:
    """Log to standard output and, if asked, to a file on the driver; chatty clients are quiet."""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(path, encoding="utf-8"))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s", handlers=handlers, force=True)
    for name in ("httpx", "openai", "py4j"):
        logging.getLogger(name).setLevel(logging.WARNING)
    return logging.getLogger("hoploom")
