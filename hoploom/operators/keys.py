"""Content keys, dedup, incremental maintenance and dense indices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import content_key
from ..session import cut_lineage


def with_key(df: DataFrame, text_col: str, prefix: str, out: str = "hash_id") -> DataFrame:
    return df.withColumn(out, content_key(F.col(text_col), prefix))


def dedup_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first by ``order``. Minima of a struct are combined before the shuffle."""
    rest = [c for c in df.columns if c not in (key, order)]
    first = df.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_first"))
    return first.select(key, "_first.*").select(df.columns)


def missing(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet, one per key."""
    return new.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def merge_override(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Right-biased merge of two maps: a new key's rows replace the old ones (both hold one row per key and value)."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(key, value).union(new.select(key, value)).distinct()


def merge_union(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Union of two maps' sets."""
    return old.select(key, value).union(new.select(key, value)).distinct()


def dense_index(df: DataFrame, col: str, out: str) -> DataFrame:
    """Distinct values with their position in ascending order, from 0.

    The values are range-partitioned and sorted; only the partitions' sizes pass
    the driver. A window over all rows would put them into one task.
    """
    parts = df.select(col).where(F.col(col).isNotNull()).distinct().repartitionByRange(F.col(col)).withColumn("_part", F.spark_partition_id())
    parts = cut_lineage(parts)
    sizes = sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect())
    offset, pairs = 0, []
    for part, count in sizes:
        pairs += [F.lit(part), F.lit(offset).cast("long")]
        offset += count
    start = F.element_at(F.create_map(*pairs), F.col("_part")) if pairs else F.lit(0).cast("long")
    within = F.row_number().over(W.partitionBy("_part").orderBy(col))
    return parts.select(col, (start + within - 1).cast("long").alias(out))


def lookup(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is asked for."""
    return df.join(ids.select(key).distinct(), key, "left_semi")
