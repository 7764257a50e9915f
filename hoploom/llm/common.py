"""Helpers that several operators of this package share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.batches import group_tables, list_arrays  # noqa: F401  (for the modules of this package)
from ..session import ensure_checkpoint_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data directory; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows that no model may learn from: crc32(id as text) mod 4 = 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def sample_by_hash(rows: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, label): at most ``per_class`` ids of each label, chosen by hash.

    Counts are combined before they are shuffled; a filter by hash then leaves about
    three times the wanted rows, so the ranking never sees a whole label. What is
    broadcast is one count a label: meant for labels of few values.
    """
    known = rows.select("doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    counts = known.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    chance = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    few = known.join(F.broadcast(counts), label).where(chance * F.col("_n") < 3 * per_class)
    ranked = W.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id")
    return few.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= per_class).select("doc_id", label)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores appended until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def arrow_slices(batches, rows: int, size: int = 2_000_000):
    """Arrow batches cut into slices of at most ``rows`` rows and about ``size`` bytes of text.

    What a task holds beside its batch is bounded by a slice, or by one row that is longer.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        width = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
                width += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(width)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + size, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop
