"""An inverted-file index of vectors: a table of centroids, and the vectors in folders of their nearest centroid's cell.

The centroids are fitted once to a bounded sample; every vector is in the one cell
that is nearest to it. A search reads the cells nearest to its queries. Vectors are
appended to their cells; those that are stored already are left out, so an append
that is repeated after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import IndexCatalog
from .dense import nearest_cells, top_k_joined
from .masking import first_centroids, lloyd

CENTROIDS, CELLS = "cell_centroids", "cell_vectors"


class InvertedFile:
    """The index under one path of any store that Spark reads; vectors have iid and vector."""

    def __init__(self, spark: SparkSession, path: str):
        self.catalog = IndexCatalog(spark, path)

    @property
    def built(self) -> bool:
        return self.catalog.exists(f"{CENTROIDS}/_SUCCESS")

    def build(self, vectors: DataFrame, cells: int, sample: int = 100_000, seed: int = 42, steps: int = 8) -> None:
        """Fits ``cells`` centroids to about ``sample`` vectors chosen by the hash of their ids, and stores all vectors."""
        usable = vectors.where("iid IS NOT NULL AND vector IS NOT NULL")
        share = min(1.0, sample / max(1, usable.count()))
        chosen = usable.where(F.pmod(F.xxhash64("iid"), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col("iid").alias("prop_idx"), "vector")
        centroids, _ = lloyd(chosen, first_centroids(chosen, cells, 1, seed), steps)
        self.catalog.write(CENTROIDS, centroids)
        self.append(vectors)

    def append(self, vectors: DataFrame) -> None:
        """Adds vectors whose id is not stored yet."""
        new = vectors.where("iid IS NOT NULL AND vector IS NOT NULL").select("iid", F.col("vector").cast("array<double>").alias("vector")).dropDuplicates(["iid"])
        if self.catalog.exists(CELLS):
            new = new.join(self.catalog.read(CELLS).select("iid"), "iid", "left_anti")
        placed = nearest_cells(new, self.catalog.read(CENTROIDS), 1).withColumn("cell", F.col("cells")[0]).drop("cells")
        placed.repartition("cell", F.pmod(F.xxhash64("iid"), F.lit(16))).write.mode("append").partitionBy("cell").parquet(f"{self.catalog.path}/{CELLS}")

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(qid, iid, score, rank): the ``k`` items of the largest dot products among the ``probes`` cells nearest to each query (qid, vector)."""
        items = self.catalog.read(CELLS).select("iid", "vector", F.col("cell").cast("long").alias("cell"))
        return top_k_joined(nearest_cells(queries.select("qid", "vector"), self.catalog.read(CENTROIDS), probes), items, k)
