"""Proposition clusters and the masks that guidance vectors put on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vector import scaled
from .dense import all_scores


def first_centroids(vectors: DataFrame, num_clusters: int, starts: int, seed: int) -> DataFrame:
    """(start, cluster_id, centroid): for each start ``num_clusters`` of the vectors, the first by md5 of seed, start and prop_idx."""
    drawn = vectors.where(F.col("vector").isNotNull()).withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))
    order = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("start").cast("string"), F.col("prop_idx").cast("string")))
    ranked = drawn.withColumn("r", F.row_number().over(W.partitionBy("start").orderBy(order, "prop_idx"))).where(F.col("r") <= num_clusters)
    return ranked.select("start", (F.col("r") - 1).alias("cluster_id"), F.col("vector").cast("array<double>").alias("centroid"))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance without |x|^2) of the nearest centroid; ties to the first."""
    gaps = np.round((centroids**2).sum(axis=1)[None, :] - 2 * x @ centroids.T, 9)
    best = gaps.argmin(axis=1)
    return best, gaps[np.arange(len(x)), best]


def lloyd(vectors: DataFrame, first: DataFrame, max_iter: int = 300) -> tuple[DataFrame, DataFrame]:
    """(centroids, prop_cluster) by Lloyd's steps from the ``first`` centroids of several starts, of the start with the least inertia.

    ``vectors`` has prop_idx and vector, ``first`` start, cluster_id and centroid. All starts
    take a step in one pass: a task sends back, for each start and cluster, the sum
    and the number of its vectors, so what is shuffled and what passes the driver is
    bounded by starts times clusters. An empty cluster keeps its centroid. Steps end when no
    centroid moves by 1e-9, or after ``max_iter``; the assignment is to the centroids returned.
    """
    spark = vectors.sparkSession
    data = vectors.where(F.col("vector").isNotNull()).select("prop_idx", F.col("vector").cast("array<double>").alias("vector"))
    rows = first.orderBy("start", "cluster_id").collect()
    if not rows:
        return spark.createDataFrame([], "cluster_id int, centroid array<double>"), data.select("prop_idx", F.lit(0).alias("cluster_id"))
    starts: dict[int, np.ndarray] = {}
    for r in rows:
        starts.setdefault(r.start, []).append(r.centroid)
    starts = {s: np.array(c, dtype=np.float64) for s, c in starts.items()}

    def step(current: dict[int, np.ndarray]):
        shared = spark.sparkContext.broadcast(current)

        def run(batches):
            import pyarrow as pa

            held = {s: (np.zeros(c.shape), np.zeros(len(c), dtype=np.int64), 0.0) for s, c in shared.value.items()}
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    x = np.array(batch.column("vector").slice(at, 4096).to_pylist(), dtype=np.float64)
                    length = (x * x).sum(axis=1)
                    for s, c in shared.value.items():
                        best, gap = _nearest(x, c)
                        sums, counts, inertia = held[s]
                        np.add.at(sums, best, x)
                        held[s] = (sums, counts + np.bincount(best, minlength=len(c)), inertia + float((gap + length).sum()))
            keys = [(s, k) for s, c in shared.value.items() for k in range(len(c))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in keys], pa.int32()), pa.array([k for _, k in keys], pa.int32()), pa.array([held[s][0][k].tolist() for s, k in keys], pa.list_(pa.float64())), pa.array([int(held[s][1][k]) for s, k in keys], pa.int64()), pa.array([held[s][2] if k == 0 else 0.0 for s, k in keys])],
                names=["start", "cluster_id", "sums", "n", "inertia"],
            )

        parts = data.select("vector").mapInArrow(run, "start int, cluster_id int, sums array<double>, n long, inertia double")
        added = parts.select("start", "cluster_id", "n", "inertia", F.posexplode("sums").alias("d", "x")).groupBy("start", "cluster_id", "d").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("inertia").alias("inertia"))
        moved, inertia = {s: c.copy() for s, c in current.items()}, dict.fromkeys(current, 0.0)
        for r in added.toLocalIterator():
            if r.n:
                moved[r.start][r.cluster_id][r.d] = r.x / r.n
            inertia[r.start] += r.inertia if r.d == 0 else 0.0
        return moved, inertia

    for _ in range(max_iter):
        moved, _ = step(starts)
        still = all(np.abs(moved[s] - c).max() <= 1e-9 for s, c in starts.items())
        starts = moved
        if still:
            break
    _, inertia = step(starts)
    best = min(starts, key=lambda s: (round(inertia[s], 6), s))
    chosen = spark.sparkContext.broadcast(starts[best])

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                cluster, _ = _nearest(np.array(batch.column("vector").to_pylist(), dtype=np.float64), chosen.value)
                yield pa.RecordBatch.from_arrays([batch.column("prop_idx"), pa.array(cluster, pa.int32())], names=["prop_idx", "cluster_id"])

    centroids = spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(starts[best])], "cluster_id int, centroid array<double>")
    return centroids, data.mapInArrow(assign, f"prop_idx {dict(data.dtypes)['prop_idx']}, cluster_id int")


def fit_clusters(vectors: DataFrame, num_clusters: int = 100, seed: int = 42, max_iter: int = 300, starts: int = 10) -> tuple[DataFrame, DataFrame]:
    """(centroids, prop_cluster) by k-means, the best of several starts; ``vectors`` has prop_idx and vector.

    There are as many clusters as rows at most. Centroids go through the driver; they are
    ``num_clusters`` vectors a start.
    """
    return lloyd(vectors, first_centroids(vectors, num_clusters, starts, seed), max_iter)


def centroids_of(labelled: DataFrame) -> DataFrame:
    """Mean vector per cluster_id."""
    parts = labelled.select("cluster_id", F.posexplode(F.col("vector").cast("array<double>")).alias("d", "x"))
    means = parts.groupBy("cluster_id", "d").agg(F.avg("x").alias("x"))
    return means.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("centroid"))


def top_clusters(guidance: DataFrame, centroids: DataFrame, top_p: int | str = 10) -> DataFrame:
    """(qid, hop, cluster_id, sim) of the ``top_p`` clusters nearest to each guidance vector by cosine.

    ``top_p`` may name a column of ``guidance``.
    """
    wanted = F.col(top_p) if isinstance(top_p, str) else F.lit(top_p)
    queries = guidance.select("qid", "hop", wanted.alias("wanted"), scaled(F.col("vector")).alias("vector"))
    cosines = all_scores(queries, centroids.select(F.col("cluster_id").alias("iid"), scaled(F.col("centroid")).alias("vector")), keys=("qid", "hop", "wanted"))
    scored = cosines.select("qid", "hop", "wanted", F.col("iid").alias("cluster_id"), F.round("score", 9).alias("sim"))
    ranked = W.partitionBy("qid", "hop").orderBy(F.desc("sim"), "cluster_id")
    return scored.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= F.col("wanted")).select("qid", "hop", "cluster_id", "sim")


def mask(clusters: DataFrame, prop_cluster: DataFrame) -> DataFrame:
    """(qid, hop, prop_idx) of the propositions in the chosen clusters."""
    return clusters.select("qid", "hop", "cluster_id").join(prop_cluster, "cluster_id").select("qid", "hop", "prop_idx")


def mask_stats(kept: DataFrame, propositions: DataFrame) -> DataFrame:
    """(qid, hop, kept, reduction): how many propositions a mask lets pass, and the share in percent that it spares."""
    total = propositions.count()
    return kept.groupBy("qid", "hop").agg(F.count(F.lit(1)).alias("kept")).withColumn("reduction", (1 - F.col("kept") / F.lit(max(1, total))) * 100)


def cluster_sizes(prop_cluster: DataFrame) -> DataFrame:
    """Least, largest and mean cluster size."""
    return prop_cluster.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.avg("n").alias("mean_size"))
