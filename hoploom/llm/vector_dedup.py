"""Near-duplicate vectors by Euclidean p-stable hashing.

Unit vectors are projected on Gaussian directions, shifted and quantised; k
projections make one table's bucket. On unit vectors a cosine of c is a
distance of sqrt(2 - 2c), so k and the number of tables follow from the wanted
recall at the threshold and from the largest label's size. Vectors that share a
bucket are compared by exact cosine in double precision.

Exact copies are one vector with a weight. A bucket of many vectors is dealt
into pairs of blocks; a pair of vectors that meets in several tables counts in
the first of them, so links are counted without listing them, and each block
returns one row a vector: its links and the least vector it hangs together
with.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and rows without label or id, link with nothing and are their own
component; rows repeated in full are copies; vectors of other dimensions never
link; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_slices, ensure_checkpoint_dir, group_tables, list_arrays, table
from .graph import connected_components, deal_blocks, local_roots


@dataclass(frozen=True)
class HashPlan:
    """Projections per table, tables, and the width of a quantisation cell."""

    per_table: int
    tables: int
    width: float
    seed: int = 17


def collision(distance: float, width: float) -> float:
    """Probability that two vectors at this distance fall into one cell of one projection."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def plan_hashes(threshold: float, rows: int, recall: float = 0.9995, strangers: float = 20.0, width: float = 2.0) -> HashPlan:
    """Tables for the recall at the threshold; of ``rows`` orthogonal vectors about ``strangers`` share a bucket."""
    near, far = collision(math.sqrt(max(1e-9, 2 - 2 * threshold)), width), collision(math.sqrt(2), width)
    k = max(1, math.ceil(math.log(max(1.0, rows / strangers)) / -math.log(far)))
    return HashPlan(k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(near**k, 1 - 1e-12)))), width)


def bucket_ids(unit: np.ndarray, labels: np.ndarray, plan: HashPlan) -> np.ndarray:
    """64-bit bucket ids (rows, tables) of unit vectors; label, dimension and table are part of an id."""
    rng = np.random.default_rng((plan.seed, unit.shape[1]))
    directions = rng.standard_normal((unit.shape[1], plan.tables * plan.per_table))
    shifts = rng.uniform(0, plan.width, plan.tables * plan.per_table)
    cells = np.floor((unit @ directions + shifts) / plan.width).astype(np.int64).astype(np.uint64).reshape(len(unit), plan.tables, plan.per_table)
    key = np.arange(plan.tables, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + labels.astype(np.int64).astype(np.uint64)[:, None] + (np.uint64(unit.shape[1]) << np.uint64(40))
    for c in range(plan.per_table):
        key = (key ^ cells[:, :, c]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _unit_rows(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, dimensions) of a list column's rows at length 1 in double precision, shorter rows filled with zeros."""
    dims = np.diff(offsets)
    width = int(dims.max(initial=0))
    if (dims == width).all():
        x = values.astype(np.float64).reshape(len(dims), width)
    else:
        x = np.zeros((len(dims), width))
        x[np.repeat(np.arange(len(dims)), dims), np.arange(len(values)) - np.repeat(offsets[:-1], dims)] = values
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True), dims


def _hash_rows(plan: HashPlan):
    def run(batches):
        import pyarrow as pa

        for part in arrow_slices(batches, 2000):
            x, dims = _unit_rows(*list_arrays(part.column("embedding")))
            labels = part.column("label").to_numpy()
            buckets = np.zeros((len(x), plan.tables), dtype=np.int64)
            for d in np.unique(dims):
                own = dims == d
                buckets[own] = bucket_ids(x[own, :d], labels[own], plan)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * plan.tables), pa.array(buckets.ravel()))
            yield part.append_column("buckets", lists)

    return run


def _compare_blocks(threshold: float):
    def run(batches):
        import pyarrow as pa

        for whole, starts in group_tables(batches, ["at", "bucket", "lo", "hi"]):
            x, dims = _unit_rows(*list_arrays(whole.column("embedding")))
            buckets = list_arrays(whole.column("buckets"))[0].reshape(len(x), -1)
            label, mine, copies, reps, at_of, lo_of, hi_of = (whole.column(c).to_numpy() for c in ("label", "mine", "copies", "rep", "at", "lo", "hi"))
            found: list[list[np.ndarray]] = [[], [], []]
            for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if z - a < 2:
                    continue
                if lo_of[a] == hi_of[a]:
                    near = x[a:z] @ x[a:z].T >= threshold
                    if np.count_nonzero(near) <= z - a:  # each with itself
                        continue
                    i, j = np.nonzero(np.triu(near, 1))
                else:
                    left, right = np.flatnonzero(mine[a:z] == lo_of[a]), np.flatnonzero(mine[a:z] == hi_of[a])
                    i, j = np.nonzero(x[a + left] @ x[a + right].T >= threshold)
                    i, j = left[i], right[j]
                keep = (label[a + i] == label[a + j]) & (dims[a + i] == dims[a + j])
                i, j = i[keep], j[keep]
                for b in range(at_of[a]):  # a pair counts in the first bucket that it shares
                    first = buckets[a + i, b] != buckets[a + j, b]
                    i, j = i[first], j[first]
                if not len(i):
                    continue
                n, weight = z - a, copies[a:z]
                links = np.bincount(i, weights=weight[j], minlength=n) + np.bincount(j, weights=weight[i], minlength=n)
                # Rows come in order of rep, so the least index is the least rep.
                told = np.union1d(i, j)
                for column, values in zip(found, (reps[a + told], links[told].astype(np.int64), reps[a + local_roots(n, i, j)[told]]), strict=True):
                    column.append(values)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in found], names=["rep", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.9995, block: int = 512, plan: HashPlan | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, label, embedding)."""
    ensure_checkpoint_dir(vectors.sparkSession)
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    # Two hashes of the vector and its label are the key of exact copies.
    keyed = rows.where(usable).withColumn("h1", F.xxhash64("label", "embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding", "label"))
    copies = keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    if plan is None:
        largest = rows.where(usable).groupBy("label").count().agg(F.max("count")).first()[0] or 0
        plan = plan_hashes(threshold, largest, recall)
    singles = keyed.select(F.col("vec_id").alias("rep"), "label", "embedding", "h1", "h2").join(copies, ["h1", "h2", "rep"]).dropDuplicates(["h1", "h2"]).drop("h1", "h2")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in singles.schema.fields), "buckets array<long>"])
    hashed = singles.mapInArrow(_hash_rows(plan), schema).checkpoint()
    spots = hashed.select("rep", F.posexplode("buckets").alias("at", "bucket"))
    crowded = spots.groupBy("at", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    places = deal_blocks(spots.join(crowded, ["at", "bucket"]), "rep", "n", block)
    dealt = places.join(hashed, "rep").select("at", "bucket", "lo", "hi", "mine", "rep", "copies", "label", "embedding", "buckets")
    found = dealt.repartition("at", "bucket", "lo", "hi").sortWithinPartitions("at", "bucket", "lo", "hi", "rep").mapInArrow(_compare_blocks(threshold), "rep long, links long, root long")
    found = found.groupBy("rep", "root").agg(F.sum("links").alias("links")).checkpoint()
    components = connected_components(found.select(F.col("root").alias("src"), F.col("rep").alias("dst"))).withColumnRenamed("node", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    member = keyed.select("vec_id", "h1", "h2").join(copies, ["h1", "h2"]).join(links, "rep", "left").join(components, "rep", "left")
    linked = member.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors within their labels, at a cosine of 0.98."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: Every pair within a label; too slow on large tables, right on all.
OP7_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), least AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(l.n_links, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
  coalesce(e.vec_id = coalesce(c.component_id, e.vec_id), false) AS kept
FROM embeddings e LEFT JOIN links l ON l.a = e.vec_id LEFT JOIN least c ON c.a = e.vec_id
"""
