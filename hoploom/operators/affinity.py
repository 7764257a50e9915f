"""Alias affinity between entities: blocking, hybrid scores, symmetric table."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexical import jaro_winkler
from ..functions.scores import hybrid_affinity
from ..functions.vector import cosine, l2_normalize
from ..session import cut_lineage
from .batches import list_arrays
from .dense import nearest_cells, packed_rows, query_blocks, top_k_joined, top_k_of_blocks
from .inverted_file import InvertedFile
from .masking import fit_clusters


def unit_items(entities: DataFrame) -> DataFrame:
    """Entities (entity_idx, vector) as items of length 1 (iid, vector)."""
    return entities.select(F.col("entity_idx").alias("iid"), l2_normalize(F.col("vector")).alias("vector"))


def indexed_pairs(entities: DataFrame, index: InvertedFile, k: int = 10, probes: int = 4) -> DataFrame:
    """As ``candidate_pairs``, with the nearest from an inverted file of ``unit_items``: an entity meets those of ``probes`` cells."""
    near = index.search(unit_items(entities).withColumnRenamed("iid", "qid"), k, probes)
    return near.where("qid <> iid").select(F.least("qid", "iid").alias("i"), F.greatest("qid", "iid").alias("j")).distinct()


def candidate_pairs(entities: DataFrame, k: int = 10, cells: int | None = None, probes: int = 4, sample: int = 100_000) -> DataFrame:
    """(i, j), i < j: each entity with its k nearest by cosine, itself among them.

    With k entities or fewer, all pairs. ``entities`` has entity_idx and vector. The
    exact way compares all pairs; with ``cells`` an entity meets only those of the
    ``probes`` cells nearest to it, for tables where all pairs are too many. The cells are
    fitted to about ``sample`` rows at most; every entity is in one. ``indexed_pairs`` keeps them.
    """
    if not cells:
        return compared_pairs(entities, k).select("i", "j")
    unit = entities.select("entity_idx", l2_normalize(F.col("vector")).alias("vector"))
    asked, among = unit.select(F.col("entity_idx").alias("qid"), "vector"), unit.select(F.col("entity_idx").alias("iid"), "vector")
    share = min(1.0, sample / max(1, unit.count()))
    chosen = unit.where((F.pmod(F.xxhash64("entity_idx"), F.lit(1 << 30)) < int(share * (1 << 30))) & F.col("vector").isNotNull())
    centroids, _ = fit_clusters(chosen.withColumnRenamed("entity_idx", "prop_idx"), cells, max_iter=20, starts=1)
    among = nearest_cells(among, centroids, 1).withColumn("cell", F.col("cells")[0]).drop("cells")
    near = top_k_joined(nearest_cells(asked, centroids, probes), among, k)
    return near.where("qid <> iid").select(F.least("qid", "iid").alias("i"), F.greatest("qid", "iid").alias("j")).distinct()


def compared_pairs(entities: DataFrame, k: int = 10) -> DataFrame:
    """The exact ``candidate_pairs`` with their ``cosine``, which all pairs' comparison knows: no vector has to be joined to a pair."""
    rows = packed_rows(entities.select(F.col("entity_idx").alias("id"), "vector"))
    near = top_k_of_blocks(rows, rows, k, unit=True)
    pairs = near.where("qid <> iid").select(F.least("qid", "iid").alias("i"), F.greatest("qid", "iid").alias("j"), "cosine")
    return pairs.groupBy("i", "j").agg(F.max("cosine").alias("cosine"))


def score_pairs(pairs: DataFrame, entities: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(i, j, score) of candidate pairs; ``entities`` has entity_idx, name and, unless the pairs have their ``cosine``, vector."""
    known = "cosine" in pairs.columns
    a, b = (entities.select(F.col("entity_idx").alias(k), F.col("name").alias(f"name_{k}"), *([] if known else [F.col("vector").alias(f"vector_{k}")])) for k in "ij")
    both = pairs.join(a, "i").join(b, "j")
    near = F.col("cosine") if known else cosine(F.col("vector_i"), F.col("vector_j"))
    return both.select("i", "j", hybrid_affinity(jaro_winkler(F.col("name_i"), F.col("name_j")), near, alpha).alias("score"))


def symmetric(scored: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs at or above the threshold, in both directions."""
    ways = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return scored.where(F.col("score") >= threshold).select(ways.alias("p"), "score").select("p.*", "score")


def spread(scores: DataFrame, affinity: DataFrame, factor: float) -> DataFrame:
    """factor * A x for (qid, entity_idx, score)."""
    return scores.join(affinity, scores["entity_idx"] == affinity["j"]).groupBy("qid", F.col("i").alias("entity_idx")).agg((F.sum(scores["score"] * affinity["score"]) * factor).alias("score"))


def apply_affinity(scores: DataFrame, affinity: DataFrame, factor: float) -> DataFrame:
    """x + factor * A x; entities that only aliases reach are included."""
    return scores.select("qid", "entity_idx", "score").unionByName(spread(scores, affinity, factor)).groupBy("qid", "entity_idx").agg(F.sum("score").alias("score"))


def apply_to_products(queries: DataFrame, items: DataFrame, affinity: DataFrame, factor: float, block: int = 1024) -> DataFrame:
    """``apply_affinity`` for x = the products of all queries (qid, vector) with all items (iid, vector), but not below 0.

    The products are not stored: every item is brought together with its aliases' vectors once, and for
    about ``block`` queries at a time a map over these rows makes and adds the products. ``iid`` is a whole number.
    """
    usable = items.where("iid IS NOT NULL AND vector IS NOT NULL").select(F.col("iid").alias("entity_idx"), "vector")
    near = affinity.join(usable, affinity["j"] == usable["entity_idx"]).select(F.col("i").alias("entity_idx"), (F.col("score") * factor).alias("weight"), "vector")
    together = usable.select("entity_idx", F.lit(1.0).alias("weight"), "vector").unionByName(near)
    rows = cut_lineage(together.repartition("entity_idx").sortWithinPartitions("entity_idx"))
    schema = f"qid {dict(queries.dtypes)['qid']}, entity_idx long, score double"
    parts = []
    for (ids,), matrix in query_blocks(queries, ["qid"], block):
        shared = queries.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches, shared=shared):
            import pyarrow as pa

            ids, matrix = shared.value
            asked = pa.array(ids.tolist())

            def told(names: np.ndarray, sums: np.ndarray):
                n = len(names)
                at = pa.array(np.repeat(np.arange(len(ids)), n))
                return pa.RecordBatch.from_arrays([asked.take(at), pa.array(np.tile(names, len(ids))), pa.array(sums.T.ravel() + 0.0)], names=["qid", "entity_idx", "score"])

            last = None  # an item's rows may go on in the next slice
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    part = batch.slice(start, 512)
                    names = part.column("entity_idx").to_numpy().astype(np.int64)
                    x = list_arrays(part.column("vector"))[0].astype(np.float64).reshape(len(names), -1)
                    scores = np.maximum(x @ matrix.T, 0.0) * part.column("weight").to_numpy()[:, None]
                    starts = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
                    names, sums = names[starts], np.add.reduceat(scores, starts, axis=0)
                    if last is not None:
                        if last[0][0] == names[0]:
                            sums[0] += last[1][0]
                        else:
                            names, sums = np.append(last[0], names), np.concatenate([last[1], sums])
                    last = names[-1:], sums[-1:]
                    if len(names) > 1:
                        yield told(names[:-1], sums[:-1])
            if last is not None:
                yield told(*last)

        parts.append(rows.mapInArrow(run, schema))
    return reduce(DataFrame.union, parts) if parts else queries.sparkSession.createDataFrame([], schema)
