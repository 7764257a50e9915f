"""The entity-passage graph as tables that grow by batches.

An entity's edges to a passage depend on that passage alone, so a batch appends
its own. Neighbouring passages are kept in buckets of indices; a batch rewrites
the buckets that it falls into, and the links from one bucket to the next are
made from the buckets' ends when the edges are read. What a batch writes is thus
in proportion to the batch and its buckets, not to the graph.

``edges`` is written last: a passage that is in it is done. A batch that failed
before is done again by the next call, and what it had written already is not
written twice. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import BUCKET, bucket_of, graph_nodes, linked_places, mention_edges, place_edges
from ..functions.text import passage_index
from ..schemas import EDGES, ENTITY_SENTENCE, NODES, PLACES
from ..session import cut_lineage
from ..sources.catalog import IndexCatalog


class GraphStore:
    """Tables ``edges``, ``places``, ``nodes`` and ``entity_sentence`` of a catalog.

    ``bucket`` indices share a folder of ``places``; where indices are sparse it should be larger. It has to stay the same.
    """

    def __init__(self, catalog: IndexCatalog, bucket: int = BUCKET):
        self.catalog, self.bucket = catalog, bucket

    def add(self, passages: DataFrame, found: DataFrame) -> None:
        """Adds those of ``passages`` (passage_id, text) that are not in the graph, with what was recognised in them (passage_id, sentence, entity)."""
        done = self.catalog.read("edges", EDGES).select(F.col("dst").alias("passage_id"))
        ids = cut_lineage(passages.select("passage_id").distinct().join(done, "passage_id", "left_anti"))
        if ids.isEmpty():
            return
        new = passages.select("passage_id", "text").join(ids, "passage_id", "left_semi").dropDuplicates(["passage_id"])
        named = found.where("entity IS NOT NULL").join(ids, "passage_id", "left_semi")
        self._append("entity_sentence", named.select("entity", "sentence").where("sentence IS NOT NULL").distinct(), ENTITY_SENTENCE, ["entity", "sentence"])
        self._append("nodes", graph_nodes(named.select("entity").distinct(), new), NODES, ["id"])
        self._place(new.select("passage_id", passage_index(F.col("text")).alias("n")).where("n IS NOT NULL"))
        edges = mention_edges(named.select("passage_id", "entity").distinct(), new).where("src <> dst AND weight IS NOT NULL")
        # A passage without edges leaves a row of its own: it is done too.
        rows = ids.select(F.col("passage_id").alias("dst")).join(edges, "dst", "left").select("src", "dst", "weight")
        self.catalog.append("edges", rows)

    def _append(self, name: str, rows: DataFrame, schema: str, key: list[str]) -> None:
        stored = self.catalog.read(name, schema)
        self.catalog.append(name, rows.join(stored.select(*key), key, "left_anti").select(stored.columns))

    def _place(self, places: DataFrame) -> None:
        places = cut_lineage(places.withColumn("bucket", bucket_of(F.col("n"), self.bucket)))
        if places.isEmpty():
            return
        stored = self.catalog.read("places", PLACES).join(places.select("bucket").distinct(), "bucket", "left_semi")
        linked = linked_places(stored.select("passage_id", "n").union(places.select("passage_id", "n")), self.bucket)
        self.catalog.write_partitions("places", linked, "bucket", "passage_id")

    def edges(self) -> DataFrame:
        """(src, dst, weight): entity-passage edges and links of neighbouring passages."""
        named = self.catalog.read("edges").where("src IS NOT NULL").select("src", "dst", "weight")
        return named.union(place_edges(self.catalog.read("places", PLACES)))
