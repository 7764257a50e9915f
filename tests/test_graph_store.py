"""A graph that grows by batches equals the graph of all passages, whatever the batches and whatever failed between."""

import random

import pytest
from pyspark.sql import functions as F

from hoploom.operators.graph import graph_edges, graph_nodes, mentions_of
from hoploom.plans.graph_store import GraphStore
from hoploom.schemas import EDGES, NODES, PLACES
from hoploom.sources.catalog import IndexCatalog

WORDS = ["Warsaw", "Paris", "Seine", "Curie", "plain", "words", "Poland"]


@pytest.fixture(scope="module")
def passages(spark):
    rng = random.Random(3)
    # Two passages of one index, gaps, empty texts, and passages without an index.
    indices = [0, 1, 2, 2, 5, 9, 10, 11, 30, 31, 32, 10**12]
    texts = [f"{n}:{' '.join(rng.choices(WORDS, k=rng.randint(2, 6)))} {k}" for k, n in enumerate(indices)] + ["40:", "no index Paris", "41:plain words"]
    return spark.createDataFrame([(f"passage-{rng.getrandbits(64):016x}", t) for t in texts], "passage_id string, text string").checkpoint()


def found_in(passages):
    return mentions_of(passages).withColumn("sentence", F.lit("s"))


def rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def store_at(spark, path):
    return GraphStore(IndexCatalog(spark, str(path)), bucket=4)


def test_batches_equal_the_whole(spark, tmp_path, passages):
    store = store_at(spark, tmp_path)
    for rest in ("crc32(passage_id) % 3 = 0", "crc32(passage_id) % 3 <= 1", "true", "true"):
        batch = passages.where(rest)
        store.add(batch.union(batch), found_in(batch))
    assert rows(store.edges()) == rows(graph_edges(mentions_of(passages), passages))
    assert rows(store.catalog.read("nodes", NODES)) == rows(graph_nodes(mentions_of(passages).select("entity").distinct(), passages))
    assert store.catalog.read("places", PLACES).count() == 14


def test_a_batch_writes_its_own_buckets_only(spark, tmp_path, passages):
    store = store_at(spark, tmp_path)
    last = passages.where("text like '31:%'")
    first = passages.join(last.select("passage_id"), "passage_id", "left_anti")
    store.add(first, found_in(first))
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    n_edges = store.catalog.read("edges", EDGES).count()
    store.add(passages, found_in(passages))
    changed = {p for p in files if not p.exists() or p.stat().st_mtime_ns != files[p]}
    assert changed and {p.parent.name for p in changed} == {"bucket=7"}  # 28 to 31
    assert store.catalog.read("edges", EDGES).count() - n_edges <= 4
    assert rows(store.edges()) == rows(graph_edges(mentions_of(passages), passages))


def test_a_failed_batch_is_done_again(spark, tmp_path, passages, monkeypatch):
    store = store_at(spark, tmp_path)
    append = IndexCatalog.append

    def fails_last(self, name, df):
        if name == "edges":
            raise OSError("lost")
        append(self, name, df)

    monkeypatch.setattr(IndexCatalog, "append", fails_last)
    with pytest.raises(OSError):
        store.add(passages, found_in(passages))
    monkeypatch.undo()
    store.add(passages, found_in(passages))
    assert rows(store.edges()) == rows(graph_edges(mentions_of(passages), passages))
    nodes = store.catalog.read("nodes", NODES)
    assert nodes.count() == nodes.select("id").distinct().count()


def test_nothing_to_add(spark, tmp_path, passages):
    store = store_at(spark, tmp_path)
    store.add(passages.limit(0), found_in(passages.limit(0)))
    assert not store.catalog.exists("edges")
    bare = spark.createDataFrame([("passage-a", "without an index")], "passage_id string, text string")
    store.add(bare, found_in(bare))
    store.add(bare, found_in(bare))
    assert store.edges().count() == 0 and store.catalog.read("edges", EDGES).count() == 1
