"""Queries against their SQL on the smallest tables, and the driver's contract."""

import os

import pytest

import __spark_entry__ as entry_point
from hoploom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = [
    "content_hash_ids", "dedup_by_hash", "insert_if_missing", "new_passages", "ner_merge_override", "entity_index", "mentions", "inverted_index", "edge_weights", "adjacency_edges",
    "graph_nodes", "graph_edges_batches", "sparsity_stats", "dense_topk", "minmax_scores", "seed_entities", "parse_propositions", "parse_subquestions", "incidence", "props_with_entity", "affinity_symmetric",
    "cluster_mask", "adaptive_mask", "attention_weights", "propagate_1hop", "parse_answer", "normalize_answer", "contain_accuracy", "judge_accuracy",
]

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def sql():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@needs_data
@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, sql, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), sql.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@needs_data
def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_contract():
    queries, sql = entry_point.queries(), entry_point.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50
    assert registry.FLAGSHIP in queries
