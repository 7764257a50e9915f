"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from hoploom.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("conversations", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = [sorted(str(tuple(None if pd.isna(x) else int(x) if isinstance(x, (float, np.integer)) and x == int(x) else x for x in r)) for r in frame[columns].itertuples(index=False, name=None)) for frame in (got, want)]
    assert plain[0] == plain[1]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    language = QUERIES["op8_language_id"](spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert language.where("lang = lang_pred").count() >= 0.95 * language.count() > 0
    clean = QUERIES["op6_toxicity"](spark, DATA).join(labels, "doc_id").where("toxic = 0")
    assert clean.where("predicted = 1").count() <= 0.05 * clean.count()
