import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hoploom.llm import whitening

KIND = "vec_id long, embedding array<float>"


def brute_force(rows, k=16):
    """{(id, component): (n, deviation, |whitened|, explained)} with whole numbers in Python and LAPACK."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted(set(tuple(x) for _, x in kept))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[float(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    out = {}
    for i, x in kept:
        dev = [n * a - s for a, s in zip(x, sums, strict=True)]
        for c in range(min(k, len(sums))):
            e = values[-1 - c]
            out[i, c + 1] = (n, sum(v * v for v in dev), abs(np.dot(np.array([v / n for v in dev]), vectors[:, -1 - c])) / math.sqrt(e), e / values.sum())
    return out


def results(spark, df):
    grid = whitening.on_grid(df)
    fitted = whitening.fit_whitening(grid)
    return fitted, {r.vec_id: (r.vec, r.deviation) for r in whitening.whiten(grid, fitted).collect()}


def test_eigen_solve():
    rng = np.random.default_rng(1)
    for a in (rng.standard_normal((n, n)) for n in (1, 2, 3, 17, 64)):
        a = a @ a.T
        values, vectors = whitening.symmetric_qr(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-11, atol=1e-11 * values[0])
        assert np.allclose(a @ vectors, vectors * values, atol=1e-11 * values[0]) and np.allclose(vectors.T @ vectors, np.eye(len(a)), atol=1e-12)
    for a in (np.zeros((3, 3)), np.eye(4), np.diag([1.0, 3.0, 3.0, 2.0]), np.ones((5, 5))):
        values, vectors = whitening.symmetric_qr(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12) and np.allclose(a @ vectors, vectors * values, atol=1e-12)


def test_merged_states_are_one_state():
    x = np.random.default_rng(2).integers(-50, 50, (400, 5)).astype(float)
    whole, parts = whitening.Moments.empty(5), whitening.Moments.empty(5)
    whole.add(x)
    for a, z in ((0, 1), (1, 1), (1, 250), (250, 400)):
        part = whitening.Moments.empty(5)
        part.add(x[a:z])
        parts.merge(part)
    assert parts.n == whole.n == 400 and np.allclose(parts.mean, whole.mean, atol=1e-12) and np.allclose(parts.products, whole.products, rtol=1e-12, atol=1e-9)
    assert np.allclose(whole.covariance(), np.cov(x.T, bias=True), rtol=1e-12)


@pytest.mark.parametrize("partitions", [1, 7])
def test_equals_brute_force(spark, partitions):
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((300, 20)) * np.linspace(0.2, 3, 20)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(1000 + i, x[0]) for i in range(100)] + [(1, x[1]), (-5, None), (-6, [None] * 20), (-7, [float("nan")] * 20), (-8, [float("inf")] + x[0][1:])]
    df = spark.createDataFrame(rows, KIND).withColumn("x", F.lit("other")).repartition(partitions)
    fitted, got = results(spark, df.select("vec_id", "embedding"))
    want = brute_force(rows)
    assert set(got) == {i for i, _ in want} and fitted.identity_error < 1e-9
    for (i, c), (n, dev, white, explained) in want.items():
        assert n == fitted.n and dev == got[i][1]
        assert abs(abs(got[i][0][c - 1]) - white) < 1e-8 and abs(fitted.values[c - 1] / fitted.trace - explained) < 1e-10


def test_edges(spark):
    assert whitening.fit_whitening(whitening.on_grid(spark.createDataFrame([(1, None), (2, [])], KIND))) is None
    fitted, got = results(spark, spark.createDataFrame([(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [0.5, 1.0])], KIND))
    assert fitted.n == 1 and all(v == ([0.0, 0.0], 0) for v in got.values()) and set(got) == {1, None} and fitted.identity_error == 0.0
    # A flat dimension, other numbers of dimensions, and entries whose deviation has no room in 64 bits.
    rows = [(1, [0.5, 1.0]), (2, [0.25, 1.0]), (3, [1.0]), (4, [1.0, 2.0, 3.0])]
    fitted, got = results(spark, spark.createDataFrame(rows, KIND))
    assert set(got) == {1, 2} and got[1][0][1] == 0.0 and abs(abs(got[1][0][0]) - 1) < 1e-12
    fitted, got = results(spark, spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])], KIND))
    assert got[1][1] is None and all(map(math.isfinite, got[1][0]))


def test_query_of_the_tables(spark):
    from hoploom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    try:
        df = spark.read.parquet(f"{folder}/embeddings.parquet")
    except Exception:
        pytest.skip("no tables here")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want, got = brute_force(rows), QUERIES["op12_whitening"](spark, folder).collect()
    assert len(got) == 16 * len(rows) and all(r.identity_error < 1e-9 for r in got)
    for r in got:
        n, dev, white, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, dev) and abs(abs(r.whitened) - white) < 1e-7 and abs(r.explained / explained - 1) < 1e-9
