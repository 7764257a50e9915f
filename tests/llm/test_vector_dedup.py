import duckdb
import numpy as np

from hoploom.llm import vector_dedup as v
from hoploom.llm.graph import connected_components


def brute(rows, threshold):
    ok = []
    for i, label, e in rows:
        if i is None or label is None or e is None or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            continue
        x = np.array(e, dtype=np.float64)
        ok.append((i, label, x / np.linalg.norm(x)))
    links = {i: set() for i, *_ in rows}
    for k, (i, a, x) in enumerate(ok):
        for j, b, y in ok[k + 1 :]:
            if a == b and len(x) == len(y) and x @ y >= threshold:
                links[i].add(j)
                links[j].add(i)
    least = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least[i] = min(seen)
    return {i: (len(links[i]), least[i]) for i in links}


def make(rng):
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(25):
            centre = rng.standard_normal(16)
            for _ in range(rng.integers(1, 9)):
                rows.append((k, label, (centre + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.12])).astype(np.float32).tolist()))
                k += 1
    rows += [(k, 0, None), (k + 1, 0, [0.0] * 16), (k + 2, 0, [1.0] * 15 + [float("nan")]), (k + 3, 0, [1.0] * 15 + [None]), (k + 4, 0, []), (k + 5, 0, [1.0, 2.0]), (k + 6, 0, [2.0, 4.0]), (k + 7, 1, [float("inf")] * 16), (k + 8, 0, rows[0][2]), (k + 9, 0, [x * 3 for x in rows[0][2]])]
    return rows


def test_against_brute_force(spark):
    rows = make(np.random.default_rng(1))
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, rep string").repartition(3)
    want = brute(rows, 0.98)
    for block in (512, 3):
        got = v.near_duplicates(df, recall=0.999999, block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_links, r.component_id) == want[r.vec_id], (block, r)
            assert r.kept == (r.vec_id == r.component_id)
    assert v.near_duplicates(df.limit(0)).count() == 0


def test_sql_against_brute_force():
    rows = make(np.random.default_rng(2))
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [(i, e, label) for i, label, e in rows])
    want = brute(rows, 0.98)
    for vec_id, n_links, component_id, _ in con.execute(v.OP7_SQL).fetchall():
        assert (n_links, component_id) == want[vec_id]


def test_collision_probability():
    rng = np.random.default_rng(0)
    for distance in (0.2, 1.4):
        gaps = np.abs(rng.standard_normal(200_000)) * distance
        assert abs(np.mean(np.maximum(0, 1 - gaps / 2.0)) - v.collision(distance, 2.0)) < 0.01


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(200, 260)] + [(300, 301), (300, 301), (5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
