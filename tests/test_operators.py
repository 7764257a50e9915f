import numpy as np
from pyspark.sql import functions as F

from hoploom.operators import activation, affinity, dense, evaluation, graph, keys, masking, pagerank, prior, propagation, propositions


def test_keys(spark):
    df = spark.createDataFrame([("b", 2), ("a", 5), ("b", 1), (None, 9)], "t string, k int")
    assert sorted((r.t, r.k) for r in keys.dedup_first(df.where("t IS NOT NULL"), "t", "k").collect()) == [("a", 5), ("b", 1)]
    assert sorted((r.t, r.i) for r in keys.dense_index(df, "t", "i").collect()) == [("a", 0), ("b", 1)]
    names = spark.createDataFrame([(f"n{k:03d}é" if k % 3 else f"N{k}",) for k in range(200)], "t string").repartition(7)
    want = {n: i for i, n in enumerate(sorted(r.t for r in names.collect()))}
    assert {r.t: r.i for r in keys.dense_index(names, "t", "i").collect()} == want
    assert keys.dense_index(names.limit(0), "t", "i").count() == 0
    assert [r.t for r in keys.missing(df.select("t").where("t IS NOT NULL"), spark.createDataFrame([("a",)], "t string"), "t").collect()] == ["b"]
    old = spark.createDataFrame([("s", "x"), ("s", "y"), ("t", "x")], "k string, v string")
    new = spark.createDataFrame([("s", "z")], "k string, v string")
    assert sorted(map(tuple, keys.merge_override(old, new, "k", "v").collect())) == [("s", "z"), ("t", "x")]
    assert sorted(map(tuple, keys.merge_union(old, new, "k", "v").collect())) == [("s", "x"), ("s", "y"), ("s", "z"), ("t", "x")]


def test_top_k_against_numpy(spark):
    rng = np.random.default_rng(0)
    items, queries = np.round(rng.standard_normal((90, 8)), 1), np.round(rng.standard_normal((11, 8)), 1)
    items[7] = items[50]
    di = spark.createDataFrame([(int(k), v.tolist()) for k, v in enumerate(items)] + [(None, [0.0] * 8), (500, None)], "iid long, vector array<double>").repartition(5)
    dq = spark.createDataFrame([(int(k), v.tolist()) for k, v in enumerate(queries)], "qid long, vector array<double>")
    for block in (4096, 3):
        got = {(r.qid, r["rank"]): r.iid for r in dense.top_k(dq, di, 4, block=block).collect()}
        for q in range(11):
            s = np.round(items @ queries[q], 9)
            assert [got[q, k + 1] for k in range(4)] == sorted(range(90), key=lambda i: (-s[i], i))[:4]
    assert dense.all_scores(dq, di, block=4).count() == 990
    assert dense.top_k(dq.limit(0), di, 2).count() == 0


def test_graph(spark):
    docs = spark.createDataFrame([(0, "Alpha met Beta and Alpha"), (1, "Beta alone"), (3, None), (4, "nobody")], "doc_id long, text string")
    p = graph.passages_of(docs)
    m = graph.mentions_of(p)
    weights = {(r.src, r.dst): r.weight for r in graph.mention_edges(m, p).collect()}
    first = p.where("idx = 0").first().passage_id
    by_name = {r.entity: r.k for r in m.select("entity", F.concat(F.lit("entity-"), F.md5("entity")).alias("k")).distinct().collect()}
    assert abs(weights[by_name["Alpha"], first] - 2 / 3) < 1e-12 and abs(weights[by_name["Beta"], first] - 1 / 3) < 1e-12
    ids = {r.idx: r.passage_id for r in p.collect()}
    assert sorted((r.src, r.dst) for r in graph.adjacency_edges(p).collect()) == sorted([(ids[0], ids[1]), (ids[1], ids[3]), (ids[3], ids[4])])
    no_index = spark.createDataFrame([("x", "no index")], "passage_id string, text string")
    assert graph.adjacency_edges(p.select("passage_id", "text").union(no_index)).count() == 3
    assert graph.graph_nodes(m.select("entity").distinct(), p).count() == 6
    labels = spark.createDataFrame([("a", "CARDINAL"), ("b", "PERSON"), ("c", None), ("d", "ORDINAL")], "entity string, label string")
    assert sorted(r.entity for r in graph.keep_labels(labels).collect()) == ["b", "c"]


def bfs(seeds, pairs, sim, iterations, k, theta):
    """The breadth-first walk written out for one question."""
    weights, active = dict(seeds), {e: (s, 1) for e, s in seeds.items()}
    used, current, t = set(), {e: seeds[e] for e in sorted(seeds)}, 1
    while current and t < iterations:
        new = {}
        for e, s in current.items():
            if s < theta:
                continue
            free = sorted((x for x in pairs if e in pairs[x] and x not in used), key=lambda x: (-round(sim[x], 9), x))
            for x in free[:k]:
                used.add(x)
                for to in sorted(pairs[x]):
                    gain = s * sim[x]
                    if gain >= theta:
                        weights[to] = weights.get(to, 0) + gain
                        new[to] = gain
        active |= {e: (s, t + 1) for e, s in new.items()}
        current, t = new, t + 1
    return weights, active


def vectorized(seeds, pairs, sim, iterations, k, theta):
    weights, active, used, current = dict(seeds), {e: (s, 0) for e, s in seeds.items()}, set(), dict(seeds)
    for t in range(1, iterations):
        current = {e: s for e, s in current.items() if s >= theta and s > 0}
        if not current:
            break
        chosen, lit = set(), {}
        for e in current:
            chosen |= set(sorted((x for x in pairs if e in pairs[x] and x not in used), key=lambda x: (-round(sim[x], 9), x))[:k])
        for x in chosen:
            lit[x] = sum(current.get(e, 0) for e in pairs[x]) * sim[x]
        used |= chosen
        following = {}
        for x, w in lit.items():
            if w > 0:
                for e in pairs[x]:
                    following[e] = following.get(e, 0) + w
        for e, s in following.items():
            weights[e] = weights.get(e, 0) + s
            if s >= theta:
                active[e] = (s, t)
        current = following
    return weights, active


def test_activation_against_plain_walks(spark):
    rng = np.random.default_rng(5)
    names = [f"E{k:02d}" for k in range(25)]
    pairs = {f"s{k:02d}": set(rng.choice(names, rng.integers(1, 5), replace=False).tolist()) for k in range(40)}
    df = spark.createDataFrame([(s, e) for s, es in pairs.items() for e in es], "sentence string, entity string")
    seeds, sims = {}, {}
    for q in range(6):
        seeds[q] = {e: round(float(rng.uniform(0.3, 1.1)), 3) for e in rng.choice(names, rng.integers(1, 5), replace=False).tolist()}
        sims[q] = {s: round(float(rng.uniform(-0.4, 1.0)), 4) for s in pairs}
    ds = spark.createDataFrame([(q, e, s) for q, m in seeds.items() for e, s in m.items()], "qid long, entity string, score double")
    table = spark.createDataFrame([(q, s, v) for q, m in sims.items() for s, v in m.items()], "qid long, sentence string, sim double")

    def similarity(rows):
        return rows.join(table, ["qid", "sentence"])

    for walk, plain in ((activation.activate_bfs, bfs), (activation.activate_vectorized, vectorized)):
        for k, iterations in ((1, 3), (2, 4)):
            weights, active = walk(ds, df, similarity, iterations, k, 0.2)
            got_w = {(r.qid, r.entity): r.weight for r in weights.collect()}
            got_a = {(r.qid, r.entity): (r.score, r.tier) for r in active.collect()}
            want_w, want_a = {}, {}
            for q in seeds:
                w, a = plain(seeds[q], pairs, sims[q], iterations, k, 0.2)
                want_w |= {(q, e): v for e, v in w.items()}
                want_a |= {(q, e): v for e, v in a.items()}
            assert got_w.keys() == want_w.keys() and all(abs(got_w[x] - want_w[x]) < 1e-9 for x in want_w), walk
            assert got_a.keys() == want_a.keys() and all(abs(got_a[x][0] - want_a[x][0]) < 1e-9 and got_a[x][1] == want_a[x][1] for x in want_a), walk


def test_seeds(spark):
    mentions = spark.createDataFrame([(1, "m", [1.0, 0.0]), (1, "n", [0.9, 0.1]), (2, "m", [1.0, 0.0])], "qid long, mention string, vector array<double>")
    entities = spark.createDataFrame([("z", [1.0, 0.0]), ("b", [1.0, 0.0]), ("y", [0.0, 1.0])], "entity string, vector array<double>")
    got = sorted((r.qid, r.entity, r.score) for r in activation.seed_entities(mentions, entities).collect())
    assert got == [(1, "b", 1.0), (2, "b", 1.0)]


def test_prior_counts(spark):
    p = spark.createDataFrame([("p1", "Aaaa and AA"), ("p2", "none")], "passage_id string, text string")
    needles = spark.createDataFrame([("aa",), ("and",), ("",)], "needle string")
    for block in (100, 1):
        assert sorted((r.passage_id, r.needle, r.n) for r in prior.occurrences(needles, p, block).collect()) == [("p1", "aa", 3), ("p1", "and", 1)]


def test_pagerank(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "src string, dst string, weight double")
    resets = spark.createDataFrame([(1, "a", 2.0), (1, "c", float("nan")), (1, "b", -1.0), (2, "alone", 1.0), (3, "a", 0.0)], "qid long, id string, weight double")
    got = {(r.qid, r.id): r.score for r in pagerank.personalized_pagerank(resets, edges, 0.5, 18).collect()}
    for node, want in (("a", 7 / 12), ("b", 1 / 3), ("c", 1 / 12)):
        assert abs(got[1, node] - want) < 1e-5
    assert abs(got[2, "alone"] - 1) < 1e-12 and not any(q == 3 for q, _ in got)
    rng = np.random.default_rng(2)
    n = 12
    w = np.triu(rng.uniform(0, 1, (n, n)) * (rng.uniform(0, 1, (n, n)) < 0.4), 1)
    w = w + w.T
    r = rng.uniform(0, 1, n)
    r /= r.sum()
    p = np.divide(w, w.sum(1, keepdims=True), out=np.zeros_like(w), where=w.sum(1, keepdims=True) > 0)
    p[w.sum(1) == 0] = r
    want = np.linalg.solve(np.eye(n) - 0.5 * p.T, 0.5 * r)
    e = spark.createDataFrame([(str(i), str(j), float(w[i, j])) for i in range(n) for j in range(i) if w[i, j]], "src string, dst string, weight double")
    d = spark.createDataFrame([(1, str(i), float(r[i])) for i in range(n)], "qid long, id string, weight double")
    scores = pagerank.personalized_pagerank(d, e, 0.5, 18, block=1)
    assert all(abs(x.score - want[int(x.id)]) < 1e-5 for x in scores.collect())
    top = pagerank.rank_passages(scores, spark.createDataFrame([("3",), ("5",), ("7",)], "passage_id string"), 2).orderBy("rank").collect()
    assert [x.passage_id for x in top] == sorted("357", key=lambda x: -want[int(x)])[:2]


def test_propositions(spark):
    replies = spark.createDataFrame([("c2", "1. Alpha met Beta.\nshort"), ("c1", "Alpha met Beta.\n2. Gamma is here"), ("c3", None)], "c string, r string")
    props = propositions.parse_propositions(replies, "c", "r")
    assert sorted((r.text, r.chunk_id) for r in props.collect()) == [("Alpha met Beta.", "c1"), ("Gamma is here", "c1")]
    subs = propositions.parse_subquestions(replies, "c", "r")
    assert sorted((r.qid, r.hop, r.text) for r in subs.collect()) == [("c1", 0, "Alpha met Beta."), ("c1", 1, "Gamma is here"), ("c2", 0, "Alpha met Beta."), ("c3", 0, "")]
    members = propositions.proposition_entities(props)
    inc, entities, index = propositions.incidence_of(members)
    assert {r.name: r.entity_idx for r in entities.collect()} == {"alpha": 0, "beta": 1, "gamma": 2}
    assert inc.count() == 3 and index.count() == 2
    asked = spark.createDataFrame([("ALPHA",), ("nobody",)], "name string")
    assert sorted((r.name, len(r.prop_ids)) for r in propositions.propositions_with(members, asked).collect()) == [("alpha", 1), ("nobody", 0)]
    unknown = spark.createDataFrame([("prop_x",)], "prop_id string")
    assert propositions.entities_in(members, unknown).first().names == []


def test_affinity(spark):
    rng = np.random.default_rng(4)
    for n in (6, 30):
        v = rng.standard_normal((n, 5))
        df = spark.createDataFrame([(k, f"name{k}", x.tolist()) for k, x in enumerate(v)], "entity_idx long, name string, vector array<double>")
        got = {(r.i, r.j) for r in affinity.candidate_pairs(df, 10).collect()}
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        near = np.argsort(-(u @ u.T), axis=1)[:, :10]
        assert got == {(min(i, int(j)), max(i, int(j))) for i in range(n) for j in near[i] if i != j}
        scored = affinity.score_pairs(affinity.candidate_pairs(df, 10), df)
        sym = {(r.i, r.j): r.score for r in affinity.symmetric(scored, 0.7).collect()}
        assert all(sym[j, i] == s and i != j and s >= 0.7 for (i, j), s in sym.items())
    x = spark.createDataFrame([(1, 0, 1.0)], "qid long, entity_idx long, score double")
    a = spark.createDataFrame([(0, 1, 0.8), (1, 0, 0.8)], "i long, j long, score double")
    assert {r.entity_idx: round(r.score, 9) for r in affinity.apply_affinity(x, a, 0.3).collect()} == {0: 1.0, 1: 0.24}


def test_propagation_against_numpy(spark):
    rng = np.random.default_rng(8)
    n, m, d = 9, 14, 6
    h = (rng.uniform(0, 1, (n, m)) < 0.3).astype(float)
    a = np.triu((rng.uniform(0, 1, (n, n)) < 0.15) * 0.8, 1)
    a = a + a.T
    props, centres, g = rng.standard_normal((m, d)), rng.standard_normal((4, d)), rng.standard_normal((3, d))
    cluster = rng.integers(0, 4, m)
    x0 = np.zeros(n)
    x0[[1, 4]] = 1.0

    def cos(x, y):
        return (x @ y) / ((np.linalg.norm(x, axis=-1) + 1e-8) * (np.linalg.norm(y) + 1e-8))

    x, hops = x0.copy(), 0
    for t in range(3):
        w = np.exp(cos(props, g[t]) / 0.1)
        w = w / (w.sum() + 1e-8) * m
        assert abs(w.mean() - 1) < 1e-6
        keep = np.isin(cluster, np.argsort(-cos(centres, g[t]))[:2])
        hm = h * keep
        new = hm @ (w * (hm.T @ x)) + 0.3 * a @ x
        new = new / new.max() if new.max() > 0 else new
        hops, diff, x = t + 1, np.linalg.norm(new - x), new
        if diff < 1e-4:
            break
    inc = spark.createDataFrame([(i, j, 1.0) for i in range(n) for j in range(m) if h[i, j]], "entity_idx long, prop_idx long, value double")
    aff = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(n) for j in range(n) if a[i, j]], "i long, j long, score double")
    state, took = propagation.propagate(
        spark.createDataFrame([(7, 1, 1.0), (7, 4, 1.0), (8, 0, 1.0)], "qid long, entity_idx long, score double"), inc,
        spark.createDataFrame([(j, props[j].tolist()) for j in range(m)], "prop_idx long, vector array<double>"),
        spark.createDataFrame([(7, t, g[t].tolist()) for t in range(3)], "qid long, hop int, vector array<double>"), aff,
        spark.createDataFrame([(k, centres[k].tolist()) for k in range(4)], "cluster_id int, centroid array<double>"),
        spark.createDataFrame([(j, int(cluster[j])) for j in range(m)], "prop_idx long, cluster_id int"), top_p=2,
    )
    got = {(r.qid, r.entity_idx): r.score for r in state.collect()}
    assert all(abs(got.get((7, i), 0.0) - x[i]) < 1e-9 for i in range(n)) and got[8, 0] == 1.0
    assert {r.qid: r.num_hops for r in took.collect()} == {7: hops, 8: 0}
    scores = propagation.proposition_scores(state, inc)
    got = {r.prop_idx: r.score for r in scores.where("qid = 7").collect()}
    assert all(abs(got.get(j, 0.0) - (h.T @ x)[j]) < 1e-9 for j in range(m))
    filled = propagation.top_rows(scores.where("qid = 8"), "prop_idx", 12, inc.select("prop_idx").distinct())
    assert filled.count() == min(12, inc.select("prop_idx").distinct().count())


def test_masks(spark):
    rows = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 0, [3.0, 0.0]), (2, 1, [0.0, 1.0])], "prop_idx long, cluster_id int, vector array<double>")
    centroids = masking.centroids_of(rows)
    assert {r.cluster_id: r.centroid for r in centroids.collect()} == {0: [2.0, 0.0], 1: [0.0, 1.0]}
    g = spark.createDataFrame([(1, 0, [1.0, 0.1], 1), (2, 0, [0.0, 1.0], 9)], "qid long, hop int, vector array<double>, p int")
    assert sorted((r.qid, r.cluster_id) for r in masking.top_clusters(g, centroids, "p").collect()) == [(1, 0), (2, 0), (2, 1)]
    kept = masking.mask(masking.top_clusters(g, centroids, 1), rows.select("prop_idx", "cluster_id"))
    assert sorted((r.qid, r.prop_idx) for r in kept.collect()) == [(1, 0), (1, 1), (2, 2)]
    for k, n in ((1, 1), (5, 3), (2, 2)):
        centres, assigned = masking.fit_clusters(rows, k)
        assert centres.count() == n and assigned.count() == 3
    assert masking.fit_clusters(rows.limit(0), 3)[1].count() == 0
    assert masking.cluster_sizes(rows.select("prop_idx", "cluster_id")).first().asDict() == {"min_size": 1, "max_size": 2, "mean_size": 1.5}


def test_evaluation(spark):
    rows = spark.createDataFrame([("Paris it is", "paris", "correct"), ("no", "paris", "incorrect")], "pred_answer string, gold_answer string, verdict string")
    assert evaluation.mean_accuracy(evaluation.score_predictions(rows)).first().asDict() == {"llm_accuracy": 0.5, "contain_accuracy": 0.5}
    assert evaluation.mean_accuracy(evaluation.score_predictions(rows.limit(0))).first().contain_accuracy is None
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "a int, b int")
    assert evaluation.sparsity(pairs, "a", "b").first().sparsity == 25.0


def test_top_k_in_blocks_and_cells(spark):
    """Blocks on Spark give what the collected query set gives; cells reach nine tenths of the nearest and hold every entity."""
    from hoploom.operators import affinity, dense

    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    vectors = [(k, (centres[k % 12] + 0.4 * rng.standard_normal(16)).tolist()) for k in range(600)] + [(600, vectors_of_one := [1.0] * 16), (601, vectors_of_one), (602, None)]
    df = spark.createDataFrame(vectors, "id long, vector array<double>")
    queries, items = df.select(F.col("id").alias("qid"), "vector"), df.select(F.col("id").alias("iid"), "vector")
    want = {(r.qid, r["rank"]): (r.iid, r.score) for r in dense.top_k(queries, items, 5).collect()}
    for block in (2048, 50):
        assert {(r.qid, r["rank"]): (r.iid, r.score) for r in dense.top_k_joined(queries, items, 5, block=block).collect()} == want
    assert dense.top_k_joined(queries.limit(0), items, 5).count() == 0
    entities = df.withColumnRenamed("id", "entity_idx")
    exact = {(r.i, r.j) for r in affinity.candidate_pairs(entities, 10).collect()}
    found = {(r.i, r.j) for r in affinity.candidate_pairs(entities, 10, cells=12, probes=3, sample=200).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    assert {x for pair in found for x in pair} == set(range(602))


def test_scaled_scores_in_one_pass(spark):
    from hoploom.operators import dense

    rng = np.random.default_rng(5)
    q, x = rng.standard_normal((7, 4)), rng.standard_normal((300, 4))
    queries = spark.createDataFrame([(k, k % 2, v.tolist()) for k, v in enumerate(q)] + [(7, 0, [0.0] * 4)], "qid long, hop int, vector array<double>")
    items = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "iid long, vector array<double>").repartition(3)
    scores = np.vstack([q, np.zeros(4)]) @ x.T
    low, high = scores.min(axis=1, keepdims=True), scores.max(axis=1, keepdims=True)
    e = np.exp(scores / 0.5)
    want = {"minmax": np.vstack([(scores - low)[:7] / (high - low)[:7], np.ones(300)]), "softmax": e / (e.sum(axis=1, keepdims=True) + 1e-8) * 300}
    for scale, matrix in want.items():
        for block in (1024, 3):
            got = dense.all_scores(queries, items, block=block, keys=("qid", "hop"), scale=scale, temperature=0.5).collect()
            assert len(got) == 2400 and all(abs(r.score - matrix[r.qid, r.iid]) < 1e-9 and r.hop == (r.qid % 2 if r.qid < 7 else 0) for r in got)


def test_passage_edges_count_as_mention_edges(spark):
    texts = ["Lionel Lion Lion xLion LIONel LLionel Lions. lion", "Éclairs Über ÉLion Lion-Lion Abcd\nAbcdAbcd Abcde", "no capital", "", None, "Lion " * 3000 + "Lionel"]
    passages = graph.passages_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {(r.src, r.dst): round(r.weight, 12) for r in graph.passage_edges(passages).collect()}
    assert got == {(r.src, r.dst): round(r.weight, 12) for r in graph.mention_edges(graph.mentions_of(passages), passages).collect()} and len(got) == 8
    assert graph.passage_edges(passages.limit(0)).count() == 0


def test_sentences_are_searched_once(spark):
    passages = graph.passages_of(spark.createDataFrame([(1, "Abcd and Efgh. Abcd again. Ijkl"), (2, "none. Abcd again. Ijkl\nIjkl"), (3, None)], "doc_id long, text string"))
    got = sorted((r.sentence, r.entity) for r in graph.entity_sentences_of(passages).collect())
    assert got == [("1:Abcd and Efgh", "Abcd"), ("1:Abcd and Efgh", "Efgh"), ("Abcd again", "Abcd"), ("Ijkl", "Ijkl")]


def test_all_pairs_store_each_side_once(spark):
    """Every vector was written once for each block of the other side; now no stage shuffles more rows than there are vectors or results."""
    from hoploom.operators import affinity, dense

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal((700, 8)), np.repeat(rng.standard_normal((1, 8)), 400, axis=0)])
    df = spark.createDataFrame([(k, v.astype(np.float32).tolist()) for k, v in enumerate(x)], "id long, vector array<float>")
    blocks = dense.packed_rows(df, 64)
    assert blocks.count() >= 1100 / 64 and blocks.select(F.sum(F.size("ids"))).first()[0] == 1100
    near = dense.top_k_of_blocks(blocks, blocks, 5, unit=True)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    scores = np.round(u @ u.T, 9) + 0.0
    want = np.argsort(-scores, axis=1, kind="stable")[:, :5]
    rows = near.collect()
    assert len(rows) == 5500 and all(want[r.qid, r["rank"] - 1] == r.iid and r.score == scores[r.qid, r.iid] for r in rows)
    whole, dense.HELD_ITEMS = dense.HELD_ITEMS, 300  # items of several tasks are merged
    try:
        assert sorted(map(tuple, dense.top_k_of_blocks(blocks, blocks, 5, unit=True).collect())) == sorted(map(tuple, rows))
    finally:
        dense.HELD_ITEMS = whole
    entities = df.select(F.col("id").alias("entity_idx"), "vector", F.concat(F.lit("name"), F.col("id")).alias("name"))
    known = {(r.i, r.j): r.score for r in affinity.score_pairs(affinity.compared_pairs(entities, 5), entities).collect()}
    joined = {(r.i, r.j): r.score for r in affinity.score_pairs(affinity.candidate_pairs(entities, 5), entities).collect()}
    assert known.keys() == joined.keys() and all(abs(known[p] - joined[p]) < 1e-12 for p in known)


def test_top_k_of_texts_and_cells(spark):
    """Ids may be texts; a query meets the items of its cells alone."""
    from hoploom.operators import dense

    queries = spark.createDataFrame([("a", [1.0, 0.0], [0, 2]), ("b", [0.0, 1.0], [1, 0])], "qid string, vector array<double>, cells array<long>")
    items = spark.createDataFrame([("é", [3.0, 1.0], 1), ("x", [2.0, 2.0], 0), ("w", [2.0, 2.0], 0), ("v", [1.0, 9.0], 2)], "iid string, vector array<double>, cell long")
    got = sorted((r.qid, r["rank"], r.iid, r.score) for r in dense.top_k_joined(queries, items, 2).collect())
    assert got == [("a", 1, "w", 2.0), ("a", 2, "x", 2.0), ("b", 1, "w", 2.0), ("b", 2, "x", 2.0)]


def test_affinity_of_products(spark):
    """The products are not stored: the same as a state of all products through ``apply_affinity``, whatever the blocks and slices."""
    from hoploom.operators import affinity, dense

    rng = np.random.default_rng(7)
    items = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.standard_normal((900, 4)))] + [(900, None)], "iid long, vector array<double>")
    queries = items.where("iid % 100 = 0").withColumnRenamed("iid", "qid")
    a = [(int(i), int(j), 0.8) for i, j in rng.integers(0, 900, (300, 2)) if i < j] + [(3, j, 0.9) for j in range(100, 800)]  # 3 goes on through slices
    both = affinity.symmetric(spark.createDataFrame(a, "i long, j long, score double").dropDuplicates(["i", "j"]), 0.7)
    state = dense.all_scores(queries, items).select("qid", F.col("iid").alias("entity_idx"), F.greatest("score", F.lit(0.0)).alias("score"))
    want = {(r.qid, r.entity_idx): r.score for r in affinity.apply_affinity(state, both, 0.3).collect()}
    for block in (1024, 4):
        got = affinity.apply_to_products(queries, items, both, 0.3, block=block)
        assert "HashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
        rows = got.collect()
        assert len(rows) == len(want) == 8100 and all(abs(want[r.qid, r.entity_idx] - r.score) < 1e-9 for r in rows)
