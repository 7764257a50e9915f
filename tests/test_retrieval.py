"""PageRank on block vectors, and by diffused vectors with a local push."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hoploom.operators import blocks, pagerank, prior, push


@pytest.fixture(scope="module")
def world(spark):
    """A random graph of 60 passages and 25 entities with a hub, one passage without edges, and seven questions."""
    rng = np.random.default_rng(5)
    names = [f"word{k:02d}" for k in range(25)]
    passages, edges = [], []
    for p in range(60):
        own = sorted({"word00", *rng.choice(names, 3)}) if p < 59 else []
        passages.append((f"p{p:02d}", " ".join(own), rng.standard_normal(6).tolist()))
        edges += [(f"entity-{e}", f"p{p:02d}", float(w)) for e, w in zip(own, rng.dirichlet(np.ones(max(1, len(own)))), strict=False)]
        if 0 < p < 59:
            edges.append((f"p{p - 1:02d}", f"p{p:02d}", 1.0))
    questions = [(q, rng.standard_normal(6).tolist()) for q in range(7)]
    active = [(q, e, float(s), int(t)) for q in range(7) for e, s, t in zip(rng.choice(names[1:], 2, replace=False), rng.uniform(0.2, 1, 2), (0, 1), strict=True)]
    return (
        spark.createDataFrame(passages, "passage_id string, text string, vector array<double>"),
        spark.createDataFrame(edges, "src string, dst string, weight double"),
        spark.createDataFrame(questions, "qid long, vector array<double>"),
        spark.createDataFrame(active, "qid long, entity string, score double, tier int"),
        (passages, edges, questions, active),
    )


def by_hand(world):
    """{question: {node: score}} with matrices, in the limit."""
    passages, edges, questions, active = world
    nodes = sorted({n for s, d, _ in edges for n in (s, d)} | {p for p, _, _ in passages})
    at = {n: k for k, n in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for s, d, w in edges:
        a[at[d], at[s]] += w
        a[at[s], at[d]] += w
    sums = a.sum(axis=0)
    move = a / np.where(sums > 0, sums, 1)
    out = {}
    for qid, q in questions:
        s = np.array([np.dot(v, q) for _, _, v in passages])
        s = (s - s.min()) / (s.max() - s.min())
        restart = np.zeros(len(nodes))
        for (p, text, _), x in zip(passages, s, strict=True):
            bonus = sum(score * np.log1p(text.count(e)) / max(t, 1) for k, e, score, t in active if k == qid)
            restart[at[p]] += 0.05 * (1.5 * x + np.log1p(bonus))
        for k, e, score, _ in active:
            if k == qid:
                restart[at[f"entity-{e}"]] += score
        restart /= restart.sum()
        state = restart
        for _ in range(80):
            state = 0.5 * move @ state + restart * (1 - 0.5 * state[sums > 0].sum())
        out[qid] = dict(zip(nodes, state, strict=True))
    return out


def test_block_vectors_equal_rows(spark, world):
    passages, edges, questions, active, plain = world
    places = blocks.question_places(questions, 4)
    vectors = blocks.prior_blocks(active, questions, passages, places, size=4)
    got = {(r.qid, r.id): r.score for r in blocks.unpack(vectors, places, None).collect()}
    want = {(r.qid, r.passage_id): r.prior for r in prior.passage_priors(active, questions, passages).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    entities = active.select("qid", F.concat(F.lit("entity-"), "entity").alias("id"), F.col("score").alias("weight"))
    ranks = pagerank.pagerank_blocks(blocks.pack(entities, places, 4).union(vectors), edges, 0.5, 25)
    exact = by_hand(plain)
    found = {(r.qid, r.id): r.score for r in blocks.unpack(ranks, places, None).collect()}
    assert all(abs(found[q, n] - s) < 1e-6 for q, own in exact.items() for n, s in own.items() if (q, n) in found)
    assert {q for q, _ in found} == set(exact)
    top = blocks.top_of(ranks.where("id LIKE 'p%'"), places, 3).collect()
    for q, own in exact.items():
        best = sorted(((-round(s, 9), n) for n, s in own.items() if n.startswith("p")))[:3]
        assert [r.id for r in sorted((r for r in top if r.qid == q), key=lambda r: r.rank)] == [n for _, n in best]


def test_hub_lists_have_several_keys(spark, monkeypatch):
    monkeypatch.setattr(pagerank, "LIST_SIZE", 2)
    monkeypatch.setattr(pagerank, "LISTS_A_KEY", 3)
    edges = spark.createDataFrame([("hub", f"n{k}", 1.0) for k in range(40)], "src string, dst string, weight double")
    resets = spark.createDataFrame([(1, "n0", 1.0)], "qid long, id string, weight double")
    got = {r.id: r.score for r in pagerank.personalized_pagerank(resets, edges, 0.5, 20).collect()}
    assert abs(got["hub"] - 1 / 3) < 1e-5 and abs(got["n5"] - 1 / 240) < 1e-6 and abs(sum(got.values()) - 1) < 1e-9


@pytest.mark.parametrize("eps", [0.0, 1e-4, 1e-2, 1.0])
def test_push_is_within_its_bound(spark, world, eps):
    passages, edges, questions, active, plain = world
    graph = push.diffuse_passages(edges, passages, 0.5, 14)
    entities = active.select("qid", F.concat(F.lit("entity-"), "entity").alias("id"), F.col("score").alias("weight"))
    rows, bounds = push.retrieve_by_push(entities, active, questions, passages, graph, k=60, eps=eps, rounds=14)
    exact, bound = by_hand(plain), {r.qid: r.bound for r in bounds.collect()}
    found: dict[int, dict] = {}
    for r in rows.collect():
        found.setdefault(r.qid, {})[r.passage_id] = r.score
    for q, own in exact.items():
        gaps = [s - found[q][n] for n, s in own.items() if n.startswith("p")]
        assert min(gaps) > -1e-9 and sum(gaps) <= bound[q] + 1e-9
        if eps == 0.0:
            assert bound[q] < 1e-3
    few, _ = push.retrieve_by_push(entities, active, questions, passages, graph, k=3, eps=eps, rounds=14)
    assert {(r.qid, r.passage_id, r.rank) for r in few.collect()} == {(r.qid, r.passage_id, r.rank) for r in rows.where("rank <= 3").collect()}


def test_empty_inputs(spark, world):
    passages, edges, questions, active, _ = world
    places = blocks.question_places(questions.limit(0))
    assert blocks.prior_blocks(active, questions.limit(0), passages, places).count() == 0
    graph = push.diffuse_passages(edges, passages, 0.5, 2)
    entities = active.select("qid", "entity", "score").toDF("qid", "id", "weight")
    assert push.retrieve_by_push(entities, active, questions.limit(0), passages, graph)[0].count() == 0
    rows, bounds = push.retrieve_by_push(entities.limit(0), active.limit(0), questions, passages, graph, k=2)
    assert rows.count() == 14 and bounds.count() == 7


def test_choice_in_turn_equals_the_walk(spark):
    """Rounds of claims give what choosing one after another gives, also for ties and for many claims on one sentence."""
    from hoploom.operators.activation import choose_in_turn

    rng = np.random.default_rng(9)
    for k in (1, 2, 3):
        wishes = [(q, f"e{t}", t, f"s{s}", float(np.round(rng.uniform(), 1))) for q in range(3) for t in range(12) for s in range(15) if rng.uniform() < 0.5]
        df = spark.createDataFrame(wishes, "qid long, entity string, turn long, sentence string, sim double")
        got = {(r.qid, r.turn, r.r): r.sentence for r in choose_in_turn(df, k).collect()}
        want = {}
        for q in range(3):
            gone: set[str] = set()
            for t in range(12):
                own = sorted(((-sim, s) for x, _, y, s, sim in wishes if (x, y) == (q, t) and s not in gone))[:k]
                want.update({(q, t, r): s for r, (_, s) in enumerate(own, 1)})
                gone |= {s for _, s in own}
        assert got == want


def test_kmeans_takes_the_best_start(spark):
    from hoploom.operators import masking

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in ((0, 0), (5, 0), (0, 5), (9, 9))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "prop_idx long, vector array<double>").repartition(3)
    centroids, assigned = masking.fit_clusters(df, 4, 1, 50, 10)
    found = {r.prop_idx: r.cluster_id for r in assigned.collect()}
    assert len(found) == 120 and all(len({found[i] for i in range(g, g + 30)}) == 1 for g in (0, 30, 60, 90)) and len(set(found.values())) == 4
    assert np.allclose(sorted(r.centroid for r in centroids.collect()), sorted(x[g : g + 30].mean(axis=0).tolist() for g in (0, 30, 60, 90)))
    first = spark.createDataFrame([(0, 0, [0.0, 0.0]), (0, 1, [100.0, 100.0]), (1, 0, [0.0, 0.0]), (1, 1, [9.0, 9.0])], "start int, cluster_id int, centroid array<double>")
    best, _ = masking.lloyd(df, first, 20)  # the start with an empty cluster is the worse one
    assert max(r.centroid[0] for r in best.collect()) < 10


def test_inverted_file(spark, tmp_path):
    from hoploom.operators import affinity
    from hoploom.operators.inverted_file import InvertedFile

    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 8))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (None, x[0].tolist())], "entity_idx long, vector array<double>")
    index = InvertedFile(spark, str(tmp_path / "index"))
    assert not index.built
    index.build(affinity.unit_items(items.where("entity_idx < 200")), 12, sample=150)
    for _ in range(2):  # a repeated append adds nothing
        index.append(affinity.unit_items(items))
    assert index.built and index.catalog.read("cell_vectors").count() == 600
    exact = {(r.i, r.j) for r in affinity.candidate_pairs(items, 5).collect()}
    assert {(r.i, r.j) for r in affinity.indexed_pairs(items, index, 5, 12).collect()} == exact
    assert len({(r.i, r.j) for r in affinity.indexed_pairs(items, index, 5, 6).collect()} & exact) >= 0.9 * len(exact)


def test_gazetteer_takes_the_leftmost_longest(spark):
    from hoploom.operators.gazetteer import gazetteer_mentions

    rng = np.random.default_rng(4)
    names = ["a b", "B, C d", "c", "d e a b c", "a", "...", ""]
    texts = [(k, " ".join(rng.choice(list("abcdef"), rng.integers(0, 30)))) for k in range(60)] + [(100, None), (101, "A--b\n(C) D!")]
    known = {tuple("".join(ch if ch.isalnum() else " " for ch in n.lower()).split()) for n in names} - {()}
    want = []
    for k, text in texts:
        words, at = "".join(ch if ch.isalnum() else " " for ch in (text or "").lower()).split(), 0
        while at < len(words):
            n = max((n for n in range(1, 6) if tuple(words[at : at + n]) in known and at + n <= len(words)), default=0)
            if n:
                want.append((k, at, n, " ".join(words[at : at + n])))
            at += n or 1
    frame = spark.createDataFrame(texts, "id long, text string")
    got = gazetteer_mentions(frame, spark.createDataFrame([(n,) for n in names], "name string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and want
    assert gazetteer_mentions(frame, spark.createDataFrame([("!",)], "name string")).count() == 0


def test_pagerank_by_columns(spark, world, monkeypatch):
    """A graph whose edges a task holds goes by columns, without messages between nodes; a larger one by steps, with the same scores."""
    from hoploom.operators import columns

    passages, edges, questions, active, plain = world
    places = blocks.question_places(questions, 4)
    entities = active.select("qid", F.concat(F.lit("entity-"), "entity").alias("id"), F.col("score").alias("weight"))
    rows = blocks.pack(entities, places, 4).union(blocks.prior_blocks(active, questions, passages, places, size=4))
    wanted = passages.select(F.col("passage_id").alias("id"))

    def scores():
        return {(r.qid, r.id): r.score for r in blocks.unpack(pagerank.pagerank_blocks(rows, edges, 0.5, 25, wanted=wanted), places).collect()}

    with monkeypatch.context() as m:
        m.setattr(pagerank, "_steps", None)  # what larger graphs take
        by_columns = scores()
        m.setattr(columns, "EDGES_AT_ONCE", 16)
        m.setattr(columns, "COLUMNS", 2)
        m.setattr(columns, "NODES_AT_ONCE", 7)
        parted = scores()
    monkeypatch.setattr(columns, "EDGES_HELD", 10)
    by_steps = scores()
    assert by_columns.keys() == parted.keys() == by_steps.keys() and len(by_columns) == 420
    exact = by_hand(plain)
    assert all(abs(s - parted[k]) < 1e-12 and abs(s - by_steps[k]) < 1e-7 and abs(s - exact[k[0]][k[1]]) < 1e-7 for k, s in by_columns.items())
    alone = spark.createDataFrame([("p00", 0, np.array([1.0, 0, 0, 0]).tobytes()), ("p59", 0, np.array([3.0, 1, 0, 0]).tobytes())], blocks.vectors_of("string"))
    got = {(r.id, k): v for r in pagerank.pagerank_blocks(alone, edges.limit(0), 0.5, 3).collect() for k, v in enumerate(np.frombuffer(r.v)) if v}
    assert got == {("p00", 0): 0.25, ("p59", 0): 0.75, ("p59", 1): 1.0}


def test_a_cut_leaves_no_shuffle_files(spark):
    """Shuffle files of a query that is stored stayed until the driver collected its garbage."""
    from hoploom.session import CLEAN_UP, cut_lineage

    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before, told = tracker.shuffleStatuses().size(), spark.conf.get(CLEAN_UP)
    rows = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert tracker.shuffleStatuses().size() <= before and spark.conf.get(CLEAN_UP) == told
    assert rows.count() == 7


def test_push_by_columns(spark, world, monkeypatch):
    """Diffused vectors, the push and its scores by columns are those of the rows that larger graphs take, in blocks of any width."""
    from hoploom.operators import columns

    passages, edges, questions, active, _ = world
    entities = active.select("qid", F.concat(F.lit("entity-"), "entity").alias("id"), F.col("score").alias("weight")).unionByName(spark.createDataFrame([(0, "entity-unknown", 2.0)], "qid long, id string, weight double"))

    def answers():
        graph = push.diffuse_passages(edges, passages, 0.5, 6)
        rows, bounds = push.retrieve_by_push(entities, active, questions, passages, graph, k=60, eps=1e-3, rounds=5)
        return {(r.qid, r.passage_id): (r.score, r["rank"]) for r in rows.collect()}, {r.qid: r.bound for r in bounds.collect()}

    with monkeypatch.context() as m:
        m.setattr(push, "push", None)  # a row a question and node
        whole, told = answers()
        m.setattr(push, "WIDTH", 3)
        parted, _ = answers()
    monkeypatch.setattr(columns, "EDGES_HELD", 10)
    by_rows, bounds = answers()
    assert whole.keys() == parted.keys() == by_rows.keys() and len(whole) == 420
    assert all(whole[x][1] == parted[x][1] == by_rows[x][1] and abs(whole[x][0] - s) < 1e-12 and abs(parted[x][0] - s) < 1e-12 for x, (s, _) in by_rows.items())
    assert told.keys() == bounds.keys() and all(abs(told[q] - b) < 1e-12 for q, b in bounds.items())
