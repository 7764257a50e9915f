import json
import random

import pytest
from pyspark.sql import functions as F

from hoploom.__main__ import main
from hoploom.operators.graph import passages_of
from hoploom.plans.hypergraph import HypergraphEngine
from hoploom.plans.trigraph import TriGraphEngine
from hoploom.config import TriGraphConfig
from hoploom.schemas import EMBEDDINGS
from hoploom.sources import datasets
from hoploom.sources.catalog import IndexCatalog
from hoploom.sources.models import EchoLlm, HashedEmbedder, Lazy, OpenAiCompatibleLlm, RegexExtractor, ask, embed
from hoploom.sources.replies import ReplyStore
from hoploom.sources.word_vectors import WordVectors
from hoploom.streaming.incremental import index_stream, read_passages

CHUNKS = [
    "Marie Curie was born in Warsaw. She studied in Paris.",
    "Warsaw is the capital of Poland.",
    "Paris lies on the Seine. Pierre Curie worked in Paris.",
    "The Seine flows through France.",
    "Unrelated text about gardening & weeds <here>.",
]
QUESTIONS = [{"question": "Where was Marie Curie born?", "answer": "Warsaw", "type": "multi-hop", "hops": 1, "reasoning": "r"}, {"question": "what grows in a garden?", "answer": None}]


class Stub:
    """Replies as a model would to the three kinds of prompts."""

    def infer(self, messages):
        text = messages[-1]["content"]
        if "fail" in text:
            raise RuntimeError("down")
        if text.startswith("Facts:"):
            return "Warsaw"
        if "Question:" in text:
            return "Thought. Answer: Warsaw"
        return "\n".join(f"{k + 1}. {s}" for k, s in enumerate(x for x in text.split(". ") if x))


@pytest.fixture(scope="module")
def passages(spark):
    return passages_of(spark.createDataFrame(list(enumerate(CHUNKS)), "doc_id long, text string"))


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(k, q["question"], q["answer"]) for k, q in enumerate(QUESTIONS)], "qid long, question string, answer string")


def test_trigraph(spark, tmp_path, passages, questions):
    for vectorized in (False, True):
        engine = TriGraphEngine(spark, f"{tmp_path}/{vectorized}", HashedEmbedder(), RegexExtractor(), Stub(), TriGraphConfig(iteration_threshold=0.05, top_k_sentence=3, vectorized=vectorized, pagerank_steps=8, push_eps=1e-6 if vectorized else None))
        engine.index(passages.where("idx < 3"))
        before = engine.catalog.read("edges").count()
        engine.index(passages)
        assert engine.catalog.read("edges").count() > before
        stored = engine.catalog.read("passages", EMBEDDINGS)
        assert stored.count() == stored.select("hash_id").distinct().count() == 5
        engine.index(passages)
        assert engine.catalog.read("passages", EMBEDDINGS).count() == 5
        rows = {r.qid: r for r in engine.qa(questions).collect()}
        assert len(rows[0].sorted_passage) == 5 and "Marie Curie" in rows[0].sorted_passage[0]
        assert rows[0].pred_answer == "Warsaw" and rows[0].gold_answer == "Warsaw" and rows[1].gold_answer is None
        assert len(rows[1].sorted_passage) == 5
        assert rows[0].sorted_passage_scores == sorted(rows[0].sorted_passage_scores, reverse=True)


def test_familiar_questions_skip_the_graph(spark, tmp_path, passages, questions):
    def answers(threshold, extractor=RegexExtractor()):
        engine = TriGraphEngine(spark, str(tmp_path), HashedEmbedder(), extractor, config=TriGraphConfig(pagerank_steps=4, familiarity=threshold))
        return {(r.qid, r.rank): (r.passage_id, r.score) for r in engine.retrieve(questions).collect()}

    class Broken:
        def extract(self, text):
            raise AssertionError("activated")

    TriGraphEngine(spark, str(tmp_path), HashedEmbedder(), RegexExtractor()).index(passages)
    graph, near = answers(None), answers(-1.0, Broken())  # all familiar: no recogniser is called
    assert answers(2.0) == graph and near.keys() == graph.keys() and near != graph
    # A threshold between the two questions' best passages sends each its own way.
    tops = sorted((near[q, 1][1], q) for q in (0, 1))
    routed = answers((tops[0][0] + tops[1][0]) / 2)
    assert tops[0][0] < tops[1][0]
    for (_, q), source in zip(tops, (graph, near)):
        assert {k: v for k, v in routed.items() if k[0] == q} == {k: v for k, v in source.items() if k[0] == q}


def test_hypergraph(spark, tmp_path, passages, questions):
    engine = HypergraphEngine(spark, str(tmp_path), HashedEmbedder(normalize=False), RegexExtractor(), Stub())
    assert engine.health().first().indexed is False
    with pytest.raises(LookupError):
        engine.query("x")
    engine.index(passages)
    health = engine.health().first()
    assert health.indexed and health.num_entities > 5 and health.num_propositions > 4
    rows = {r.qid: r for r in engine.qa(questions).collect()}
    assert rows[0].pred_answer == "Warsaw" and rows[0].gold_answer == "Warsaw" and rows[0].num_hops == 1
    assert any("Warsaw" in e for e in rows[0].evidence) and len(rows[0].evidence) <= 5 and len(rows[0].source_chunks) <= 3
    assert rows[1].num_hops >= 1
    got = engine.batch_query([q["question"] for q in QUESTIONS])
    assert [g["question"] for g in got] == [q["question"] for q in QUESTIONS]


def test_ask_errors(spark):
    df = spark.createDataFrame([("fail",), ("ok",)], "text string")
    assert sorted(r.reply for r in ask(df, Stub(), "text", on_error="{text}").collect()) == ["1. ok", "fail"]
    with pytest.raises(Exception, match="down"):
        ask(df, Stub(), "text").collect()


def test_readers_and_writers(spark, tmp_path, passages):
    (tmp_path / "chunks.json").write_text(json.dumps(CHUNKS))
    (tmp_path / "questions.json").write_text(json.dumps(QUESTIONS, indent=1))
    assert [(r.idx, r.text) for r in datasets.read_chunks(spark, f"{tmp_path}/chunks.json").orderBy("idx").collect()] == list(enumerate(CHUNKS))
    read = datasets.read_questions(spark, f"{tmp_path}/questions.json").collect()
    assert {r.question: (r.answer, r.hops) for r in read} == {q["question"]: (q.get("answer"), q.get("hops")) for q in QUESTIONS}
    chunks = datasets.chunks_of(passages.select("text").union(passages.select("text")))
    assert sorted(r.text for r in chunks.collect()) == sorted(CHUNKS)
    nodes = passages.select(F.col("passage_id").alias("id"), F.col("text").alias("content"))
    edges = spark.createDataFrame([("a", "b", 0.5)], "src string, dst string, weight double")
    datasets.write_graphml(nodes, edges, f"{tmp_path}/graph")
    import xml.dom.minidom
    from pathlib import Path

    lines = "".join(p.read_text() for part in range(4) for p in sorted(Path(f"{tmp_path}/graph/part={part}").glob("*.txt")))
    parsed = xml.dom.minidom.parseString(lines)
    assert len(parsed.getElementsByTagName("node")) == 5 and len(parsed.getElementsByTagName("edge")) == 1


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_chunks_in_splits(spark, tmp_path, split):
    """Quotes, backslashes, commas and brackets within texts, also where splits cut them."""
    rng = random.Random(split)
    texts = ["", '"', "\\", '\\"', 'a "b", ["c"]', "line\nbreak\t", "Éа漢🙂\u2028", "x" * 500, *("".join(rng.choices('ab"\\,[] \né🙂', k=rng.randint(0, 30))) for _ in range(60))]
    (tmp_path / "a.json").write_text(json.dumps(texts), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(texts, indent=2, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "mixed.json").write_text('["a", 1]')
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    kept = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in zip(names, (split, 1, 1)):
            spark.conf.set(name, str(value))
        for name in "ab":
            got = datasets.read_chunks(spark, f"{tmp_path}/{name}.json").orderBy("idx").collect()
            assert [(r.idx, r.text) for r in got] == list(enumerate(texts))
        if split == 64:
            assert spark.read.option("lineSep", '"').text(f"{tmp_path}/a.json").rdd.getNumPartitions() > 10
        assert datasets.read_chunks(spark, f"{tmp_path}/none.json").count() == 0
        with pytest.raises(Exception, match="not an array of strings"):
            datasets.read_chunks(spark, f"{tmp_path}/mixed.json").collect()
    finally:
        for name, value in kept.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_catalog(spark, tmp_path):
    catalog = IndexCatalog(spark, str(tmp_path / "c"))
    schema = "hash_id string, x int"
    assert catalog.read("t", schema).count() == 0 and not catalog.exists("t")
    with pytest.raises(FileNotFoundError):
        catalog.read("t").count()
    one = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], schema)
    assert catalog.append_missing("t", one, "hash_id", schema).count() == 2
    assert catalog.append_missing("t", spark.createDataFrame([("b", 9), ("c", 3)], schema), "hash_id", schema).count() == 3


def test_stream_gives_the_tables_of_a_batch(spark, tmp_path):
    """Also with an embedder that does not normalise, and with passages that come twice."""
    def engine(name):
        return TriGraphEngine(spark, str(tmp_path / name), HashedEmbedder(normalize=False), RegexExtractor())

    folder, streamed, whole = str(tmp_path / "in"), engine("stream"), engine("batch")
    for k in range(2):
        rows = [(i, CHUNKS[i]) for i in range(k, k + 3)]
        spark.createDataFrame(rows, "idx long, text string").coalesce(1).write.mode("append").parquet(folder)
        index_stream(read_passages(spark, folder), streamed, str(tmp_path / "state")).awaitTermination(240)
    whole.index(passages_of(spark.createDataFrame([(i, CHUNKS[i]) for i in range(4)], "doc_id long, text string")).select("text"))
    for name in ("passages", "sentences", "entities", "ner", "edges", "nodes", "places", "entity_sentence"):
        a, b = streamed.catalog.read(name), whole.catalog.read(name)
        assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0, name
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in streamed.catalog.read("passages").collect())


def test_unpicklable_model_is_built_in_the_workers(spark):
    def make():
        import threading

        class Locked:
            def __init__(self):
                self.lock = threading.Lock()  # cannot be pickled

            def encode(self, texts):
                import numpy as np

                with self.lock:
                    return np.array([[len(t)] for t in texts], dtype=np.float32)

        return Locked()

    df = spark.createDataFrame([("a",), ("bcd",), (None,)], "text string")
    assert sorted(r.embedding for r in embed(df, Lazy(make)).collect()) == [[0.0], [1.0], [3.0]]
    assert Lazy("hoploom.sources.models:RegexExtractor").extract("In Paris.") == [("In Paris.", "In Paris", "ENTITY")]


def test_replies_are_asked_for_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    class Counting:
        def __init__(self, failing=()):
            self.failing, self.folder = failing, str(calls)

        def infer(self, messages):
            import uuid

            text = messages[-1]["content"]
            open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
            if text in self.failing:
                raise RuntimeError("down")
            return f"{messages[0]['content']}|{text}"

    def asked():
        return len(list(calls.iterdir()))

    df = spark.createDataFrame([(k, f"p{k % 5}") for k in range(20)] + [(99, None)], "id long, prompt string").repartition(3)
    store = ReplyStore(spark, str(tmp_path / "store"), "model", slice_rows=2, rate=200.0)
    with pytest.raises(RuntimeError, match="have no reply"):
        store.ask(df, Counting(("p3",)), "prompt", system="s")
    assert asked() == 6
    found = {r.id: r.reply for r in store.ask(df, Counting(), "prompt", system="s").collect()}
    assert asked() == 7 and found == {**{k: f"s|p{k % 5}" for k in range(20)}, 99: "s|"}
    again = store.ask(df, Counting(("p1",)), "prompt", system="s").collect()
    assert asked() == 7 and len(again) == 21
    ReplyStore(spark, str(tmp_path / "store"), "other").ask(df.limit(1), Counting(), "prompt", system="s").collect()
    other = {r.reply for r in store.ask(df.where("id = 1"), Counting(("p1",)), "prompt", system="t", on_error="{prompt}").collect()}
    assert asked() == 9 and other == {"p1"}


def test_word_vectors(spark):
    rows = [("red apple pear fruit",)] * 30 + [("engine wheel motor car",)] * 30 + [(None,), ("rare",)]
    model = WordVectors.fit(spark.createDataFrame(rows, "text string"), dim=8, min_count=5, partitions=1, steps=8)
    a, b, c, nothing = model.encode(["Apple pear!", "fruit RED", "motor", "rare"])
    cos = lambda x, y: float(x @ y) / float((x @ x) ** 0.5 * (y @ y) ** 0.5)
    assert len(model.at) == 8 and cos(a, b) > cos(a, c) and not nothing.any()
    assert not WordVectors.fit(spark.createDataFrame(rows[:1], "text string")).encode(["red"]).any()


def own_embedder():
    return HashedEmbedder(normalize=False)


def test_service_client(monkeypatch):
    """Replies of a local service: busy twice, then an answer; a refusal comes through at once."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.error import HTTPError

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, asked["model"]))
            code = 400 if asked["model"] == "bad" else 429 if len(seen) == 1 else 503 if len(seen) == 2 else 200
            self.send_response(code)
            self.end_headers()
            if code == 200:
                self.wfile.write(json.dumps({"choices": [{"message": {"content": asked["messages"][-1]["content"].upper()}}]}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("OPENAI_BASE_URL", f"http://127.0.0.1:{server.server_port}/v1")
    assert OpenAiCompatibleLlm("m", pause=0.01).infer([{"role": "user", "content": "hi"}]) == "HI"
    assert seen == [("/v1/chat/completions", "m")] * 3
    with pytest.raises(HTTPError):
        OpenAiCompatibleLlm("bad", pause=0.01).infer([{"role": "user", "content": "hi"}])
    assert len(seen) == 4
    server.shutdown()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "chunks.json").write_text(json.dumps(CHUNKS))
    (tmp_path / "questions.json").write_text(json.dumps(QUESTIONS))
    common = ["--chunks", f"{tmp_path}/chunks.json", "--questions", f"{tmp_path}/questions.json"]
    for engine in ("trigraph", "hypergraph"):
        args = [engine, *common, "--index", f"{tmp_path}/{engine}", "--predictions", f"{tmp_path}/{engine}-out"]
        main(args, spark)
        rows = datasets.read_predictions(spark, f"{tmp_path}/{engine}-out").collect()
        assert len(rows) == 2 and all(r.pred_answer is not None for r in rows)
    main(["hypergraph", *common, "--index", f"{tmp_path}/hypergraph", "--predictions", f"{tmp_path}/own", "--skip-indexing", "--embedder", "tests.test_engines:own_embedder", "--extractor", "hoploom.sources.models:RegexExtractor"], spark)
    assert datasets.read_predictions(spark, f"{tmp_path}/own").count() == 2
    main(["evaluate", "--predictions", f"{tmp_path}/hypergraph-out", "--scored", f"{tmp_path}/scored", "--results", f"{tmp_path}/means"], spark)
    means = spark.read.json(f"{tmp_path}/means").first()
    assert 0 <= means.contain_accuracy <= 1 and 0 <= means.llm_accuracy <= 1
    assert spark.read.json(f"{tmp_path}/scored").where("contain_accuracy IS NOT NULL").count() == 2
    assert isinstance(EchoLlm().infer([{"content": "x"}]), str)
