"""Entity-passage graph engine: index, retrieve, answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TriGraphConfig
from ..functions.text import parse_answer
from ..functions.vector import dot, l2_normalize
from ..operators.blocks import pack, prior_blocks, question_places, top_of
from ..operators.activation import activate_bfs, activate_vectorized, seed_entities
from ..operators.dense import top_k
from ..operators.extensions import familiar_answers
from ..operators.graph import keep_labels
from ..operators.pagerank import pagerank_blocks
from ..operators.push import diffuse_passages, retrieve_by_push
from ..schemas import EMBEDDINGS, EXTRACTED
from ..session import cut_lineage
from ..sources.catalog import IndexCatalog
from ..sources.replies import ReplyStore
from .graph_store import GraphStore
from ..sources.models import Embedder, EntityExtractor, LlmClient, ask, embed, extract_entities

INSTRUCTION = "Answer the question from the passages. Reason briefly, then write the result after 'Answer:'."


class TriGraphEngine:
    """Builds and queries an index kept as Parquet tables; calls of ``index`` add what is new."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder, extractor: EntityExtractor, llm: LlmClient | None = None, config: TriGraphConfig | None = None, replies: ReplyStore | None = None):
        self.spark, self.catalog = spark, IndexCatalog(spark, path)
        self.graph = GraphStore(self.catalog)
        self.embedder, self.extractor, self.llm = embedder, extractor, llm
        self._ask = replies.ask if replies else ask
        self.config = config or TriGraphConfig()

    def _store(self, name: str, texts: DataFrame, prefix: str) -> DataFrame:
        """Embeds and appends texts that are not stored yet."""
        keyed = texts.select(F.concat(F.lit(prefix), F.md5("text")).alias("hash_id"), "text").dropDuplicates(["hash_id"])
        new = keyed.join(self.catalog.read(name, EMBEDDINGS).select("hash_id"), "hash_id", "left_anti")
        return self.catalog.append_missing(name, embed(new, self.embedder).withColumn("embedding", l2_normalize(F.col("embedding")).cast("array<float>")), "hash_id", EMBEDDINGS)

    def index(self, passages: DataFrame) -> None:
        """Adds passages (text, as "idx:chunk") and what they bring to the graph; those that are in it already cost no writing."""
        stored = self._store("passages", passages.select("text"), "passage-").select(F.col("hash_id").alias("passage_id"), "text")
        known = self.catalog.read("ner", EXTRACTED)
        todo = stored.join(known.select("passage_id").distinct(), "passage_id", "left_anti")
        if not todo.isEmpty():
            # A passage without entities leaves one empty row, so that it is not read again.
            found = keep_labels(extract_entities(todo, self.extractor))
            rows = todo.select("passage_id").join(found, "passage_id", "left").select("passage_id", "sentence", "entity", "label").persist()
            rows.write.mode("append").parquet(f"{self.catalog.path}/ner")
            rows.unpersist()
        ner = self.catalog.read("ner", EXTRACTED).where("entity IS NOT NULL")
        self._store("sentences", ner.select(F.col("sentence").alias("text")).distinct(), "sentence-")
        self._store("entities", ner.select(F.col("entity").alias("text")).distinct(), "entity-")
        self.graph.add(stored, ner)

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """(qid, passage_id, text, score, rank): the best passages of each question (qid, question).

        Familiar questions (``familiarity``) are answered by dense similarity before anything is activated; of the
        others those with seeds go through the graph and the rest by similarity. The scores differ in scale.
        """
        c = self.config
        asked = cut_lineage(embed(questions.select("qid", "question"), self.embedder, "question", "vector").withColumn("vector", l2_normalize(F.col("vector"))))
        passages = self.catalog.read("passages", EMBEDDINGS).select(F.col("hash_id").alias("passage_id"), "text", F.col("embedding").alias("vector"))
        items, columns = passages.select(F.col("passage_id").alias("iid"), "vector"), ["qid", "passage_id", "score", "rank"]
        near = None
        if c.familiarity is not None:
            near = familiar_answers(asked, items, c.familiarity, c.retrieval_top_k).withColumnRenamed("iid", "passage_id").select(*columns)
            asked = cut_lineage(asked.join(near.select("qid").distinct(), "qid", "left_anti"))
            questions = questions.join(asked.select("qid"), "qid", "left_semi")
            if asked.isEmpty():
                return self._with_texts(near, passages)
        entities = self.catalog.read("entities", EMBEDDINGS).select(F.col("text").alias("entity"), F.col("embedding").alias("vector"))
        sentences = self.catalog.read("sentences", EMBEDDINGS).select(F.col("text").alias("sentence"), F.col("embedding").alias("s"))
        pairs = self.catalog.read("entity_sentence")
        found = keep_labels(extract_entities(questions.select(F.col("qid").cast("string").alias("passage_id"), F.col("question").alias("text")), self.extractor))
        mentions = found.select(F.col("passage_id").alias("key"), F.lower("entity").alias("mention")).distinct()
        mentions = mentions.join(questions.select("qid", F.col("qid").cast("string").alias("key")), "key").select("qid", "mention")
        mentions = embed(mentions, self.embedder, "mention", "vector").withColumn("vector", l2_normalize(F.col("vector")))
        seeds = cut_lineage(seed_entities(mentions, entities))

        def similarity(rows: DataFrame) -> DataFrame:
            return rows.join(asked.select("qid", "vector"), "qid").join(sentences, "sentence").select("qid", "sentence", dot(F.col("s"), F.col("vector")).alias("sim"))

        walk = activate_vectorized if c.vectorized else activate_bfs
        weights, active = walk(seeds, pairs, similarity, c.max_iterations, c.top_k_sentence, c.iteration_threshold)
        with_seeds = asked.join(seeds.select("qid").distinct(), "qid", "left_semi")
        entity_weights = weights.select("qid", F.concat(F.lit("entity-"), F.md5("entity")).alias("id"), "weight")
        edges = self.graph.edges()
        if c.push_eps is None:
            places = cut_lineage(question_places(with_seeds.select("qid")))
            priors = prior_blocks(cut_lineage(active), with_seeds.select("qid", "vector"), passages, places, c.passage_ratio, c.passage_node_weight)
            ranks = pagerank_blocks(pack(entity_weights, places).union(priors), edges, c.damping, c.pagerank_steps, wanted=passages.select(F.col("passage_id").alias("id")))
            by_graph = top_of(ranks, places, c.retrieval_top_k).withColumnRenamed("id", "passage_id")
        else:
            diffused = diffuse_passages(edges, passages, c.damping, c.pagerank_steps)
            by_graph, _ = retrieve_by_push(entity_weights, cut_lineage(active), with_seeds.select("qid", "vector"), passages, diffused, c.retrieval_top_k, c.passage_ratio, c.passage_node_weight, c.push_eps, c.pagerank_steps)
        plain = asked.join(seeds.select("qid").distinct(), "qid", "left_anti")
        by_vector = top_k(plain, items, c.retrieval_top_k).withColumnRenamed("iid", "passage_id")
        found = by_graph.select(*columns).unionByName(by_vector.select(*columns))
        return self._with_texts(found if near is None else found.unionByName(near), passages)

    @staticmethod
    def _with_texts(found: DataFrame, passages: DataFrame) -> DataFrame:
        return found.join(passages.select("passage_id", "text"), "passage_id").select("qid", "passage_id", "text", "score", "rank")

    def qa(self, questions: DataFrame) -> DataFrame:
        """Predictions of (qid, question, answer): passages, scores, gold and predicted answer."""
        if self.llm is None:
            raise ValueError("a language model is needed to answer")
        rows = self.retrieve(questions).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "score"))).alias("rows"))
        joined = questions.join(rows, "qid", "left").select(
            "qid", "question", F.col("answer").alias("gold_answer"),
            F.coalesce(F.transform("rows", lambda r: r["text"]), F.array().cast("array<string>")).alias("sorted_passage"),
            F.coalesce(F.transform("rows", lambda r: r["score"]), F.array().cast("array<double>")).alias("sorted_passage_scores"),
        )
        prompt = F.concat(F.array_join("sorted_passage", "\n"), F.lit("\n\nQuestion: "), F.col("question"))
        return self._ask(joined.withColumn("prompt", prompt), self.llm, "prompt", "reply", INSTRUCTION).withColumn("pred_answer", parse_answer(F.col("reply"))).drop("prompt", "reply")
