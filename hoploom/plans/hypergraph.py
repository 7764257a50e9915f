"""Entity-proposition incidence engine: index, retrieve, answer, serve."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import HypergraphConfig
from ..operators.affinity import candidate_pairs, indexed_pairs, score_pairs, symmetric, unit_items
from ..operators.evidence import evidence
from ..operators.graph import keep_labels
from ..operators.inverted_file import InvertedFile
from ..operators.masking import fit_clusters
from ..operators.propagation import match_seeds, propagate, proposition_scores, top_rows
from ..operators.propositions import incidence_of, parse_propositions, parse_subquestions
from ..schemas import CENTROIDS, PROP_CLUSTER
from ..session import cut_lineage
from ..sources.catalog import IndexCatalog
from ..sources.datasets import chunks_of
from ..sources.replies import ReplyStore
from ..sources.models import Embedder, EntityExtractor, LlmClient, ask, embed, extract_entities

PROPOSE = "Rewrite the passage as numbered, self-contained factual statements, one a line."
DECOMPOSE = "Split the question into numbered sub-questions in the order in which they must be answered, one a line."
ANSWER = "Answer the question in a few words from the facts."
NO_ANSWER = "No answer could be generated."


class HypergraphEngine:
    """Builds and queries an index kept as Parquet tables."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder, extractor: EntityExtractor, llm: LlmClient, config: HypergraphConfig | None = None, replies: ReplyStore | None = None):
        self.spark, self.catalog = spark, IndexCatalog(spark, path)
        self.embedder, self.extractor, self.llm = embedder, extractor, llm
        self._ask = replies.ask if replies else ask
        self.config = config or HypergraphConfig()

    def index(self, passages: DataFrame) -> None:
        """Builds all tables from passages (text, with or without an index prefix)."""
        c = self.config
        self.catalog.write("chunks", chunks_of(passages))
        chunks = self.catalog.read("chunks")
        # A failed call makes the whole chunk one proposition.
        replies = self._ask(chunks, self.llm, "text", "reply", PROPOSE, on_error="{text}")
        self.catalog.write("propositions_text", parse_propositions(replies, "chunk_id", "reply"))
        texts = self.catalog.read("propositions_text")
        found = keep_labels(extract_entities(texts.select(F.col("prop_id").alias("passage_id"), "text"), self.extractor))
        self.catalog.write("members", found.select(F.col("passage_id").alias("prop_id"), F.lower("entity").alias("name")).distinct())
        members = self.catalog.read("members")
        incidence, entities, props = incidence_of(members)
        self.catalog.write("incidence", incidence)
        self.catalog.write("entities", embed(entities, self.embedder, "name", "vector"))
        self.catalog.write("propositions", embed(texts.join(props, "prop_id"), self.embedder, "text", "vector"))
        entities = self.catalog.read("entities")
        self.catalog.write("affinity", symmetric(score_pairs(self._alias_candidates(entities), entities, c.lexical_weight), c.affinity_threshold))
        centroids, prop_cluster = fit_clusters(self.catalog.read("propositions"), c.num_clusters, c.kmeans_seed, c.kmeans_iterations, c.kmeans_starts)
        self.catalog.write("centroids", centroids)
        self.catalog.write("prop_cluster", prop_cluster)

    def _alias_candidates(self, entities: DataFrame) -> DataFrame:
        """Each entity with its nearest: all pairs compared up to ``exact_neighbours``, by an inverted file beyond."""
        c, n = self.config, entities.count()
        if n <= c.exact_neighbours:
            return candidate_pairs(entities, c.top_k_candidates)
        # Positions of entities are new in each index, and so is the file.
        index = InvertedFile(self.spark, f"{self.catalog.path}/neighbours-{uuid.uuid4().hex}")
        index.build(unit_items(entities), math.isqrt(n))
        return indexed_pairs(entities, index, c.top_k_candidates, c.neighbour_probes)

    @property
    def indexed(self) -> bool:
        return self.catalog.exists("prop_cluster")

    def retrieve(self, questions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(top propositions, top entities, hops) per question (qid, question)."""
        c = self.config
        asked = cut_lineage(embed(questions.select("qid", "question"), self.embedder, "question", "vector"))
        found = keep_labels(extract_entities(questions.select(F.col("qid").cast("string").alias("passage_id"), F.col("question").alias("text")), self.extractor))
        mentions = found.select(F.col("passage_id").alias("key"), F.col("entity").alias("mention")).join(questions.select("qid", F.col("qid").cast("string").alias("key")), "key").select("qid", "mention")
        entities, incidence = self.catalog.read("entities"), self.catalog.read("incidence")
        seeds = cut_lineage(match_seeds(mentions, entities.select("entity_idx", "name"), asked.select("qid", "vector"), entities.select("entity_idx", "vector"), c.seed_fallback))
        parts = parse_subquestions(self._ask(questions.select("qid", "question"), self.llm, "question", "reply", DECOMPOSE, on_error="{question}"), "qid", "reply")
        guidance = embed(parts, self.embedder, "text", "vector").select("qid", "hop", "vector")
        props = self.catalog.read("propositions")
        state, hops = propagate(
            seeds, incidence, props.select("prop_idx", "vector"), guidance, self.catalog.read("affinity"), self.catalog.read("centroids", CENTROIDS),
            self.catalog.read("prop_cluster", PROP_CLUSTER), c.max_hops, c.propagation_factor, c.top_p_clusters, c.convergence_threshold, c.temperature,
        )
        best = top_rows(proposition_scores(state, incidence), "prop_idx", c.top_k_propositions, props.select("prop_idx"))
        return best, top_rows(state, "entity_idx", c.top_k_entities, entities.select("entity_idx")), hops

    def qa(self, questions: DataFrame) -> DataFrame:
        """Questions (qid, question, answer, ...) with pred_answer, gold_answer, evidence, source_chunks, num_hops."""
        c = self.config
        best, _, hops = self.retrieve(questions)
        told = evidence(best, self.catalog.read("propositions").select("prop_idx", "text", "chunk_id"), c.evidence_limit, c.source_chunk_limit)
        rows = questions.join(told, "qid", "left").join(hops, "qid", "left").withColumnRenamed("answer", "gold_answer")
        prompt = F.concat(F.lit("Facts:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), F.col("question"))
        return self._ask(rows.withColumn("prompt", prompt), self.llm, "prompt", "pred_answer", ANSWER, on_error=NO_ANSWER).drop("prompt", "context")

    def health(self) -> DataFrame:
        """(status, indexed, num_entities, num_propositions) in one row."""
        if not self.indexed:
            return self.spark.createDataFrame([("healthy", False, 0, 0)], "status string, indexed boolean, num_entities long, num_propositions long")
        counts = [self.catalog.read(t).count() for t in ("entities", "propositions")]
        return self.spark.createDataFrame([("healthy", True, *counts)], "status string, indexed boolean, num_entities long, num_propositions long")

    def query(self, question: str) -> dict:
        """One question as a service answers it."""
        return self.batch_query([question])[0]

    def batch_query(self, questions: list[str]) -> list[dict]:
        """Answers of a service call's questions, in order."""
        if not self.indexed:
            raise LookupError("no index")
        df = self.spark.createDataFrame([(k, q, None) for k, q in enumerate(questions)], "qid long, question string, answer string")
        rows = sorted(self.qa(df).collect(), key=lambda r: r.qid)
        return [{"question": r.question, "answer": r.pred_answer, "evidence": list(r.evidence or []), "source_chunks": list(r.source_chunks or []), "num_hops": r.num_hops or 0} for r in rows]
