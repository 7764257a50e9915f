"""Command line: index a data set, answer its questions, evaluate the predictions."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import HypergraphConfig, TriGraphConfig
from .operators.evaluation import mean_accuracy, score_predictions
from .operators.graph import passages_of
from .operators.keys import dense_index
from .plans.hypergraph import HypergraphEngine
from .plans.trigraph import TriGraphEngine
from .sources.datasets import read_chunks, read_predictions, read_questions, setup_logging, write_predictions
from .sources.models import EchoLlm, HashedEmbedder, Lazy, OpenAiCompatibleLlm, RegexExtractor, ask
from .sources.replies import ReplyStore

JUDGE = "Does the prediction agree with the gold answer? Reply with correct or incorrect only."


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="hoploom")
    top.add_argument("engine", choices=["trigraph", "hypergraph", "evaluate"])
    top.add_argument("--chunks", help="JSON array of chunks")
    top.add_argument("--questions", help="JSON array of questions")
    top.add_argument("--index", help="folder of the index")
    top.add_argument("--predictions", required=True, help="folder of the predictions")
    top.add_argument("--scored", help="evaluate: folder of the scored predictions")
    top.add_argument("--llm", help="model of an OpenAI-compatible service; without it a stand-in replies")
    top.add_argument("--embedder", help="module:name of a callable that gives an embedder, called in the workers; without it a hashed stand-in")
    top.add_argument("--extractor", help="module:name of a callable that gives an entity recogniser, called in the workers; without it a stand-in of patterns")
    top.add_argument("--results", help="evaluate: folder of the means, as JSON")
    top.add_argument("--replies", help="folder in which the language model's replies are kept; none is asked for twice")
    top.add_argument("--log")
    top.add_argument("--skip-indexing", action="store_true")
    top.add_argument("--max-iterations", type=int, default=3)
    top.add_argument("--iteration-threshold", type=float, default=0.4)
    top.add_argument("--passage-ratio", type=float, default=2.0)
    top.add_argument("--top-k-sentence", type=int, default=3)
    top.add_argument("--vectorized", action="store_true")
    top.add_argument("--familiarity", type=float, help="questions with a passage at least this near skip the graph")
    top.add_argument("--num-clusters", type=int, default=100)
    top.add_argument("--top-p-clusters", type=int, default=10)
    top.add_argument("--max-hops", type=int, default=5)
    top.add_argument("--propagation-factor", type=float, default=0.3)
    top.add_argument("--affinity-threshold", type=float, default=0.7)
    return top.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parse(argv)
    log = setup_logging(args.log)
    spark = spark or SparkSession.builder.appName("hoploom").getOrCreate()
    llm = OpenAiCompatibleLlm(args.llm) if args.llm else EchoLlm()
    replies = ReplyStore(spark, args.replies, args.llm or "") if args.replies else None
    if args.engine == "evaluate":
        rows = read_predictions(spark, args.predictions)
        prompt = F.concat_ws("\n", F.col("question"), F.lit("Gold:"), F.col("gold_answer"), F.lit("Prediction:"), F.col("pred_answer"))
        judged = (replies.ask if replies else ask)(rows.withColumn("prompt", prompt), llm, "prompt", "verdict", JUDGE).drop("prompt")
        scored = score_predictions(judged).persist()
        if args.scored:
            write_predictions(scored, args.scored)
        means = mean_accuracy(scored)
        if args.results:
            means.coalesce(1).write.mode("overwrite").json(args.results)
        log.info("means: %s", means.first().asDict())
        scored.unpersist()
        return
    questions = read_questions(spark, args.questions)
    keyed = questions.withColumn("key", F.concat_ws("\t", "question", "answer"))
    questions = keyed.join(dense_index(keyed, "key", "qid"), "key").drop("key").dropDuplicates(["qid"])
    extractor = Lazy(args.extractor) if args.extractor else RegexExtractor()
    if args.engine == "trigraph":
        config = TriGraphConfig(max_iterations=args.max_iterations, iteration_threshold=args.iteration_threshold, passage_ratio=args.passage_ratio, top_k_sentence=args.top_k_sentence, vectorized=args.vectorized, familiarity=args.familiarity)
        engine = TriGraphEngine(spark, args.index, Lazy(args.embedder) if args.embedder else HashedEmbedder(), extractor, llm, config, replies)
        ready = engine.catalog.exists("edges")
    else:
        config = HypergraphConfig(num_clusters=args.num_clusters, top_p_clusters=args.top_p_clusters, max_hops=args.max_hops, propagation_factor=args.propagation_factor, affinity_threshold=args.affinity_threshold)
        engine = HypergraphEngine(spark, args.index, Lazy(args.embedder) if args.embedder else HashedEmbedder(normalize=False), extractor, llm, config, replies)
        ready = engine.indexed
    if not (args.skip_indexing and ready):
        engine.index(passages_of(read_chunks(spark, args.chunks), "idx"))
        log.info("indexed into %s", args.index)
    write_predictions(engine.qa(questions), args.predictions)
    log.info("predictions in %s", args.predictions)


if __name__ == "__main__":
    main()
