"""Schemas of the tables that are created empty or read from text."""

from __future__ import annotations

ENTITY_SENTENCE = "entity string, sentence string"
CENTROIDS = "cluster_id int, centroid array<double>"
PROP_CLUSTER = "prop_idx long, cluster_id int"
EMBEDDINGS = "hash_id string, text string, embedding array<float>"
QUESTIONS = "question string, answer string, type string, hops int, reasoning string"
PREDICTIONS = "question string, sorted_passage array<string>, sorted_passage_scores array<double>, gold_answer string, pred_answer string"
EXTRACTED = "passage_id string, sentence string, entity string, label string"
EDGES = "src string, dst string, weight double"
NODES = "id string, content string, kind string"
PLACES = "passage_id string, n long, next_id string, bucket long"
