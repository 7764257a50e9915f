"""Settings of the two retrieval engines. The settings' public names and their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TriGraphConfig:
    """Entity-passage graph engine."""

    retrieval_top_k: int = 5
    max_iterations: int = 3
    top_k_sentence: int = 1
    passage_ratio: float = 1.5
    passage_node_weight: float = 0.05
    damping: float = 0.5
    iteration_threshold: float = 0.5
    vectorized: bool = False
    pagerank_steps: int = 30
    #: Residuals over this share of a question's mass are pushed; None takes steps over all nodes.
    push_eps: float | None = None
    #: Questions whose best passage is at least this near take their nearest passages and skip the graph; None sends all through it.
    familiarity: float | None = None


@dataclass(frozen=True)
class HypergraphConfig:
    """Entity-proposition incidence engine."""

    num_clusters: int = 100
    top_p_clusters: int = 10
    lexical_weight: float = 0.5
    affinity_threshold: float = 0.7
    propagation_factor: float = 0.3
    max_hops: int = 5
    top_k_entities: int = 20
    top_k_propositions: int = 10
    top_k_candidates: int = 10
    convergence_threshold: float = 1e-4
    temperature: float = 0.1
    kmeans_seed: int = 42
    kmeans_iterations: int = 300
    kmeans_starts: int = 10
    #: Beyond this many entities their neighbours come from an inverted file of about the root of their number of cells.
    exact_neighbours: int = 50_000
    neighbour_probes: int = 16
    evidence_limit: int = 5
    source_chunk_limit: int = 3
    seed_fallback: int = 5
