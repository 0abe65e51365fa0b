"""Settings of an index and of retrieval."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    synonymy_topk: int = 2047
    synonymy_query_block: int = 1000
    synonymy_key_block: int = 10_000
    synonymy_threshold: float = 0.8
    #: A node keeps at most this many synonyms.
    synonymy_limit: int = 101
    linking_topk: int = 5
    #: The filter keeps at most this many facts of a question.
    filter_topk: int = 4
    retrieval_topk: int = 200
    qa_topk: int = 5
    passage_weight: float = 0.05
    damping: float = 0.5
    #: Steps of the PageRank iteration; the error halves with each.
    ppr_steps: int = 34
    #: Directed edges up to which the graph is broadcast (16 bytes an edge and the names of its nodes); beyond, PageRank runs as joins.
    ppr_broadcast_edges: int = 1_000_000
    #: Questions in one block of a dense pass; bounds the broadcast matrix.
    query_block: int = 1024
    entity_prefix: str = "entity-"
    fact_prefix: str = "fact-"
    chunk_prefix: str = "chunk-"
