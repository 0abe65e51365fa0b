"""The engine: an index of passages that can grow, shrink and answer questions.

There is no hidden state: every call reads the current versions of the tables
under ``root`` and writes new ones. Graph and support tables are always those
of a build from scratch over the surviving extractions, so the order of index
and delete calls doesn't matter.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorewell import schemas
from lorewell.config import EngineConfig
from lorewell.functions.prompts import Prompts
from lorewell.functions.text import content_key, fact_content
from lorewell.operators import calls, evaluate, graph, knn, openie, qa, retrieve, store
from lorewell.operators.models import ChatModel, Embedder, Extractor, FactFilter, FirstFact, HashedWords, Reader
from lorewell.scratch import materialize
from lorewell.sources.files import Tables, texts

SUPPORT = "entity string, n_chunks long"
DIRECTED = "src string, dst string, weight double, kind string"
USAGE = "num_calls long, total_prompt_tokens long, total_completion_tokens long, num_cache_hit long, num_failed long, phase string"
FACTS = "hash_id string, content string, s string, p string, o string, embedding array<float>"


class Engine:
    def __init__(
        self, spark: SparkSession, root: str, config: EngineConfig | None = None, embedder: Embedder | None = None,
        extractor: Extractor | None = None, fact_filter: FactFilter | None = None, reader: Reader | None = None,
        mode: str = "graph", overwrite: bool = False, chat: ChatModel | None = None, prompts: Prompts | None = None,
    ):
        """``mode``: "graph", or "dense" for passages by similarity alone; without models the offline stand-ins work.

        ``chat`` extracts, filters facts and answers by ``prompts`` (the engine's
        own, where a name is missing), through a table of earlier calls; an
        ``extractor``, ``fact_filter`` or ``reader`` comes before it.
        ``seconds`` and ``calls`` tell what retrieval took and what was asked.
        """
        if mode not in ("graph", "dense"):
            raise ValueError(f"unknown mode {mode}")
        self.spark, self.config, self.mode = spark, config or EngineConfig(), mode
        self.embedder, self.extractor = embedder or HashedWords(), extractor
        self.fact_filter, self.reader, self.chat = fact_filter, reader, chat
        self.prompts = Prompts.default().replaced(prompts or Prompts())
        self.seconds: dict[str, float] = {}
        self.calls: dict[str, DataFrame] = {}
        self.tables = Tables(spark, root)
        if overwrite:
            self.tables.clear()

    # tables

    def chunks(self) -> DataFrame:
        return self.tables.read("chunks", schemas.STORE)

    def openie(self) -> DataFrame:
        return self.tables.read("openie", schemas.OPENIE)

    def entities(self) -> DataFrame:
        return self.tables.read("entities", schemas.STORE)

    def facts(self) -> DataFrame:
        return self.tables.read("facts", FACTS)

    def nodes(self) -> DataFrame:
        return graph.nodes(self.entities(), self.chunks())

    def directed_edges(self) -> DataFrame:
        return self.tables.read("directed", DIRECTED)

    def edges(self) -> DataFrame:
        return self.tables.read("edges", schemas.EDGES)

    # changes

    def index(self, docs: list[str] | DataFrame) -> None:
        """Add passages; known ones are neither encoded nor extracted again."""
        chunks = self.add_chunks(docs)
        if self.mode == "dense":
            return
        self.extract_only(chunks)
        self._rebuild()

    def add_chunks(self, docs: list[str] | DataFrame) -> DataFrame:
        """Encode the passages that are new and store them, without extraction and graph."""
        old = self.chunks()
        new = store.inserted(texts(self.spark, docs), old, self.embedder, self.config.chunk_prefix)
        return self.tables.replace("chunks", store.upserted(old, new))

    def take_extractions(self, rows: DataFrame) -> None:
        """Store extractions made elsewhere for passages that have none; the graph is built by the next ``index``."""
        known = self.openie().where("error is null")
        fresh = rows.dropDuplicates(["idx"]).join(known.select("idx"), "idx", "left_anti")
        self.tables.replace("openie", known.unionByName(fresh.select(known.columns)))

    def extract_only(self, chunks: DataFrame | None = None) -> DataFrame:
        """Extract what has no extraction yet and save it, without building the graph."""
        chunks, known = self.chunks() if chunks is None else chunks, self.openie()
        todo = openie.missing_chunks(chunks, known)
        if self.extractor is not None:
            fresh = openie.extract(todo, self.extractor)
        elif self.chat is not None:
            fresh, self.calls["extraction"] = openie.extract_by_prompts(todo, self.chat, self.prompts, self.tables)
        else:
            fresh = openie.rule_openie(todo)
        return self.tables.replace("openie", known.where("error is null").unionByName(fresh))

    def delete(self, docs: list[str] | DataFrame) -> None:
        """Remove passages, and facts and entities that no other passage supports; unknown passages are ignored."""
        gone = store.keyed(texts(self.spark, docs), self.config.chunk_prefix)
        self.tables.replace("chunks", store.deleted(self.chunks(), gone))
        if self.mode == "dense":
            return
        kept = self.openie().join(gone.select(F.col("hash_id").alias("idx")), "idx", "left_anti")
        self.tables.replace("openie", kept)
        self._rebuild()

    def _rebuild(self) -> None:
        """Facts, entities, support and edges from the extractions; vectors that exist are kept."""
        c, triples = self.config, openie.triples(self.openie())
        texts_of = openie.entities(triples).select(content_key(F.col("entity"), c.entity_prefix).alias("hash_id"), F.col("entity").alias("content"))
        entities = self.tables.replace("entities", self._encoded(texts_of, self.entities()))
        named = openie.facts(triples).withColumn("content", fact_content(F.col("s"), F.col("p"), F.col("o")))
        named = named.withColumn("hash_id", content_key(F.col("content"), c.fact_prefix))
        self.tables.replace("facts", self._encoded(named, self.facts()).select("hash_id", "content", "s", "p", "o", "embedding"))
        self.tables.replace("support", openie.entity_degree(triples))
        directed = graph.directed(graph.fact_edges(triples, c.entity_prefix), graph.passage_edges(triples, c.entity_prefix), graph.synonymy_edges(entities, c))
        directed = self.tables.replace("directed", directed.select("src", "dst", "weight", "kind"))
        self.tables.replace("edges", graph.symmetric(directed, self.nodes()))

    def _encoded(self, rows: DataFrame, old: DataFrame) -> DataFrame:
        known = old.select("hash_id", "embedding")
        fresh = store.with_embeddings(rows.join(known, "hash_id", "left_anti"), self.embedder)
        return rows.join(known, "hash_id").unionByName(fresh)

    # questions

    def questions(self, queries: list[str] | DataFrame) -> DataFrame:
        """query_id, question."""
        if isinstance(queries, DataFrame):
            return queries.select(F.col("query_id").cast("long").alias("query_id"), "question")
        return self.spark.createDataFrame(list(enumerate(queries)), "query_id long, question string")

    def dense(self, queries: DataFrame, k: int) -> DataFrame:
        asked = retrieve.embedded_queries(queries, self.embedder, "query_to_passage")
        return knn.top_normalised(asked, self.chunks().select(F.col("hash_id").alias("key_id"), "embedding"), k, self.config)

    def kept_facts(self, queries: DataFrame) -> DataFrame:
        """query_id, key_id, s, p, o, score, rank: the candidate facts that survive the filter."""
        asked = retrieve.embedded_queries(queries, self.embedder, "query_to_fact")
        found = retrieve.fact_candidates(asked, self.facts().select(F.col("hash_id").alias("key_id"), "embedding"), self.config)
        named = found.join(self.facts().select(F.col("hash_id").alias("key_id"), "s", "p", "o"), "key_id")
        if self.fact_filter is not None:
            kept = retrieve.filter_by_model(named, queries, self.fact_filter, self.config)
        elif self.chat is not None:
            kept, self.calls["filter"] = retrieve.filter_by_prompt(named, queries, self.chat, self.prompts.get("fact_filter"), self.tables, self.config)
        else:
            kept = retrieve.filter_by_words(named, queries, self.config)
        return materialize(kept, "kept")  # a filter is asked once

    def reset(self, queries: DataFrame, kept: DataFrame) -> DataFrame:
        """query_id, node_id, weight: the seeds of PageRank."""
        phrases = retrieve.phrase_weights(kept, self.tables.read("support", SUPPORT), self.config)
        seeds = phrases.select("query_id", content_key(F.col("phrase"), self.config.entity_prefix).alias("node_id"), "weight")
        asked = retrieve.embedded_queries(queries.join(kept.select("query_id").distinct(), "query_id", "left_semi"), self.embedder, "query_to_passage")
        passages = knn.all_normalised(asked, self.chunks().select(F.col("hash_id").alias("key_id"), "embedding"), self.config)
        return retrieve.reset_weights(seeds, passages.withColumnRenamed("key_id", "node_id"), self.config)

    def retrieve(self, queries: list[str] | DataFrame, k: int | None = None) -> DataFrame:
        """query_id, question, rank, hash_id, content, score, method of the k best passages of each question."""
        asked, k, start = self.questions(queries), self.config.retrieval_topk if k is None else k, time.perf_counter()
        self.seconds = {}
        found = self._timed("dense", lambda: self.dense(asked, k)).withColumn("method", F.lit("dense"))
        if self.mode == "graph":
            kept = self._timed("facts", self.kept_facts, asked)
            passages = self.chunks().select(F.col("hash_id").alias("node_id"))
            by_graph = self._timed("pagerank", lambda: retrieve.graph_ranked(self.edges(), self.reset(asked, kept), passages, k, self.config))
            found = retrieve.with_fallback(retrieve.filled(by_graph, passages, k), found.drop("method"))
        content = self.chunks().select(F.col("hash_id").alias("key_id"), "content")
        rows = found.join(content, "key_id").join(asked, "query_id").select(
            "query_id", "question", "rank", F.col("key_id").alias("hash_id"), "content", "score", "method"
        )
        rows = materialize(rows, "retrieved")
        total = time.perf_counter() - start
        self.seconds |= {"other": total - sum(self.seconds.values()), "total": total}
        return rows

    def _timed(self, phase: str, make: Callable[..., DataFrame], *args: DataFrame) -> DataFrame:
        """The result of a phase as a written table, and its seconds in ``seconds``."""
        start = time.perf_counter()
        out = materialize(make(*args), phase)
        self.seconds[phase] = self.seconds.get(phase, 0.0) + time.perf_counter() - start
        return out

    def usage(self) -> DataFrame:
        """phase and counters (calls, tokens, cache hits, failures) of the latest calls of each phase."""
        rows = [calls.usage(c).withColumn("phase", F.lit(phase)) for phase, c in sorted(self.calls.items())]
        return reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], USAGE)

    def recall(self, ranked: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pooled and single recall of retrieved rows against gold (query_id, gold)."""
        return evaluate.recall_at_k(qa.solutions(ranked).join(gold, "query_id"))

    def qa(self, ranked: DataFrame) -> DataFrame:
        """Solutions with prompt, response and answer for retrieved rows."""
        solved = qa.solutions(ranked)
        if self.reader is None and self.chat is not None:
            self.calls["answers"] = qa.answered_by_prompt(solved, self.chat, self.prompts.get("answer"), self.tables, self.config)
            return self.calls["answers"].drop("finish_reason", "prompt_tokens", "completion_tokens", "cache_hit", "error")
        asked = ranked.select("query_id", "question").distinct()
        return qa.answered(solved, self.reader or FirstFact(), self.kept_facts(asked) if self.mode == "graph" else None, self.config)

    def rag_qa(self, queries: list[str] | DataFrame, gold_answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
        """Answers, and pooled ExactMatch and F1 if gold answers (query_id, gold_answers) are given."""
        retrieved = queries if isinstance(queries, DataFrame) and "content" in queries.columns else self.retrieve(queries)
        out = self.qa(retrieved)
        if gold_answers is None:
            return out, None
        out = out.join(gold_answers, "query_id", "left")
        return out, evaluate.qa_scores(out)[0]

    def graph_info(self) -> DataFrame:
        return graph.info(self.nodes(), self.directed_edges(), self.facts())
