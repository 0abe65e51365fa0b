"""From questions to ranked passages, for all questions at once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lorewell import schemas
from lorewell.config import EngineConfig
from lorewell.functions.responses import parse_filter, repaired
from lorewell.functions.text import text_processing, tokens
from lorewell.functions.vectors import doubles
from lorewell.operators import knn, ppr
from lorewell.operators.calls import ask, chat
from lorewell.operators.models import ChatModel, Embedder, FactFilter, closest_facts, embed
from lorewell.sources.files import Tables

DEFAULT = EngineConfig()


def embedded_queries(queries: DataFrame, model: Embedder, linking: str) -> DataFrame:
    """Queries (query_id, question) with an embedding; each different question is encoded once."""
    once = queries.select("question").distinct().withColumn("embedding", embed(F.col("question"), model, linking))
    return queries.join(once, "question")


def fact_candidates(queries: DataFrame, facts: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """query_id, key_id (fact), score (min-max over all facts), rank <= linking_topk."""
    return knn.top_normalised(queries, facts, config.linking_topk, config)


def filter_by_words(candidates: DataFrame, queries: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Keep candidates (query_id, s, p, o, rank, ...) that share a word with the question, at most filter_topk; in the JVM."""
    asked = queries.select("query_id", tokens(text_processing(F.col("question"))).alias("words"))
    own = tokens(F.concat_ws(" ", "s", "p", "o"))
    hits = candidates.join(asked, "query_id").where(F.arrays_overlap(own, "words")).drop("words")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return hits.withColumn("n", best).where(F.col("n") <= config.filter_topk).drop("n")


def filter_by_model(candidates: DataFrame, queries: DataFrame, model: FactFilter, config: EngineConfig = DEFAULT) -> DataFrame:
    """Keep what a filter object keeps of each question's candidates; one that fails keeps none."""

    @F.arrow_udf(schemas.TRIPLES)
    def kept(questions: pa.Array, facts: pa.Array) -> pa.Array:
        out = []
        for q, f in zip(questions.to_pylist(), facts.to_pylist()):
            try:
                out.append(model.keep(q or "", f)[: config.linking_topk])
            except Exception:  # noqa: BLE001  whatever a model raises, the question falls back to dense passages
                out.append([])
        return pa.array(out, pa.list_(pa.list_(pa.string())))

    lists = _candidate_lists(candidates, queries)
    return _chosen(candidates, lists.select("query_id", kept(F.col("question"), F.col("facts")).alias("k")))


def _candidate_lists(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, question, facts: each question's candidates in order, linking_topk at most."""
    lists = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.array("s", "p", "o").alias("t")))).alias("c"))
    return lists.join(queries.select("query_id", "question"), "query_id").select("query_id", "question", F.col("c.t").alias("facts"))


def _chosen(candidates: DataFrame, kept: DataFrame) -> DataFrame:
    """The candidates that are in the lists of ``kept`` (query_id, k)."""
    rows = kept.select("query_id", F.explode(F.array_distinct("k")).alias("t")).select("query_id", *[F.col("t")[i].alias(c) for i, c in enumerate("spo")])
    return candidates.join(rows, ["query_id", "s", "p", "o"], "left_semi")


def filter_by_prompt(
    candidates: DataFrame, queries: DataFrame, model: ChatModel, prompt: list[dict[str, str]], tables: Tables | None = None, config: EngineConfig = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """Keep what a chat model keeps of each question's candidates, and the calls made.

    Each fact in the response stands for the candidate closest to it; a question
    whose call fails, or whose response can't be read, keeps none.
    """

    @F.arrow_udf(schemas.TRIPLES)
    def closest(made: pa.Array, facts: pa.Array) -> pa.Array:
        rows = [closest_facts(m or [], f)[: config.filter_topk] for m, f in zip(made.to_pylist(), facts.to_pylist())]
        return pa.array(rows, pa.list_(pa.list_(pa.string())))

    lists = _candidate_lists(candidates, queries)
    shown = F.to_json(F.struct(F.col("facts").alias("fact")))
    answers = ask(lists.withColumn("messages", chat(prompt, question=F.col("question"), facts=shown)), model, tables)
    made = parse_filter(repaired(F.col("response"), F.col("finish_reason")))
    return _chosen(candidates, answers.select("query_id", closest(made, F.col("facts")).alias("k"))), answers


def phrase_weights(kept: DataFrame, degree: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """query_id, phrase, weight: mean of fact score over the number of chunks with the phrase; the linking_topk best.

    ``kept``: query_id, s, o, score; ``degree``: entity, n_chunks.
    """
    each = kept.select("query_id", F.explode(F.array("s", "o")).alias("phrase"), "score")
    share = F.col("score") / F.greatest(F.lit(1), F.coalesce("n_chunks", F.lit(0)))
    mean = each.join(degree.withColumnRenamed("entity", "phrase"), "phrase", "left").groupBy("query_id", "phrase").agg(F.avg(share).alias("weight"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("weight", knn.PLACES)), "phrase"))
    return mean.withColumn("n", best).where((F.col("n") <= config.linking_topk) & (F.col("weight") > 0)).drop("n")


def reset_weights(phrases: DataFrame, passages: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """query_id, node_id, weight: seeds of phrases (query_id, node_id, weight) and, small, of all passages (query_id, node_id, score)."""
    dense = passages.select("query_id", "node_id", (F.col("score") * F.lit(config.passage_weight)).alias("weight"))
    return phrases.select("query_id", "node_id", "weight").unionByName(dense).groupBy("query_id", "node_id").agg(F.sum("weight").alias("weight"))


def graph_ranked(edges: DataFrame, reset: DataFrame, passages: DataFrame, k: int, config: EngineConfig = DEFAULT) -> DataFrame:
    """query_id, key_id, score, rank of the k passages (node_id) with the highest PageRank."""
    found = ppr.personalized(edges, reset, config=config).join(passages.select("node_id"), "node_id", "left_semi")
    return knn.ranked(found.select("query_id", F.col("node_id").alias("key_id"), "score"), k)


def filled(ranked: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """Ranked passages, and for questions with fewer than ``k`` of them the first others (node_id) by id, with score 0.

    A question that is short has n < k ranked passages, so of the k smallest ids at least k - n are free: these k serve every question.
    """
    first = passages.select(F.col("node_id").alias("key_id")).orderBy("key_id").limit(k)
    short = ranked.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") < k)
    ids = first.agg(F.collect_list("key_id").alias("ids"))
    others = short.join(F.broadcast(ids)).select("query_id", "n", F.explode("ids").alias("key_id")).join(ranked, ["query_id", "key_id"], "left_anti")
    place = F.col("n") + F.row_number().over(Window.partitionBy("query_id").orderBy("key_id"))
    added = others.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)
    return ranked.unionByName(added.select("query_id", "key_id", F.lit(0.0).alias("score"), "rank"))


def with_fallback(graph: DataFrame, dense: DataFrame) -> DataFrame:
    """Graph rows for the questions that have some, dense rows for the others, told apart by ``method``."""
    left = dense.join(graph.select("query_id").distinct(), "query_id", "left_anti")
    return graph.withColumn("method", F.lit("graph")).unionByName(left.withColumn("method", F.lit("dense")))


def query_vectors(rows: DataFrame, key: str = "vec_id") -> DataFrame:
    """query_id and embedding of rows that serve as queries."""
    return rows.select(F.col(key).cast("long").alias("query_id"), doubles(F.col("embedding")).alias("embedding"))
