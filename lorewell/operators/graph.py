"""The graph of entities and passages, always as a build from scratch would give it.

An incremental index calls these on all its triples, so the result doesn't
depend on the history of calls: facts aren't counted again, edges whose facts
are gone are gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lorewell.config import EngineConfig
from lorewell.functions.text import alnum_length, content_key
from lorewell.operators import knn

DEFAULT = EngineConfig()
#: By how much rounding may lift a cosine over 1, at most.
ROUNDING = 1e-6


def fact_edges(triples: DataFrame, prefix: str = DEFAULT.entity_prefix) -> DataFrame:
    """src, dst, weight: how often two entities stand in a raw triple, in both directions."""
    pair = lambda a, b: F.struct(content_key(F.col(a), prefix).alias("src"), content_key(F.col(b), prefix).alias("dst"))
    both = triples.select(F.explode(F.array(pair("s", "o"), pair("o", "s"))).alias("e"))
    return both.groupBy("e.src", "e.dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def passage_edges(triples: DataFrame, prefix: str = DEFAULT.entity_prefix) -> DataFrame:
    """src (chunk), dst (entity), weight 1: which entities a chunk mentions."""
    rows = triples.select(F.col("chunk_id").alias("src"), F.explode(F.array("s", "o")).alias("e"))
    return rows.select("src", content_key(F.col("e"), prefix).alias("dst")).distinct().withColumn("weight", F.lit(1.0))


def synonymy_edges(entities: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """src, dst, weight: near entities (hash_id, content, embedding), seen from those with a name of over two letters or digits."""
    if config.synonymy_threshold > 1 + ROUNDING:  # no cosine is that near
        key = entities.schema["hash_id"].dataType.simpleString()
        return entities.sparkSession.createDataFrame([], f"src {key}, dst {key}, weight double")
    sources = entities.where(alnum_length(F.col("content")) > 2).select(F.col("hash_id").alias("query_id"), "embedding")
    keys = entities.select(F.col("hash_id").alias("key_id"), "embedding")
    near = knn.nearest(sources, keys, config.synonymy_topk, config.synonymy_threshold, config)
    named = entities.where("content <> ''").select(F.col("hash_id").alias("key_id"))
    near = near.where("query_id <> key_id").drop("rank").join(named, "key_id", "left_semi")
    return knn.ranked(near, config.synonymy_limit).select(F.col("query_id").alias("src"), F.col("key_id").alias("dst"), F.col("score").alias("weight"))


def directed(facts: DataFrame, passages: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """src, dst, weight, kind. A synonym takes the place of a fact count in its direction, and only in that."""
    rows = facts.withColumn("kind", F.lit("fact"))
    if synonyms is not None:
        s = synonyms.withColumnRenamed("weight", "near")
        kind = F.when(F.col("near").isNotNull(), "synonym").otherwise("fact")
        rows = facts.join(s, ["src", "dst"], "full").select("src", "dst", F.coalesce("near", "weight").alias("weight"), kind.alias("kind"))
    return rows.unionByName(passages.withColumn("kind", F.lit("passage")))


def symmetric(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """src, dst, weight in both directions: the two directed weights added up, without loops; with ``nodes`` only between those."""
    rows = edges.where("src <> dst")
    if nodes is not None:
        for end in ("src", "dst"):
            rows = rows.join(nodes.select(F.col("node_id").alias(end)), end, "left_semi")
    ends = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = rows.select(F.explode(F.array(ends("src", "dst"), ends("dst", "src"))).alias("e"), "weight")
    return both.groupBy("e.src", "e.dst").agg(F.sum("weight").alias("weight"))


def nodes(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """node_id, kind, content of entities and chunks (hash_id, content); a chunk wins over an entity of the same key."""
    row = lambda df, kind: df.select(F.col("hash_id").alias("node_id"), F.lit(kind).alias("kind"), "content")
    only = row(entities, "entity").join(chunks.select(F.col("hash_id").alias("node_id")), "node_id", "left_anti")
    return row(chunks, "passage").unionByName(only)


def added_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The nodes of ``new`` that ``old`` lacks."""
    return new.join(old.select("node_id"), "node_id", "left_anti")


def without_nodes(rows: DataFrame, gone: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Nodes (columns node_id) or edges (src, dst) that don't touch the nodes ``gone`` (node_id)."""
    for c in columns:
        rows = rows.join(gone.select(F.col("node_id").alias(c)), c, "left_anti")
    return rows


def info(nodes: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """One row of counts; ``edges`` are directed (src, dst, kind), before loops go.

    ``legacy_synonymy`` is the pairs less distinct facts and pairs with a
    passage; it isn't the number of synonym pairs, which is ``n_synonym``.
    """
    kinds = nodes.agg(
        F.count_if(F.col("kind") == "entity").alias("n_phrase_nodes"), F.count_if(F.col("kind") == "passage").alias("n_passage_nodes"),
        F.count(F.lit(1)).alias("n_total_nodes"),
    )
    pairs = edges.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("kind") == "passage").alias("n_passage_pairs"),
        F.count_if(F.col("kind") == "synonym").alias("n_synonym"),
    )
    return kinds.crossJoin(pairs).crossJoin(facts.agg(F.count(F.lit(1)).alias("n_facts"))).withColumn(
        "legacy_synonymy", F.col("n_pairs") - F.col("n_facts") - F.col("n_passage_pairs")
    )
