"""Queries over the engine's own operators, each with SQL that must give the same rows.

Scores are ranked on nine places and shown on six, since two engines may add
up a sum in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lorewell.config import EngineConfig
from lorewell.functions import responses, text as tx
from lorewell.functions.vectors import min_max
from lorewell.operators import evaluate, graph, knn, openie, ppr, qa, retrieve, store
from lorewell.scratch import materialize

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = EngineConfig()
#: Which rows of a table of vectors serve as queries: every one whose id this divides.
QUERY_STEP = 20
#: The synthetic vectors are far apart.
NEAR = 0.4
STEPS = 20

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as chunks (hash_id, content)."""
    return store.keyed(_table(spark, sf_dir, "documents").select(F.col("text").alias("content")), CONFIG.chunk_prefix)


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return openie.triples(openie.rule_openie(_chunks(spark, sf_dir)))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _table(spark, sf_dir, "embeddings")
    return retrieve.query_vectors(rows.where(F.col("vec_id") % QUERY_STEP == 0)), rows.select(F.col("vec_id").alias("key_id"), "embedding")


def _six(c: str) -> Column:
    return F.round(c, 6).alias(c)


# SQL building blocks

CHUNKS = "chunks AS (SELECT DISTINCT 'chunk-' || md5(text) AS hash_id, text AS content FROM documents WHERE text IS NOT NULL)"
PROCESS = r"trim(regexp_replace(lower({}), '[^A-Za-z0-9 ]', ' ', 'g'), ' ')"
SENTENCES = f"""sentences AS (
  SELECT hash_id, i, list_filter(string_split_regex({PROCESS.format("sentence")}, ' +'), lambda x: x <> '') AS w
  FROM (SELECT hash_id, unnest(string_split_regex(content, '[.\\n]')) AS sentence, generate_subscripts(string_split_regex(content, '[.\\n]'), 1) AS i FROM chunks))"""
TRIPLES = f"""{CHUNKS}, {SENTENCES},
raw AS (SELECT hash_id AS chunk_id, i, w[1] AS s, w[2] AS p, w[-1] AS o FROM sentences WHERE len(w) >= 3),
triples AS (SELECT DISTINCT chunk_id, s, p, o FROM raw)"""
ENTITY = "'entity-' || md5({})"
DOT = "list_sum(list_transform(list_zip({0}::DOUBLE[], {1}::DOUBLE[]), lambda z: z[1] * z[2]))"
SCORES = f"""q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % {QUERY_STEP} = 0),
raw AS (SELECT q.query_id, k.vec_id AS key_id, {DOT.format("q.embedding", "k.embedding")} AS score FROM q, embeddings k),
normal AS (
  SELECT query_id, key_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, key_id) AS rank,
         CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0
              ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS score
  FROM raw WINDOW w AS (PARTITION BY query_id))"""


# keys, stores and text


@query("SELECT DISTINCT 'chunk-' || md5(text) AS hash_id, text AS content FROM documents WHERE text IS NOT NULL")
def chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)


@query("""
SELECT DISTINCT 'chunk-' || md5(text) AS hash_id, text AS content FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.lang = 'en' AND e.text = d.text)""")
def store_insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents go into a store that has the English ones."""
    docs = _table(spark, sf_dir, "documents").withColumnRenamed("text", "content")
    return store.missing(docs.select("content"), store.keyed(docs.where("lang = 'en'").select("content"), "chunk-"), "chunk-")


@query("""
SELECT DISTINCT 'chunk-' || md5(text) AS hash_id, text AS content FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.lang = 'en' AND e.text = d.text)""")
def store_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The English documents leave a store that has all."""
    docs = _table(spark, sf_dir, "documents").withColumnRenamed("text", "content")
    return store.deleted(_chunks(spark, sf_dir), store.keyed(docs.where("lang = 'en'").select("content"), "chunk-"))


@query("""
SELECT DISTINCT 'chunk-' || md5(text) AS hash_id, text AS content FROM documents d
WHERE EXISTS (SELECT 1 FROM documents e WHERE e.lang = 'en' AND e.text = d.text)""")
def store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-look-up of the English documents' keys."""
    docs = _table(spark, sf_dir, "documents").where("lang = 'en'")
    return store.rows_of(_chunks(spark, sf_dir), docs.select(store.hash_id_of(F.col("text"), "chunk-").alias("hash_id")))


@query(f"SELECT doc_id, {PROCESS.format('text')} AS processed, len(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS alnum FROM documents")
def text_processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", tx.text_processing(text).alias("processed"), tx.alnum_length(text).cast("long").alias("alnum"))



@query(r"""
SELECT item_id, trim(regexp_replace(array_to_string(list_transform(
  string_split_regex(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'),
  lambda x: CASE WHEN x IN ('a', 'an', 'the') THEN '' ELSE x END), ' '), '\s+', ' ', 'g')) AS normal FROM benchmark""")
def normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select("item_id", tx.normalize_answer(F.col("text")).alias("normal"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# extraction


@query(f"WITH {TRIPLES} SELECT chunk_id, s, p, o FROM triples")
def openie_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triples(spark, sf_dir)


@query(f"""
WITH {TRIPLES}, e AS (SELECT DISTINCT chunk_id, unnest([s, o]) AS entity FROM raw)
SELECT round(sum(length(entity)) / count(*), 4) AS avg_ent_chars, 1.0::DOUBLE AS avg_ent_words FROM e""")
def openie_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return openie.stats(openie.rule_openie(_chunks(spark, sf_dir)))


@query(f"WITH {TRIPLES} SELECT DISTINCT unnest([s, o]) AS entity FROM triples")
def entity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return openie.entities(_triples(spark, sf_dir))


@query(f"WITH {TRIPLES} SELECT DISTINCT '(''' || s || ''', ''' || p || ''', ''' || o || ''')' AS content, s, p, o FROM triples")
def facts_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return openie.fact_texts(openie.facts(_triples(spark, sf_dir)))


@query(f"WITH {TRIPLES} SELECT s, p, o, count(DISTINCT chunk_id) AS n_chunks FROM triples GROUP BY s, p, o")
def fact_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return openie.fact_support(_triples(spark, sf_dir))


@query(f"WITH {TRIPLES} SELECT entity, count(DISTINCT chunk_id) AS n_chunks FROM (SELECT chunk_id, unnest([s, o]) AS entity FROM triples) GROUP BY entity")
def entity_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return openie.entity_degree(_triples(spark, sf_dir))


# the graph

FACT_EDGES = f"""fact_edges AS (
  SELECT src, dst, count(*)::DOUBLE AS weight FROM (
    SELECT {ENTITY.format("s")} AS src, {ENTITY.format("o")} AS dst FROM triples
    UNION ALL SELECT {ENTITY.format("o")}, {ENTITY.format("s")} FROM triples) GROUP BY src, dst),
passage_edges AS (SELECT DISTINCT chunk_id AS src, {ENTITY.format("unnest([s, o])")} AS dst, 1.0::DOUBLE AS weight FROM triples)"""


@query(f"WITH {TRIPLES}, {FACT_EDGES} SELECT * FROM fact_edges")
def fact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fact_edges(_triples(spark, sf_dir))


@query(f"WITH {TRIPLES}, {FACT_EDGES} SELECT * FROM passage_edges")
def passage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.passage_edges(_triples(spark, sf_dir))


@query(f"""
WITH {TRIPLES}, {FACT_EDGES}, every AS (SELECT * FROM fact_edges UNION ALL SELECT * FROM passage_edges)
SELECT src, dst, sum(weight) AS weight FROM (
  SELECT src, dst, weight FROM every UNION ALL SELECT dst, src, weight FROM every) WHERE src <> dst GROUP BY src, dst""")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = materialize(_triples(spark, sf_dir), "triples")
    return graph.symmetric(graph.directed(graph.fact_edges(triples), graph.passage_edges(triples)))


@query(f"""
WITH {TRIPLES}, {FACT_EDGES}, e AS (SELECT DISTINCT unnest([s, o]) AS entity FROM triples)
SELECT *, n_pairs - n_facts - n_passage_pairs AS legacy_synonymy, n_phrase_nodes + n_passage_nodes AS n_total_nodes FROM (
  SELECT (SELECT count(*) FROM e) AS n_phrase_nodes, (SELECT count(*) FROM chunks) AS n_passage_nodes,
         (SELECT count(*) FROM fact_edges) + (SELECT count(*) FROM passage_edges) AS n_pairs,
         (SELECT count(*) FROM passage_edges) AS n_passage_pairs, 0::BIGINT AS n_synonym,
         (SELECT count(*) FROM (SELECT DISTINCT s, p, o FROM triples)) AS n_facts)""")
def graph_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, triples = _chunks(spark, sf_dir), materialize(_triples(spark, sf_dir), "triples")
    entities = openie.entities(triples).select(openie.entity_key(F.col("entity")).alias("hash_id"), F.col("entity").alias("content"))
    edges = graph.directed(graph.fact_edges(triples), graph.passage_edges(triples))
    return graph.info(graph.nodes(entities, chunks), edges, openie.facts(triples))


COSINE = f"""cosine AS (
  SELECT a.vec_id AS query_id, b.vec_id AS key_id,
         {DOT.format("a.embedding", "b.embedding")} / sqrt({DOT.format("a.embedding", "a.embedding")}) / sqrt({DOT.format("b.embedding", "b.embedding")}) AS score
  FROM embeddings a, embeddings b)"""


@query(f"""
WITH {COSINE} SELECT query_id, key_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, key_id) AS rank FROM cosine) WHERE rank <= 10""")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector, exactly."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key_id"), "embedding")
    return knn.nearest(rows.withColumnRenamed("key_id", "query_id"), rows, 10).select("query_id", "key_id", _six("score"), "rank")


@query(f"""
WITH {COSINE}, near AS (
  SELECT query_id AS src, key_id AS dst, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, key_id) AS n
  FROM cosine WHERE query_id <> key_id AND score >= {NEAR} AND length(CAST(query_id AS VARCHAR)) > 2)
SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, round(score, 6) AS weight FROM near WHERE n <= 101""")
def synonymy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as entities that are named by their numbers."""
    name = F.col("vec_id").cast("string")
    rows = _table(spark, sf_dir, "embeddings").select(name.alias("hash_id"), name.alias("content"), "embedding")
    return graph.synonymy_edges(rows, EngineConfig(synonymy_threshold=NEAR)).select("src", "dst", _six("weight"))


@query(f"""
WITH {COSINE}, e AS (SELECT vec_id, label FROM embeddings),
facts AS (SELECT a.vec_id AS src, b.vec_id AS dst, 1.0::DOUBLE AS weight FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND a.label = b.label),
syn AS (SELECT query_id AS src, key_id AS dst, round(score, 6) AS near FROM cosine WHERE query_id <> key_id AND score >= {NEAR} AND length(CAST(query_id AS VARCHAR)) > 2),
every AS (SELECT coalesce(f.src, s.src) AS src, coalesce(f.dst, s.dst) AS dst, coalesce(near, weight) AS weight
          FROM facts f FULL JOIN syn s ON f.src = s.src AND f.dst = s.dst)
SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, round(sum(weight), 6) AS weight FROM (
  SELECT src, dst, weight FROM every UNION ALL SELECT dst, src, weight FROM every) GROUP BY src, dst""")
def synonymy_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts join neighbours of one label; synonyms take their place direction by direction."""
    name = F.col("vec_id").cast("string")
    rows = _table(spark, sf_dir, "embeddings")
    syn = graph.synonymy_edges(rows.select(name.alias("hash_id"), name.alias("content"), "embedding"), EngineConfig(synonymy_threshold=NEAR))
    a, b = rows.select("vec_id", "label").alias("a"), rows.select("vec_id", "label").alias("b")
    facts = a.join(b, (F.col("b.vec_id") == F.col("a.vec_id") + 1) & (F.col("a.label") == F.col("b.label")))
    facts = facts.select(F.col("a.vec_id").cast("string").alias("src"), F.col("b.vec_id").cast("string").alias("dst"), F.lit(1.0).alias("weight"))
    none = facts.where("false")
    return graph.symmetric(graph.directed(facts, none, syn.select("src", "dst", _six("weight")))).select("src", "dst", _six("weight"))


@query(f"""
WITH {TRIPLES}, gone AS (SELECT DISTINCT 'chunk-' || md5(text) AS chunk_id FROM documents WHERE lang = 'en'),
kept AS (SELECT * FROM triples WHERE chunk_id NOT IN (SELECT chunk_id FROM gone))
SELECT 'fact' AS kind, s || '|' || p || '|' || o AS name FROM (SELECT DISTINCT s, p, o FROM kept)
UNION ALL SELECT 'entity', entity FROM (SELECT DISTINCT unnest([s, o]) AS entity FROM kept)""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and entities that live on when the English documents go."""
    docs = _table(spark, sf_dir, "documents").where("lang = 'en'")
    gone = store.keyed(docs.select(F.col("text").alias("content")), "chunk-").select(F.col("hash_id").alias("chunk_id"))
    kept = materialize(_triples(spark, sf_dir).join(gone, "chunk_id", "left_anti"), "kept")
    facts = openie.facts(kept).select(F.lit("fact").alias("kind"), F.concat_ws("|", "s", "p", "o").alias("name"))
    return facts.unionByName(openie.entities(kept).select(F.lit("entity").alias("kind"), F.col("entity").alias("name")))


# scores and retrieval


@query(f"WITH {SCORES} SELECT query_id, key_id, round(score, 6) AS score, rank FROM normal WHERE rank <= 10")
def dense_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, keys = _vectors(spark, sf_dir)
    return knn.top_normalised(queries, keys, 10).select("query_id", "key_id", _six("score"), "rank")


@query(f"WITH {SCORES} SELECT query_id, key_id, round(score, 6) AS score FROM normal")
def fact_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, keys = _vectors(spark, sf_dir)
    return knn.all_normalised(queries, keys).select("query_id", "key_id", _six("score"))


@query(f"WITH {SCORES} SELECT query_id, key_id, round(score, 6) AS score, rank FROM normal WHERE rank <= 5")
def top_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, keys = _vectors(spark, sf_dir)
    return retrieve.fact_candidates(queries, keys).select("query_id", "key_id", _six("score"), "rank")


def _star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of the star schema; each source row is a passage."""
    name = lambda kind, c: F.concat(F.lit(f"{kind} "), F.col(c).cast("string"))

    def rows(table: str, kind: str, key: str, predicate: str, other: str, foreign: str) -> DataFrame:
        t = _table(spark, sf_dir, table)
        return t.select(name(f"row {kind}", key).alias("chunk_id"), name(kind, key).alias("s"), F.lit(predicate).alias("p"), name(other, foreign).alias("o"))

    parts = [
        rows("nation", "nation", "n_nationkey", "in", "region", "n_regionkey"),
        rows("supplier", "supplier", "s_suppkey", "in", "nation", "s_nationkey"),
        rows("customer", "customer", "c_custkey", "in", "nation", "c_nationkey"),
        rows("orders", "order", "o_orderkey", "placed by", "customer", "o_custkey"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


STAR = """star AS (
  SELECT 'row nation ' || n_nationkey AS chunk_id, 'nation ' || n_nationkey AS s, 'in' AS p, 'region ' || n_regionkey AS o FROM nation
  UNION ALL SELECT 'row supplier ' || s_suppkey, 'supplier ' || s_suppkey, 'in', 'nation ' || s_nationkey FROM supplier
  UNION ALL SELECT 'row customer ' || c_custkey, 'customer ' || c_custkey, 'in', 'nation ' || c_nationkey FROM customer
  UNION ALL SELECT 'row order ' || o_orderkey, 'order ' || o_orderkey, 'placed by', 'customer ' || o_custkey FROM orders)"""
DEGREE = "degree AS (SELECT entity, count(DISTINCT chunk_id) AS n FROM (SELECT chunk_id, unnest([s, o]) AS entity FROM star) GROUP BY entity)"
#: The kept facts of five questions, one for each region: where its nations lie, scored by nation.
KEPT = """kept AS (
  SELECT n_regionkey AS query_id, 'nation ' || n_nationkey AS s, 'region ' || n_regionkey AS o, 1.0 / (1 + n_nationkey) AS score FROM nation)"""
PHRASES = """phrases AS (
  SELECT query_id, phrase, weight FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 9) DESC, phrase) AS n FROM (
      SELECT query_id, phrase, avg(score / greatest(1, coalesce(n, 0))) AS weight
      FROM (SELECT query_id, unnest([s, o]) AS phrase, score FROM kept) k LEFT JOIN degree d ON d.entity = k.phrase GROUP BY query_id, phrase))
  WHERE n <= 5 AND weight > 0)"""
SEEDS = """seeds AS (
  SELECT CAST(query_id AS BIGINT) AS query_id, phrase AS node_id, weight FROM phrases
  UNION ALL SELECT n_regionkey, 'row nation ' || n_nationkey, 0.05 * n_nationkey / 24 FROM nation)"""


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation")
    name = lambda kind, c: F.concat(F.lit(f"{kind} "), F.col(c).cast("string"))
    return n.select(
        F.col("n_regionkey").cast("long").alias("query_id"), name("nation", "n_nationkey").alias("s"), F.lit("in").alias("p"),
        name("region", "n_regionkey").alias("o"), (F.lit(1.0) / (1 + F.col("n_nationkey"))).alias("score"),
    )


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.phrase_weights(_kept(spark, sf_dir), openie.entity_degree(_star(spark, sf_dir)))


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = _phrases(spark, sf_dir).withColumnRenamed("phrase", "node_id")
    passages = _table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").cast("long").alias("query_id"), F.concat(F.lit("row nation "), F.col("n_nationkey").cast("string")).alias("node_id"),
        (F.col("n_nationkey") / 24).alias("score"),
    )
    return retrieve.reset_weights(phrases, passages)


def _star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = _star(spark, sf_dir)
    ends = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    facts = star.select(F.explode(F.array(ends("s", "o"), ends("o", "s"))).alias("e")).groupBy("e.src", "e.dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    passages = star.select(F.col("chunk_id").alias("src"), F.explode(F.array("s", "o")).alias("dst")).distinct().withColumn("weight", F.lit(1.0))
    return graph.symmetric(graph.directed(facts, passages))


STAR_EDGES = """directed AS (
  SELECT src, dst, count(*)::DOUBLE AS w FROM (SELECT s AS src, o AS dst FROM star UNION ALL SELECT o, s FROM star) GROUP BY src, dst
  UNION ALL SELECT DISTINCT chunk_id, unnest([s, o]), 1.0::DOUBLE FROM star),
edges AS (
  SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM directed UNION ALL SELECT dst, src, w FROM directed) WHERE src <> dst GROUP BY src, dst),
share AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM edges)"""
RANKED = f"""reset AS (SELECT query_id, node_id, sum(weight) / sum(sum(weight)) OVER (PARTITION BY query_id) AS r FROM seeds WHERE weight > 0 GROUP BY query_id, node_id),
ppr AS (
  SELECT 0 AS t, query_id, node_id, r AS x FROM reset
  UNION ALL
  SELECT t, query_id, node_id, sum(x) FROM (
    SELECT t + 1 AS t, query_id, dst AS node_id, 0.5 * x * p AS x FROM ppr JOIN share ON src = node_id WHERE t < {STEPS}
    UNION ALL SELECT t + 1, query_id, node_id, 0.5 * r FROM (SELECT DISTINCT t FROM ppr) CROSS JOIN reset WHERE t < {STEPS})
  GROUP BY t, query_id, node_id)"""


@query(f"WITH {STAR}, {DEGREE}, {KEPT}, {PHRASES} SELECT CAST(query_id AS BIGINT) AS query_id, phrase, round(weight, 6) AS weight FROM phrases")
def phrase_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrases(spark, sf_dir).select("query_id", "phrase", _six("weight"))


@query(f"""
WITH {STAR}, {DEGREE}, {KEPT}, {PHRASES}, {SEEDS}
SELECT query_id, node_id, round(sum(weight) / sum(sum(weight)) OVER (PARTITION BY query_id), 6) AS weight FROM seeds WHERE weight > 0 GROUP BY query_id, node_id""")
def reset_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppr.normalised_reset(_seeds(spark, sf_dir)).select("query_id", "node_id", _six("weight"))


@query(f"""
WITH RECURSIVE {STAR}, {DEGREE}, {KEPT}, {PHRASES}, {SEEDS}, {STAR_EDGES}, {RANKED}
SELECT query_id, node_id, round(x, 6) AS score FROM ppr WHERE t = {STEPS} AND round(x, 6) > 0""")
def personalized_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ppr.personalized(_star_edges(spark, sf_dir), _seeds(spark, sf_dir), STEPS)
    return found.select("query_id", "node_id", _six("score")).where("score > 0")


@query(f"""
WITH RECURSIVE {STAR}, {DEGREE}, {KEPT}, {PHRASES}, {SEEDS}, {STAR_EDGES}, {RANKED}
SELECT query_id, node_id, round(x, 6) AS score FROM ppr WHERE t = {STEPS} AND round(x, 6) > 0""")
def personalized_pagerank_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by joins, as for a graph too large to broadcast."""
    found = ppr.personalized(_star_edges(spark, sf_dir), _seeds(spark, sf_dir), STEPS, EngineConfig(ppr_broadcast_edges=0))
    return found.select("query_id", "node_id", _six("score")).where("score > 0")


@query(f"""
WITH RECURSIVE {STAR}, {DEGREE}, {KEPT}, {PHRASES}, {SEEDS}, {STAR_EDGES}, {RANKED},
found AS (SELECT query_id, node_id AS key_id, x, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9) DESC, node_id) AS rank
          FROM ppr WHERE t = {STEPS} AND node_id LIKE 'row %')
SELECT query_id, key_id, round(x, 6) AS score, rank FROM found WHERE rank <= 200""")
def graph_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = _star(spark, sf_dir).select(F.col("chunk_id").alias("node_id")).distinct()
    found = retrieve.graph_ranked(_star_edges(spark, sf_dir), _seeds(spark, sf_dir), passages, CONFIG.retrieval_topk, EngineConfig(ppr_steps=STEPS))
    return found.select("query_id", "key_id", _six("score"), "rank")


@query(f"""
WITH {SCORES}, facts AS (SELECT DISTINCT query_id FROM normal JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = key_id
                         WHERE rank BETWEEN 2 AND 5 AND a.label = b.label)
SELECT query_id, key_id, round(score, 6) AS score, rank, CASE WHEN query_id IN (SELECT query_id FROM facts) THEN 'graph' ELSE 'dense' END AS method
FROM normal WHERE rank <= CASE WHEN query_id IN (SELECT query_id FROM facts) THEN 5 ELSE 10 END""")
def dense_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose next neighbours hold one of their label keep five rows; the others fall back to ten dense ones."""
    queries, keys = _vectors(spark, sf_dir)
    top = materialize(knn.top_normalised(queries, keys, 10), "top")
    labels = _table(spark, sf_dir, "embeddings").select("vec_id", "label")
    near = top.where("rank between 2 and 5").join(labels.withColumnsRenamed({"vec_id": "query_id", "label": "own"}), "query_id")
    near = near.join(labels.withColumnsRenamed({"vec_id": "key_id"}), "key_id").where("own = label")
    by_graph = top.where("rank <= 5").join(near.select("query_id").distinct(), "query_id", "left_semi")
    return retrieve.with_fallback(by_graph, top).select("query_id", "key_id", _six("score"), "rank", "method")


# evaluation and answers


@query(f"""
WITH {SCORES}, gold AS (SELECT q.query_id, k.vec_id AS key_id FROM q JOIN embeddings e ON e.vec_id = q.query_id JOIN embeddings k ON k.label = e.label),
each AS (
  SELECT g.query_id, k.k, count(n.key_id) / count(*) AS recall FROM gold g CROSS JOIN (SELECT unnest([1, 2, 5, 10, 20, 30, 50, 100, 150, 200]) AS k) k
  LEFT JOIN normal n ON n.query_id = g.query_id AND n.key_id = g.key_id AND n.rank <= k.k GROUP BY g.query_id, k.k)
SELECT k, round(avg(recall), 4) AS recall FROM each GROUP BY k""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved vectors against those of the query's label."""
    queries, keys = _vectors(spark, sf_dir)
    labels = _table(spark, sf_dir, "embeddings").select("vec_id", "label")
    top = knn.top_normalised(queries, keys, max(evaluate.RECALL_AT))
    docs = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("key_id").cast("string").alias("d")))).alias("d"))
    by_label = labels.groupBy("label").agg(F.collect_list(F.col("vec_id").cast("string")).alias("gold"))
    asked = labels.join(queries.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi")
    gold = asked.join(by_label, "label").select(F.col("vec_id").alias("query_id"), "gold")
    return evaluate.recall_at_k(docs.select("query_id", F.col("d.d").alias("docs")).join(gold, "query_id"))[0]


WORDS = r"list_filter(string_split_regex(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the'))"
PAIRS = f"""pairs AS (
  SELECT a.item_id, {WORDS.format("a.text")} AS p, {WORDS.format("b.text")} AS g FROM benchmark a JOIN benchmark b
  ON b.item_id IN (a.item_id // 2, a.item_id + 1))"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text as an answer; the text of half its number and the next one are gold."""
    b = _table(spark, sf_dir, "benchmark")
    gold = b.select(F.col("item_id").alias("id"), F.col("text").alias("gold"))
    return b.join(gold, (F.col("id") == F.floor(F.col("item_id") / 2)) | (F.col("id") == F.col("item_id") + 1)).groupBy("item_id").agg(
        F.first("text").alias("answer"), F.collect_list("gold").alias("gold_answers")
    )


@query(f"WITH {PAIRS} SELECT item_id, max(CASE WHEN p = g THEN 1.0 ELSE 0.0 END)::DOUBLE AS em FROM pairs GROUP BY item_id")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("item_id", evaluate.exact_match(F.col("answer"), F.col("gold_answers")).alias("em"))


@query(f"""
WITH {PAIRS}, n AS (
  SELECT item_id, len(p) + len(g) AS total, list_sum(list_transform(list_distinct(p), lambda t:
    least(len(list_filter(p, lambda y: y = t)), len(list_filter(g, lambda z: z = t))))) AS common FROM pairs)
SELECT item_id, round(max(CASE WHEN common > 0 THEN 2 * common / total ELSE 0 END), 6) AS f1 FROM n GROUP BY item_id""")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("item_id", F.round(evaluate.token_f1(F.col("answer"), F.col("gold_answers")), 6).alias("f1"))


@query(f"""
WITH {SCORES}
SELECT query_id, string_agg('Wikipedia Title: vector ' || key_id || chr(10) || chr(10), '' ORDER BY rank) || 'Question: what is near ' || query_id || '?' || chr(10) || 'Thought: ' AS prompt
FROM normal WHERE rank <= 5 GROUP BY query_id""")
def qa_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, keys = _vectors(spark, sf_dir)
    top = knn.top_normalised(queries, keys, 10)
    rows = top.select("query_id", F.concat(F.lit("what is near "), F.col("query_id").cast("string"), F.lit("?")).alias("question"), "rank", F.concat(F.lit("vector "), F.col("key_id").cast("string")).alias("content"), "score")
    return qa.solutions(rows).select("query_id", tx.qa_prompt(F.col("docs"), F.col("question"), 5).alias("prompt"))


@query(r"""
SELECT item_id, trim(text, E' \n\t') AS answer, text AS whole FROM benchmark""")
def answer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer of a response that holds one, and of one that doesn't."""
    b = _table(spark, sf_dir, "benchmark")
    with_answer = F.concat(F.lit("A thought. Answer: "), F.col("text"), F.lit(" \nAnswer: another"))
    return b.select("item_id", tx.parse_answer(with_answer).alias("answer"), tx.parse_answer(F.col("text")).alias("whole"))


@query("""
SELECT item_id, text AS entity, 2 AS n_triples FROM benchmark""")
def response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and triples out of the JSON that a model puts among other words."""
    b = _table(spark, sf_dir, "benchmark")
    quoted = F.to_json(F.struct(F.array("text").alias("named_entities")))
    one = F.array(F.col("text"), F.lit("is"), F.lit("x"))
    triples = F.to_json(F.struct(F.array(one, F.array(F.lit("a"), F.lit("b")), one, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("triples")))
    found = responses.valid_triples(responses.parse_triples(F.concat(F.lit("Here: "), triples)))
    return b.select("item_id", responses.parse_entities(F.concat(F.lit("Here: "), quoted, F.lit(" done")))[0].alias("entity"), F.size(found).alias("n_triples"))


@query("SELECT item_id, text AS object FROM benchmark")
def filter_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept fact of a filter response."""
    fact = F.to_json(F.struct(F.array(F.array(F.lit("s"), F.lit("p"), F.col("text"))).alias("fact")))
    response = F.concat(F.lit("[[ ## fact_after_filter ## ]]\n"), fact, F.lit("\n\n[[ ## completed ## ]]"))
    return _table(spark, sf_dir, "benchmark").select("item_id", responses.parse_filter(response)[0][2].alias("object"))


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS id, list_sort(list(DISTINCT 'order ' || o_orderkey || chr(10) || o_orderpriority)) AS gold
FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' GROUP BY c_custkey""")
def gold_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as questions, their orders as paragraphs, open ones as supporting."""
    o = _table(spark, sf_dir, "orders")
    p = F.struct(
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), F.lit(None).cast("string").alias("text"),
        F.col("o_orderpriority").alias("paragraph_text"), (F.col("o_orderstatus") != "F").alias("is_supporting"),
    )
    none = lambda t: F.lit(None).cast(t)
    rows = o.groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.collect_list(p).alias("paragraphs")).withColumns({
        "supporting_titles": none("array<string>"), "context": none("array<struct<title:string,sentences:array<string>>>"),
        "contexts": none("array<struct<title:string,text:string,is_supporting:boolean>>"),
    })
    return evaluate.gold_docs(rows).where(F.size("gold") > 0).select("id", F.array_sort("gold").alias("gold"))


@query("""
SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 2 = 0 THEN [n_name, 'alias ' || n_name] ELSE ['region ' || n_regionkey, 'alias ' || n_name] END AS answers FROM nation""")
def gold_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as questions; every other one has its answer in another field."""
    n = _table(spark, sf_dir, "nation")
    none = lambda: F.lit(None).cast("array<string>")
    rows = n.select(
        F.col("n_nationkey").cast("string").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.array("n_name")).alias("answer"), none().alias("gold_ans"),
        F.array(F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))).alias("reference"), none().alias("obj"), none().alias("possible_answers"),
        none().alias("o_wiki_title"), none().alias("o_aliases"), F.array(F.concat(F.lit("alias "), F.col("n_name"))).alias("answer_aliases"),
    )
    return evaluate.gold_answers(rows)


def queries() -> dict[str, Query]:
    from lorewell.plans import engine_queries  # noqa: F401  adds its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
