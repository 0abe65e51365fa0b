"""Queries that run the engine, its tables, its files and its calls to models as a user does, each with SQL."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lorewell import schemas
from lorewell.config import EngineConfig
from lorewell.engine import Engine
from lorewell.functions import responses, text as tx
from lorewell.functions.prompts import Prompts
from lorewell.operators import calls, evaluate, graph, knn, openie, qa, retrieve, store
from lorewell.operators.models import HashedWords
from lorewell.plans import catalogue as base
from lorewell.plans.catalogue import FACT_EDGES, PROCESS, SCORES, STAR, TRIPLES, query
from lorewell.scratch import materialize, new_path
from lorewell.sources import files

#: No synonyms: no cosine exceeds 1.
PLAIN = EngineConfig(synonymy_threshold=2.0)


def _engine(spark: SparkSession, **settings) -> Engine:
    return Engine(spark, new_path(spark, "engine"), **settings)


def _texts(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return base._table(spark, sf_dir, table).select(F.col("text").alias("content"))


def _json_file(rows: DataFrame, item: Column) -> str:
    """Write one JSON array of the given texts and return its folder."""
    path = new_path(rows.sparkSession, "json")
    rows.agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]"))).coalesce(1).write.text(path)
    return path


# stores


def _vectors_sql(source: str) -> str:
    """The stand-in's vectors of ``source`` (id, content): place and value of what isn't zero."""
    return f"""words AS (SELECT id, unnest(list_filter(string_split({PROCESS.format("content")}, ' '), lambda x: x <> '')) AS w FROM {source}),
counted AS (SELECT id, CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) % 64 AS pos, count(*)::DOUBLE AS n FROM words GROUP BY 1, 2),
vectors AS (SELECT id, pos, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS v FROM counted)"""


def _sparse(rows: DataFrame, *keys: str) -> DataFrame:
    each = rows.select(*keys, F.posexplode("embedding").alias("pos", "v")).where("v <> 0")
    return each.select(*keys, F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("v"))


@query(f"""
WITH src AS (SELECT DISTINCT 'chunk-' || md5(text) AS id, text AS content FROM documents d
             WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.lang = 'en' AND e.text = d.text)), {_vectors_sql("src")}
SELECT id AS hash_id, pos, v FROM vectors""")
def store_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended, with their vectors, when all documents go into a store of the English ones."""
    docs = base._table(spark, sf_dir, "documents").withColumnRenamed("text", "content")
    have = store.keyed(docs.where("lang = 'en'").select("content"), "chunk-")
    return _sparse(store.inserted(docs.select("content"), have, HashedWords(), "chunk-"), "hash_id")


@query(f"""
WITH src AS (SELECT 'chunk-' || md5(text) AS id, text AS content FROM benchmark), {_vectors_sql("src")}
SELECT 100 - item_id AS place, pos, v FROM benchmark JOIN vectors ON id = 'chunk-' || md5(text)""")
def store_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in the order in which their keys are asked for."""
    rows = base._table(spark, sf_dir, "benchmark")
    have = store.with_embeddings(store.keyed(rows.select(F.col("text").alias("content")), "chunk-"), HashedWords())
    keys = rows.select((100 - F.col("item_id")).cast("long").alias("place"), store.hash_id_of(F.col("text"), "chunk-").alias("hash_id"))
    return _sparse(store.embeddings_in_order(have, keys), "place")


@query("""
SELECT 'id' AS kind, 'chunk-' || md5(text) AS value FROM documents WHERE text IS NOT NULL GROUP BY text
UNION ALL SELECT DISTINCT 'text', text FROM documents WHERE text IS NOT NULL""")
def store_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base._chunks(spark, sf_dir)
    return store.all_ids(rows).select(F.lit("id").alias("kind"), F.col("hash_id").alias("value")).unionByName(store.all_texts(rows).select(F.lit("text").alias("kind"), F.col("content").alias("value")))


@query("""
SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_orderstatus""")
def table_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is written, replaced by something computed from itself, and read by its name."""
    tables = files.Tables(spark, new_path(spark, "tables"))
    first = tables.replace("orders", base._table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"))
    tables.replace("orders", first.where("o_orderstatus <> 'F'"))
    tables.vacuum("orders")
    now = tables.read("orders", "o_orderkey long, o_orderstatus string")
    return now.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


# files


@query("SELECT CAST(n_nationkey AS INTEGER) AS idx, n_name || chr(10) || 'region ' || n_regionkey AS content FROM nation")
def corpus_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base._table(spark, sf_dir, "nation")
    item = F.to_json(F.struct(F.col("n_name").alias("title"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("text"), F.col("n_nationkey").alias("idx")))
    return files.corpus(spark, _json_file(rows, item)).select("idx", "content")


@query("""
SELECT CAST(o_custkey AS VARCHAR) AS id, CASE WHEN o_custkey % 2 = 0 THEN ['yes', 'really'] ELSE ['a ' || o_custkey, 'b', 'really'] END AS answers,
       list_sort(list(DISTINCT 'order ' || o_orderkey || chr(10) || o_orderstatus || '. ' || o_orderpriority || '.')) AS gold
FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey""")
def question_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as questions of a file with supporting facts, their orders as context, the dear ones supporting; answers in both forms."""
    text = lambda c: F.col(c).cast("string")
    title = F.concat(F.lit("order "), text("o_orderkey"))
    context = F.concat(F.lit('["'), title, F.lit('", ["'), text("o_orderstatus"), F.lit('.", "'), text("o_orderpriority"), F.lit('."]]'))
    fact = F.when(F.col("o_totalprice") > 300000, F.concat(F.lit('["'), title, F.lit('", 0]')))
    rows = base._table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(context), ",").alias("context"), F.array_join(F.collect_list(fact), ",").alias("facts"))
    answer = F.when(F.col("o_custkey") % 2 == 0, F.lit('"answer": "yes"')).otherwise(F.concat(F.lit('"gold_ans": ["a '), text("o_custkey"), F.lit('", "b"]')))
    item = F.concat(
        F.lit('{"id": "'), text("o_custkey"), F.lit('", "question": "?", '), answer, F.lit(', "answer_aliases": ["really"], "supporting_facts": ['), F.col("facts"),
        F.lit('], "context": ['), F.col("context"), F.lit("]}"),
    )
    asked = files.questions(spark, _json_file(rows, item))
    gold = evaluate.gold_docs(asked, evaluate.sentence_separator("any")).where(F.size("gold") > 0)
    return gold.join(evaluate.gold_answers(asked), "id").select("id", "answers", F.array_sort("gold").alias("gold"))


@query("SELECT 'chunk-' || md5(n_name) AS idx, n_name AS passage, 'region ' || n_regionkey AS object FROM nation")
def extraction_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions of a file, keyed anew by their passage."""
    region = F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))
    doc = F.struct(F.lit("old").alias("idx"), F.col("n_name").alias("passage"), F.array(region).alias("extracted_entities"), F.array(F.array(F.col("n_name"), F.lit("in"), region)).alias("extracted_triples"))
    path = new_path(spark, "json")
    base._table(spark, sf_dir, "nation").agg(F.to_json(F.struct(F.collect_list(doc).alias("docs")))).coalesce(1).write.text(path)
    return files.openie_json(spark, path, "chunk-").select("idx", "passage", F.col("extracted_triples")[0][2].alias("object"))


# responses and text


@query(r"""
WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)
SELECT item_id, CASE WHEN item_id % 4 = 3 THEN [] ELSE list_sort(list_distinct(w[1:6])) END AS entities,
       CASE WHEN item_id % 4 = 2 THEN 0 ELSE len(list_distinct(list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda z: z[1] || ' ' || z[2]))) END AS n_triples
FROM w""")
def response_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with repeats and triples of several lengths, some responses without JSON or with broken JSON."""
    b = base._table(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    n = F.col("item_id") % 4
    entities = F.concat(F.lit("Here they are: "), F.to_json(F.struct(F.concat(F.slice("w", 1, 6), F.slice("w", 1, 3)).alias("named_entities"))), F.lit(" That is all."))
    pair = F.transform(F.slice("w", F.lit(1), F.size("w") - 1), lambda x, i: F.array(x, F.lit("then"), F.get("w", i + 1)))
    triples = F.to_json(F.struct(F.concat(pair, F.transform("w", lambda x: F.array(x, x)), pair).alias("triples")))
    found = responses.valid_triples(responses.parse_triples(F.when(n == 2, F.replace(triples, F.lit("["), F.lit("("))).otherwise(triples)))
    seen = responses.parse_entities(F.when(n == 3, F.lit("I found no names.")).otherwise(entities))
    return b.select("item_id", F.array_sort(seen).alias("entities"), F.size(found).cast("long").alias("n_triples"))


@query(r"""
WITH w AS (SELECT item_id, string_split(replace(text, chr(10), ' '), ' ') AS w FROM benchmark)
SELECT item_id, CASE item_id % 3 WHEN 0 THEN [w[1] || '|' || w[2] || '|' || w[3], w[4] || '|' || w[5] || '|' || w[6]] WHEN 1 THEN [w[1] || '|it''s|x'] ELSE [] END AS facts FROM w""")
def filter_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of filter responses: in JSON, with single quotes, and none."""
    b = base._table(spark, sf_dir, "benchmark").select("item_id", F.split(F.translate("text", "\n", " "), " ").alias("w"))
    word = lambda k: F.get("w", F.lit(k))
    two = F.to_json(F.struct(F.array(F.array(word(0), word(1), word(2)), F.array(word(3), word(4), word(5))).alias("fact")))
    one = F.concat(F.lit("{'fact': [['"), word(0), F.lit("', 'it\\'s', 'x']]}"))
    n = F.col("item_id") % 3
    body = F.when(n == 0, two).when(n == 1, one).otherwise(F.lit("none of them"))
    response = F.concat(F.lit("[[ ## thought ## ]]\nhm\n\n[[ ## fact_after_filter ## ]]\n"), body, F.lit("\n\n[[ ## completed ## ]]"))
    return b.select("item_id", F.transform(responses.parse_filter(response), lambda t: F.array_join(t, "|")).alias("facts"))


@query(r"""
WITH r AS (SELECT o_custkey, '{"triples": [' || string_agg('["o' || o_orderkey || '", "is", "' || o_orderpriority || '"]', ', ' ORDER BY o_orderkey) AS whole FROM orders GROUP BY o_custkey),
c AS (SELECT o_custkey, substr(whole, 1, length(whole) - 1 - o_custkey % 9) AS cut FROM r)
SELECT o_custkey, k || repeat(']', len(k) - len(replace(k, '[', '')) - (len(k) - len(replace(k, ']', '')))) || '}' AS repaired
FROM (SELECT o_custkey, substr(cut, 1, length(cut) - strpos(reverse(cut), ',')) AS k FROM c)""")
def repaired_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses cut off at different places: back to the last comma, and closed; whole ones are left alone elsewhere."""
    o = base._table(spark, sf_dir, "orders")
    triple = F.concat(F.lit('["o'), F.col("o_orderkey").cast("string"), F.lit('", "is", "'), F.col("o_orderpriority"), F.lit('"]'))
    lists = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", triple.alias("t")))).alias("x"))
    whole = F.concat(F.lit('{"triples": ['), F.array_join("x.t", ", "))
    cut = lists.select("o_custkey", F.substring(whole, F.lit(1), (F.length(whole) - 1 - F.col("o_custkey") % 9).cast("int")).alias("cut"))
    return cut.select("o_custkey", responses.repaired(F.col("cut"), F.lit("length")).alias("repaired"))


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN true WHEN 'P' THEN true ELSE false END AS flag, 'é' || o_orderpriority || chr(92) || 'n' AS plain FROM orders""")
def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words for truth values, and escapes among other backslashes."""
    o, status = base._table(spark, sf_dir, "orders"), F.col("o_orderstatus")
    word = F.when(status == "O", "Yes").when(status == "P", "t").otherwise("FALSE")
    return o.select("o_orderkey", tx.string_to_bool(word).alias("flag"), tx.unescape_unicode(F.concat(F.lit("\\u00e9"), F.col("o_orderpriority"), F.lit("\\n"))).alias("plain"))


@query("""
WITH g AS (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS place, string_agg('order ' || o_orderkey, chr(10) ORDER BY o_orderkey) AS rest FROM orders GROUP BY o_custkey, o_orderpriority)
SELECT o_custkey, list(p || chr(10) || rest ORDER BY place) AS docs FROM g GROUP BY o_custkey""")
def merged_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of one title become one."""
    o = base._table(spark, sf_dir, "orders")
    doc = F.concat(F.col("o_orderpriority"), F.lit("\norder "), F.col("o_orderkey").cast("string"))
    lists = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", doc.alias("d")))).alias("x"))
    return lists.select("o_custkey", tx.merge_same_first_line(F.col("x.d")).alias("docs"))


# extraction


@query("""
WITH e AS (SELECT o_custkey, o_orderpriority AS e FROM orders UNION ALL SELECT o_custkey, 'order ' || o_orderkey || ' of ' || o_custkey FROM orders)
SELECT round(sum(length(e)) / count(*), 4) AS avg_ent_chars, round(sum(len(list_filter(string_split(e, ' '), lambda x: x <> ''))) / count(*), 4) AS avg_ent_words FROM e""")
def entity_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of one to four words."""
    o = base._table(spark, sf_dir, "orders")
    long = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" of "), F.col("o_custkey").cast("string"))
    return openie.stats(o.groupBy("o_custkey").agg(F.concat(F.collect_list("o_orderpriority"), F.collect_list(long)).alias("extracted_entities")))


@query("""
WITH e AS (SELECT c_nationkey AS k, list_sort(list(DISTINCT c_mktsegment)) AS e FROM customer WHERE c_custkey > 20 GROUP BY 1),
t AS (SELECT s_nationkey AS k, list_sort(list(DISTINCT s_name || '|in|' || s_nationkey)) AS t FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY 1)
SELECT 'chunk-' || md5(n_name) AS idx, coalesce(e, []) AS entities, coalesce(t, []) AS triples FROM nation LEFT JOIN e ON e.k = n_nationkey LEFT JOIN t ON t.k = n_nationkey""")
def extraction_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and triples that were found apart meet by passage; repeats and triples of other lengths go, what is missing is empty."""
    nation = base._table(spark, sf_dir, "nation")
    chunks = store.keyed(nation.select(F.col("n_name").alias("content")), "chunk-")
    idx = nation.select("n_nationkey", tx.content_key(F.col("n_name"), "chunk-").alias("idx"))
    found = base._table(spark, sf_dir, "customer").where("c_custkey > 20").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.collect_list("c_mktsegment").alias("extracted_entities"))
    triple = F.when(F.col("s_suppkey") % 3 == 0, F.array("s_name", F.lit("alone"))).otherwise(F.array("s_name", F.lit("in"), F.col("s_nationkey").cast("string")))
    twice = F.concat(F.collect_list(triple), F.collect_list(triple)).alias("extracted_triples")
    made = base._table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(twice)
    rows = openie.merged(spark.createDataFrame([], schemas.OPENIE), chunks, idx.join(found, "n_nationkey").drop("n_nationkey"), idx.join(made, "n_nationkey").drop("n_nationkey"))
    return openie.reformatted(rows).select("idx", "entities", F.array_sort(F.transform("triples", lambda t: F.array_join(t, "|"))).alias("triples"))


@query("""
SELECT DISTINCT 'chunk-' || md5(text) AS hash_id FROM documents d
WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.lang = 'en' AND e.text = d.text)""")
def extraction_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages without an extraction: the English ones have theirs, those of the German ones failed."""
    docs = base._table(spark, sf_dir, "documents").withColumnRenamed("text", "content")
    done = openie.rule_openie(store.keyed(docs.where("lang = 'en'").select("content"), "chunk-"))
    failed = openie.rule_openie(store.keyed(docs.where("lang = 'de'").select("content"), "chunk-")).withColumn("error", F.lit("down"))
    return openie.missing_chunks(base._chunks(spark, sf_dir), done.unionByName(failed)).select("hash_id")


@dataclass(frozen=True)
class Rules:
    """A chat model that answers by rules: the first three words are entities; the first is near the last."""

    model: str = "rules"
    temperature: float = 0.0
    seed: int | None = None
    parallel: int = 2

    def infer(self, messages: list[dict[str, str]], **options) -> tuple[str, dict]:
        told, words = messages[0]["content"], messages[-1]["content"].split(" ")
        meta = {"prompt_tokens": len(words), "completion_tokens": 1, "finish_reason": "stop"}
        if "named_entities" in told:
            return "Found: " + json.dumps({"named_entities": words[:3] + words[:1]}), meta
        if '"triples"' in told:
            words = messages[-1]["content"].removeprefix("Passage:\n").split("\n\nNamed entities:\n")[0].split(" ")
            return json.dumps({"triples": [[words[0], "near", words[-1]], ["only", "two"], [words[0], "near", words[-1]]]})[:-2] + ', ["cut', meta | {"finish_reason": "length"}
        return str(len(messages[-1]["content"])), meta


@query(r"""
WITH w AS (SELECT DISTINCT 'chunk-' || md5(text) AS idx, string_split(text, ' ') AS w FROM benchmark)
SELECT idx, list_sort(list_distinct(w[1:3])) AS entities, [w[1] || '|near|' || w[-1]] AS triples FROM w""")
def prompted_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, then triples, from a chat model whose second response is cut off."""
    chunks = store.keyed(_texts(spark, sf_dir, "benchmark"), "chunk-")
    rows = openie.reformatted(openie.extract_by_prompts(chunks, Rules(), Prompts.default())[0])
    return rows.select("idx", "entities", F.transform("triples", lambda t: F.array_join(t, "|")).alias("triples"))


@query("""
SELECT n_nationkey AS id, CAST(length('Which region has ' || n_name || '?') AS VARCHAR) AS response, n_regionkey < 2 AS cache_hit FROM nation
UNION ALL SELECT 100 + n_nationkey, CAST(length('Which region has ' || n_name || '?') AS VARCHAR), n_regionkey < 2 FROM nation""")
def cached_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, each prompt twice, after those of two regions were made before."""
    tables, nation = files.Tables(spark, new_path(spark, "calls")), base._table(spark, sf_dir, "nation")
    prompts = nation.select(F.col("n_nationkey").cast("long").alias("id"), "n_regionkey", calls.chat([{"role": "user", "content": "Which region has ${name}?"}], name=F.col("n_name")).alias("messages"))
    calls.ask(prompts.where("n_regionkey < 2"), Rules(), tables)
    twice = prompts.unionByName(prompts.withColumn("id", F.col("id") + 100))
    return calls.ask(twice, Rules(), tables).select("id", "response", "cache_hit")


@query("""
SELECT count(*) AS num_calls, CAST(sum(event_id) AS BIGINT) AS total_prompt_tokens, CAST(sum(user_id) AS BIGINT) AS total_completion_tokens,
       count(*) FILTER (event_type = 'click') AS num_cache_hit, count(*) FILTER (event_type = 'error') AS num_failed FROM events""")
def call_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: their numbers as tokens, clicks as hits and errors as failures."""
    kind = F.col("event_type")
    rows = base._table(spark, sf_dir, "events").select(
        F.col("event_id").cast("long").alias("prompt_tokens"), F.col("user_id").cast("long").alias("completion_tokens"), (kind == "click").alias("cache_hit"),
        F.when(kind == "error", F.lit("down")).alias("error"),
    )
    return calls.usage(rows)


# the graph


@query(f"""
WITH {STAR}, old AS (SELECT * FROM star WHERE chunk_id LIKE 'row nation %' OR chunk_id LIKE 'row supplier %')
SELECT entity AS node_id, 'entity' AS kind, entity AS content FROM (SELECT DISTINCT unnest([s, o]) AS entity FROM star EXCEPT SELECT DISTINCT unnest([s, o]) FROM old)
UNION ALL SELECT DISTINCT chunk_id, 'passage', s || ' ' || o FROM star WHERE chunk_id NOT IN (SELECT chunk_id FROM old)""")
def graph_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that customers and orders add to a graph of nations and suppliers."""

    def nodes(star: DataFrame) -> DataFrame:
        entities = openie.entities(star).select(F.col("entity").alias("hash_id"), F.col("entity").alias("content"))
        return graph.nodes(entities, star.select(F.col("chunk_id").alias("hash_id"), F.concat_ws(" ", "s", "o").alias("content")).distinct())

    star = base._star(spark, sf_dir)
    return graph.added_nodes(nodes(star.where("chunk_id like 'row nation %' or chunk_id like 'row supplier %'")), nodes(star))


@query(f"""
WITH {STAR}, {base.STAR_EDGES}
SELECT src, dst, w AS weight FROM edges WHERE src NOT LIKE 'customer %' AND dst NOT LIKE 'customer %' AND src NOT LIKE 'row order %' AND dst NOT LIKE 'row order %'""")
def graph_without_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are deleted with their edges; passages of orders are no nodes, so edges to them don't count."""
    star = base._star(spark, sf_dir)
    names = openie.entities(star).select(F.col("entity").alias("node_id")).unionByName(star.select(F.col("chunk_id").alias("node_id")).distinct())
    gone = names.where("node_id like 'customer %'")
    kept = graph.without_nodes(names.where("node_id not like 'row order %'"), gone, ("node_id",))
    rows = graph.without_nodes(base._star_edges(spark, sf_dir).where("src < dst"), gone, ("src", "dst"))
    return graph.symmetric(rows, kept)


@query(f"""
WITH {TRIPLES}, gone AS (SELECT DISTINCT 'chunk-' || md5(text) AS chunk_id FROM documents WHERE lang = 'en'),
left_over AS (SELECT * FROM triples WHERE chunk_id NOT IN (SELECT chunk_id FROM gone)),
d AS (SELECT s AS a, o AS b, 1.0 AS w FROM left_over UNION ALL SELECT o, s, 1.0 FROM left_over)
SELECT 'fact' AS kind, '(''' || s || ''', ''' || p || ''', ''' || o || ''')' AS name, 1.0::DOUBLE AS weight FROM (SELECT DISTINCT s, p, o FROM left_over)
UNION ALL SELECT 'entity', entity, 1.0 FROM (SELECT DISTINCT unnest([s, o]) AS entity FROM left_over)
UNION ALL SELECT 'passage', hash_id, 1.0 FROM chunks WHERE hash_id NOT IN (SELECT chunk_id FROM gone)
UNION ALL SELECT 'edge', 'entity-' || md5(a) || '|entity-' || md5(b), 2 * sum(w) FROM d WHERE a <> b GROUP BY a, b
UNION ALL SELECT DISTINCT 'edge', x, 1.0 FROM (SELECT unnest([chunk_id || '|entity-' || md5(s), 'entity-' || md5(s) || '|' || chunk_id, chunk_id || '|entity-' || md5(o), 'entity-' || md5(o) || '|' || chunk_id]) AS x FROM left_over)""")
def engine_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the engine holds after all documents were indexed and the English ones, with some unknown texts, deleted."""
    engine = _engine(spark, config=PLAIN)
    engine.index(_texts(spark, sf_dir, "documents"))
    english = base._table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("text").alias("content"))
    engine.delete(english.unionByName(base._table(spark, sf_dir, "nation").select(F.col("n_name").alias("content"))))
    rows = engine.facts().select(F.lit("fact").alias("kind"), F.col("content").alias("name"), F.lit(1.0).alias("weight"))
    rows = rows.unionByName(engine.entities().select(F.lit("entity").alias("kind"), F.col("content").alias("name"), F.lit(1.0).alias("weight")))
    rows = rows.unionByName(engine.chunks().select(F.lit("passage").alias("kind"), F.col("hash_id").alias("name"), F.lit(1.0).alias("weight")))
    return rows.unionByName(engine.edges().select(F.lit("edge").alias("kind"), F.concat_ws("|", "src", "dst").alias("name"), "weight"))


BENCHMARK_TRIPLES = TRIPLES.replace("FROM documents WHERE text IS NOT NULL", "FROM benchmark WHERE text IS NOT NULL")


@query(f"""
WITH {BENCHMARK_TRIPLES}, {FACT_EDGES}, src AS (SELECT DISTINCT unnest([s, o]) AS content FROM triples), named AS (SELECT 'entity-' || md5(content) AS id, content FROM src), {_vectors_sql("named")},
near AS (SELECT a.id AS src, b.id AS dst, sum(a.v * b.v) AS near FROM vectors a JOIN vectors b ON a.pos = b.pos AND a.id <> b.id JOIN named n ON n.id = a.id WHERE length(n.content) > 2 GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(near, 9) DESC, dst) AS n FROM near WHERE near >= 0.8) WHERE n <= 101),
every AS (SELECT coalesce(f.src, b.src) AS src, coalesce(f.dst, b.dst) AS dst, coalesce(near, weight) AS weight FROM fact_edges f FULL JOIN best b ON f.src = b.src AND f.dst = b.dst
          UNION ALL SELECT * FROM passage_edges)
SELECT src, dst, round(sum(weight), 6) AS weight FROM (SELECT src, dst, weight FROM every UNION ALL SELECT dst, src, weight FROM every) WHERE src <> dst GROUP BY src, dst""")
def engine_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's graph, with synonyms, when passages come in two parts."""
    engine, rows = _engine(spark), base._table(spark, sf_dir, "benchmark")
    engine.index(rows.where("text < 'O'").select(F.col("text").alias("content")))
    engine.index(rows.select(F.col("text").alias("content")))
    return engine.edges().select("src", "dst", F.round("weight", 6).alias("weight"))


# retrieval and answers

DENSE = f"""src AS (SELECT DISTINCT 'chunk-' || md5(text) AS id, text AS content FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'q' || item_id, text FROM benchmark), {_vectors_sql("src")},
pairs AS (SELECT item_id AS query_id, id AS hash_id, content FROM benchmark CROSS JOIN src WHERE id LIKE 'chunk-%'),
dots AS (SELECT a.id AS q, b.id AS k, sum(a.v * b.v) AS score FROM vectors a JOIN vectors b ON a.pos = b.pos WHERE a.id LIKE 'q%' AND b.id LIKE 'chunk-%' GROUP BY 1, 2),
scored AS (SELECT query_id, hash_id, content, coalesce(score, 0) AS score FROM pairs LEFT JOIN dots ON q = 'q' || query_id AND k = hash_id),
normal AS (SELECT query_id, hash_id, content, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS score,
                  row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, hash_id) AS rank FROM scored WINDOW w AS (PARTITION BY query_id))"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base._table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), F.col("text").alias("question"))


@query(f"WITH {DENSE} SELECT query_id, hash_id, round(score, 6) AS score, rank, 'dense' AS method FROM normal WHERE rank <= 5")
def engine_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's dense mode: all documents, asked with all benchmark texts."""
    engine = _engine(spark, mode="dense")
    engine.index(_texts(spark, sf_dir, "documents"))
    return engine.retrieve(_asked(spark, sf_dir), 5).select("query_id", "hash_id", F.round("score", 6).alias("score"), "rank", "method")


@query(f"""
WITH {DENSE} SELECT query_id, trim(regexp_extract(content, '^[^.\\n]*'), E' \\t\\n\\r') AS answer, em FROM normal
JOIN (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS em FROM benchmark) ON item_id = query_id WHERE rank = 1""")
def engine_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's answers, half of the questions with the answer itself as gold."""
    engine = _engine(spark, mode="dense")
    engine.index(_texts(spark, sf_dir, "documents"))
    out = engine.rag_qa(_asked(spark, sf_dir))[0]
    gold = out.withColumn("gold_answers", F.array(F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("The "), F.col("answer"), F.lit("!"))).otherwise(F.lit("no such thing"))))
    single = evaluate.qa_scores(gold)[1]
    return out.join(single, "query_id").select("query_id", "answer", "em")


@query(f"""
WITH {base.PAIRS}, n AS (
  SELECT item_id, p = g AS same, len(p) + len(g) AS total, list_sum(list_transform(list_distinct(p), lambda t:
    least(len(list_filter(p, lambda y: y = t)), len(list_filter(g, lambda z: z = t))))) AS common FROM pairs),
each AS (SELECT item_id, max(CASE WHEN same THEN 1.0 ELSE 0.0 END)::DOUBLE AS em, max(CASE WHEN common > 0 THEN 2 * common / total ELSE 0 END) AS f1 FROM n GROUP BY item_id)
SELECT round(avg(em), 4) AS "ExactMatch", round(avg(f1), 4) AS "F1" FROM each""")
def qa_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled scores of answers."""
    return evaluate.qa_scores(base._answers(spark, sf_dir).withColumnRenamed("item_id", "query_id"))[0]


@query(f"""
WITH {SCORES} SELECT query_id, list('vector ' || key_id ORDER BY rank) AS docs, list(CAST(round(score, 4) AS VARCHAR) ORDER BY rank) AS doc_scores FROM normal WHERE rank <= 3 GROUP BY query_id""")
def shown_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solutions as they are shown: a few passages, scores rounded."""
    top = knn.top_normalised(*base._vectors(spark, sf_dir), 10)
    rows = top.select("query_id", F.lit("?").alias("question"), "rank", F.concat(F.lit("vector "), F.col("key_id").cast("string")).alias("content"), "score")
    return qa.shown(qa.solutions(rows), 3).select("query_id", "docs", F.col("doc_scores").cast("array<string>").alias("doc_scores"))


@query(f"""
WITH {SCORES}, hits AS (
  SELECT query_id, key_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM normal JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = key_id
  WHERE rank <= 5 AND (a.label = b.label OR key_id = query_id))
SELECT query_id, key_id, rank FROM hits WHERE n <= 4""")
def filtered_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate facts that share a word with the question, four at most: vectors, named with their labels."""
    queries, keys = base._vectors(spark, sf_dir)
    labels = base._table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key_id"), F.concat(F.lit("label"), F.col("label").cast("string")).alias("o"))
    found = retrieve.fact_candidates(queries, keys).join(labels, "key_id").withColumns({"s": F.concat(F.lit("vec"), F.col("key_id").cast("string")), "p": F.lit("is")})
    asked = labels.select(F.col("key_id").cast("long").alias("query_id"), F.concat(F.lit("Near VEC"), F.col("key_id").cast("string"), F.lit(", or "), F.col("o"), F.lit("?")).alias("question"))
    return retrieve.filter_by_words(found, asked).select("query_id", "key_id", "rank")
