"""Open information extraction: passages to entities, triples, facts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lorewell import schemas
from lorewell.functions.prompts import Prompts
from lorewell.functions.responses import parse_entities, parse_triples, repaired, valid_triples
from lorewell.functions.text import content_key, fact_content, text_processing
from lorewell.operators.calls import ask, chat
from lorewell.operators.models import ChatModel, Extractor
from lorewell.scratch import materialize
from lorewell.sources.files import Tables



def _no_error() -> Column:
    return F.lit(None).cast("string").alias("error")


def rule_triples(text: Column) -> Column:
    """The stand-in extractor as columns: first, second and last word of each sentence of three words or more.

    The whole text is cleaned at once, one sentence a line; a line of three words
    or more is then cut down to the three, behind a mark.
    """
    lines = F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9 .\n]", " "), ".", "\n")
    marked = F.regexp_replace(lines, r"(?m)^ *([^ \n]+) +([^ \n]+) +(?:[^\n]* )?([^ \n]+) *$", "#$1 $2 $3")
    return F.transform(F.regexp_extract_all(marked, F.lit("(?m)^#(.*)$"), 1), lambda t: F.split(t, " "))


def triple_entities(triples: Column) -> Column:
    """Distinct subjects and objects in order of appearance."""
    return F.array_distinct(F.flatten(F.transform(triples, lambda t: F.array(t[0], t[2]))))


def rule_openie(chunks: DataFrame) -> DataFrame:
    """Extraction rows of chunks (hash_id, content) by the stand-in, in the JVM."""
    raw = chunks.select(F.col("hash_id").alias("idx"), F.col("content").alias("passage"), rule_triples(F.col("content")).alias("extracted_triples"))
    return raw.select("idx", "passage", triple_entities(F.col("extracted_triples")).alias("extracted_entities"), "extracted_triples", _no_error())


def extract(chunks: DataFrame, extractor: Extractor) -> DataFrame:
    """Extraction rows of chunks (hash_id, content); one pass for entities and triples.

    A passage on which the extractor fails is empty and has its error in ``error``.
    """

    @F.arrow_udf(f"struct<e:array<string>,t:{schemas.TRIPLES},error:string>")
    def found(texts: pa.Array) -> pa.Array:
        rows = []
        for x in texts.to_pylist():
            try:
                e, t = extractor.extract(x or "")
                rows.append({"e": e, "t": t, "error": None})
            except Exception as e:  # noqa: BLE001  whatever it raises, the row says so
                rows.append({"e": [], "t": [], "error": repr(e)})
        kind = pa.struct([("e", pa.list_(pa.string())), ("t", pa.list_(pa.list_(pa.string()))), ("error", pa.string())])
        return pa.array(rows, kind)

    rows = chunks.select(F.col("hash_id").alias("idx"), F.col("content").alias("passage"), found(F.col("content")).alias("x"))
    return rows.select("idx", "passage", F.array_distinct("x.e").alias("extracted_entities"), valid_triples(F.col("x.t")).alias("extracted_triples"), "x.error")


def extract_by_prompts(chunks: DataFrame, model: ChatModel, prompts: Prompts, tables: Tables | None = None) -> tuple[DataFrame, DataFrame]:
    """Extraction rows of chunks (hash_id, content) and the calls made: entities first, then triples given the entities.

    A response that was cut off is repaired, one that can't be read gives
    nothing; a passage whose calls failed has the error in ``error``.
    """
    rows = chunks.select(F.col("hash_id").alias("idx"), F.col("content").alias("passage"))
    first = ask(rows.withColumn("messages", chat(prompts.get("entities"), passage=F.col("passage"))), model, tables, schemas.NER_JSON)
    named = first.withColumn("extracted_entities", parse_entities(repaired(F.col("response"), F.col("finish_reason"))))
    told = F.to_json(F.struct(F.col("extracted_entities").alias("named_entities")))
    asked = named.where("error is null").select("idx", chat(prompts.get("triples"), passage=F.col("passage"), named_entity_json=told).alias("messages"))
    second = ask(asked, model, tables, schemas.TRIPLE_JSON)
    found = second.select("idx", parse_triples(repaired(F.col("response"), F.col("finish_reason"))).alias("t"), F.col("error").alias("later"))
    rows = named.join(found, "idx", "left").select(
        "idx", "passage", "extracted_entities", valid_triples(F.coalesce("t", F.array().cast(schemas.TRIPLES))).alias("extracted_triples"),
        F.coalesce("error", "later").alias("error"),
    )
    counted = ("prompt_tokens", "completion_tokens", "cache_hit", "error")
    return materialize(rows, "extracted"), first.select(*counted).unionByName(second.select(*counted))


def missing_chunks(chunks: DataFrame, openie: DataFrame) -> DataFrame:
    """Chunks that have no extraction yet, or one that failed."""
    return chunks.join(openie.where("error is null").select(F.col("idx").alias("hash_id")), "hash_id", "left_anti")


def merged(openie: DataFrame, chunks: DataFrame, entities: DataFrame, triples: DataFrame) -> DataFrame:
    """Add results by chunk (idx, extracted_entities) and (idx, extracted_triples); what is missing is empty."""
    rows = chunks.select(F.col("hash_id").alias("idx"), F.col("content").alias("passage")).join(entities, "idx", "left").join(triples, "idx", "left")
    empty = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    return openie.unionByName(rows.select("idx", "passage", empty("extracted_entities", "array<string>"), empty("extracted_triples", schemas.TRIPLES), _no_error()))


def reformatted(openie: DataFrame) -> DataFrame:
    """One row per chunk: sorted distinct entities, valid triples."""
    rows = openie.dropDuplicates(["idx"])
    return rows.select("idx", "passage", F.array_sort(F.array_distinct("extracted_entities")).alias("entities"), valid_triples(F.col("extracted_triples")).alias("triples"))


def stats(openie: DataFrame) -> DataFrame:
    """Mean length of an entity in characters and in words, four places; 0 without entities."""
    phrases = openie.select(F.explode("extracted_entities").alias("e"))
    words = F.size(F.filter(F.split(F.col("e"), r"(?U)\s+"), lambda w: w != ""))
    sums = phrases.agg(F.sum(F.length("e")).alias("chars"), F.sum(words).alias("words"), F.count("e").alias("n"))
    mean = lambda c: F.when(F.col("n") > 0, F.round(F.col(c) / F.col("n"), 4)).otherwise(F.lit(0.0))
    return sums.select(mean("chars").alias("avg_ent_chars"), mean("words").alias("avg_ent_words"))


def triples(openie: DataFrame) -> DataFrame:
    """chunk_id, s, p, o: the valid raw triples of each chunk, processed; raw variants that process alike stay apart.

    ``openie`` has one row per chunk.
    """
    each = openie.select(F.col("idx").alias("chunk_id"), F.explode(valid_triples(F.col("extracted_triples"))).alias("t"))
    return each.select("chunk_id", *[text_processing(F.col("t")[i]).alias(c) for i, c in enumerate("spo")])


def facts(triples: DataFrame) -> DataFrame:
    """Distinct processed triples."""
    return triples.select("s", "p", "o").distinct()


def fact_texts(facts: DataFrame) -> DataFrame:
    return facts.select(fact_content(F.col("s"), F.col("p"), F.col("o")).alias("content"), "s", "p", "o")


def entities(triples: DataFrame) -> DataFrame:
    """Distinct subjects and objects."""
    return triples.select(F.explode(F.array("s", "o")).alias("entity")).distinct()


def entity_chunks(triples: DataFrame) -> DataFrame:
    """entity, chunk_id: which chunks mention an entity in a triple."""
    return triples.select(F.explode(F.array("s", "o")).alias("entity"), "chunk_id").distinct()


def fact_chunks(triples: DataFrame) -> DataFrame:
    """s, p, o, chunk_id: which chunks support a fact."""
    return triples.select("s", "p", "o", "chunk_id").distinct()


def fact_support(triples: DataFrame) -> DataFrame:
    """s, p, o, n_chunks."""
    return fact_chunks(triples).groupBy("s", "p", "o").agg(F.count(F.lit(1)).alias("n_chunks"))


def entity_degree(triples: DataFrame) -> DataFrame:
    """entity, n_chunks."""
    return entity_chunks(triples).groupBy("entity").agg(F.count(F.lit(1)).alias("n_chunks"))


def entity_key(entity: Column, prefix: str = "entity-") -> Column:
    return content_key(entity, prefix)
