"""Content-addressed embedding tables (hash_id, content, embedding) as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lorewell.functions.text import content_key
from lorewell.operators.models import Embedder, embed


def keyed(texts: DataFrame, prefix: str = "") -> DataFrame:
    """hash_id, content: each different text once; null texts have no key."""
    rows = texts.where("content is not null").select(content_key(F.col("content"), prefix).alias("hash_id"), "content")
    return rows.dropDuplicates(["hash_id"])


def missing(texts: DataFrame, store: DataFrame, prefix: str = "") -> DataFrame:
    """The texts, each once, that the store lacks; reads the store's keys alone."""
    return keyed(texts, prefix).join(store.select("hash_id"), "hash_id", "left_anti")


def with_embeddings(rows: DataFrame, model: Embedder) -> DataFrame:
    return rows.withColumn("embedding", embed(F.col("content"), model))


def inserted(texts: DataFrame, store: DataFrame, model: Embedder, prefix: str = "") -> DataFrame:
    """The rows to append: only missing texts are encoded, and rows that exist never change."""
    return with_embeddings(missing(texts, store, prefix), model)


def upserted(store: DataFrame, rows: DataFrame) -> DataFrame:
    return store.unionByName(rows)


def deleted(store: DataFrame, keys: DataFrame) -> DataFrame:
    """The store without the given hash_ids; unknown ones are ignored."""
    return store.join(keys.select("hash_id"), "hash_id", "left_anti")


def rows_of(store: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of the given hash_ids."""
    return store.join(keys.select("hash_id").distinct(), "hash_id")


def row_of(store: DataFrame, hash_id: str) -> DataFrame:
    return store.where(F.col("hash_id") == hash_id)


def hash_id_of(text: Column, prefix: str = "") -> Column:
    return content_key(text, prefix)


def all_ids(store: DataFrame) -> DataFrame:
    return store.select("hash_id")


def all_texts(store: DataFrame) -> DataFrame:
    return store.select("content").distinct()


def embeddings_in_order(store: DataFrame, keys: DataFrame) -> DataFrame:
    """place, hash_id, embedding for keys (place, hash_id), to be ordered by place."""
    return keys.join(store.select("hash_id", "embedding"), "hash_id").select("place", "hash_id", "embedding")
