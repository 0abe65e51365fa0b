"""Reading corpora and questions; tables in versioned folders."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType, VariantType

from lorewell import schemas
from lorewell.functions.text import content_key
from lorewell.scratch import materialize, write

#: Name of a pointer file: its number and the version it puts in force.
POINTER = re.compile(r"_V(\d{12})-([0-9a-f]{32})")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """content: title, line end, text; from a JSON array of {title, text, idx}."""
    rows = spark.read.schema(schemas.CORPUS).json(path, multiLine=True)
    return rows.select(F.concat_ws("\n", "title", "text").alias("content"), "title", "text", "idx")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """The questions of a JSON array with whatever gold fields they carry.

    Answer fields may be a string or a list. ``supporting_facts`` ([title, number])
    give supporting_titles; ``context`` has [title, [sentences]].
    """
    wanted = StructType.fromDDL(schemas.QUESTIONS)
    as_is = [f for f in wanted if f.name not in (*schemas.STRING_OR_LIST, *schemas.MIXED, "supporting_titles")]
    schema = StructType([*as_is, *[StructField(c, VariantType()) for c in (*schemas.STRING_OR_LIST, *schemas.MIXED)]])
    rows = spark.read.schema(schema).json(path, multiLine=True)
    get = F.try_variant_get
    parts = F.transform(get("context", "$", "array<variant>"), lambda c: F.struct(get(c, "$[0]", "string").alias("title"), get(c, "$[1]", "array<string>").alias("sentences")))
    titles = F.transform(get("supporting_facts", "$", "array<variant>"), lambda x: get(x, "$[0]", "string"))
    made = {"supporting_titles": titles, "context": parts} | {c: _strings(F.col(c)) for c in schemas.STRING_OR_LIST}
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in wanted.names])


def _strings(value: Column) -> Column:
    """The strings of a variant that is a string or a list of them."""
    one = F.try_variant_get(value, "$", "string")
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<string>")).when(one.isNotNull(), F.array(one))


def texts(spark: SparkSession, docs: list[str] | DataFrame) -> DataFrame:
    """content, of a list of strings or of a DataFrame with a column content."""
    return docs.select("content") if isinstance(docs, DataFrame) else spark.createDataFrame([(d,) for d in docs], "content string")


def openie_json(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Extraction results of a JSON file {docs: [...]}, keyed anew by their passage."""
    rows = spark.read.schema(f"docs array<struct<idx:string,passage:string,extracted_entities:array<string>,extracted_triples:{schemas.TRIPLES}>>")
    docs = rows.json(path, multiLine=True).select(F.inline("docs"))
    return docs.withColumns({"idx": content_key(F.col("passage"), prefix), "error": F.lit(None).cast("string")})


class Tables:
    """Named Parquet tables under one root, each version in a folder of its own.

    A new version is written beside the old one and then named in a pointer
    file of the next number; the pointer with the highest number is in force and
    none is ever overwritten. So a table may be replaced by something computed
    from itself, and whenever a write breaks off, the version before it holds.
    Of two writers at once one fails. ``vacuum`` deletes what isn't in force.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self, name: str) -> list[str]:
        fs, folder = self._fs(), self._path(name)
        return sorted(x.getPath().getName() for x in fs.listStatus(folder) if POINTER.fullmatch(x.getPath().getName())) if fs.exists(folder) else []

    def version(self, name: str) -> str | None:
        """The version in force, by the name that its pointer ends with."""
        pointers = self._pointers(name)
        return POINTER.fullmatch(pointers[-1])[2] if pointers else None

    def read(self, name: str, schema: str) -> DataFrame:
        """The current version; an empty table if there is none."""
        version = self.version(name)
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{version}")

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """Write a new version and make it the current one."""
        pointers, version = self._pointers(name), uuid.uuid4().hex
        written = write(df, f"{self.root}/{name}/{version}")
        number = int(POINTER.fullmatch(pointers[-1])[1]) + 1 if pointers else 1
        self._point(name, number, version)
        return written

    def _point(self, name: str, number: int, version: str) -> None:
        own = f"_V{number:012d}-{version}"
        self._fs().create(self._path(name, own), False).close()  # empty: the name says all, so no half-written pointer can be read
        rivals = [p for p in self._pointers(name) if p.startswith(f"_V{number:012d}-") and p != own]
        if rivals:
            self._fs().delete(self._path(name, own), False)
            raise RuntimeError(f"table {name} was replaced by another writer meanwhile")

    def vacuum(self, name: str) -> None:
        """Delete all versions but the one in force; call when nothing reads them any more."""
        fs, current = self._fs(), self.version(name)
        for pointer in self._pointers(name)[:-1]:
            fs.delete(self._path(name, pointer), False)
        for x in fs.listStatus(self._path(name)) if current else []:
            if x.isDirectory() and x.getPath().getName() != current:
                fs.delete(x.getPath(), True)

    def clear(self) -> None:
        self._fs().delete(self._path(), True)


def cache_key(messages: Column, model: str, seed: int | None = None, temperature: float = 0.0, with_seed: bool = True) -> Column:
    """Key of a model call: SHA-256 of the JSON of messages and settings, fields in order of name."""
    fields = [messages.alias("messages"), F.lit(model).alias("model")]
    if with_seed:
        fields.append(F.lit(seed).cast("int").alias("seed"))
    fields.append(F.lit(float(temperature)).alias("temperature"))
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def through_cache(calls: DataFrame, cache: DataFrame, run) -> tuple[DataFrame, DataFrame]:
    """Answer calls (key, ...) from the cache (key, message, metadata); ``run`` answers the others, each key once.

    ``run`` gives key, message, metadata and, if it knows failures, error.
    Returns the answers (key, message, metadata, error, cache_hit) and the new
    rows, of which the caller appends those without error to the cache. The new rows are written once, so no call is
    made again when either is read.
    """
    keyed = calls.dropDuplicates(["key"])
    none = F.lit(None).cast("string").alias("error")
    hits = cache.join(keyed.select("key"), "key", "left_semi").select("key", "message", "metadata", none).withColumn("cache_hit", F.lit(True))
    made = run(keyed.join(cache.select("key"), "key", "left_anti"))
    fresh = materialize(made.select("key", "message", "metadata", "error" if "error" in made.columns else none), "answers")
    return hits.unionByName(fresh.withColumn("cache_hit", F.lit(False))), fresh
