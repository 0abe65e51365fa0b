"""Dense scores and exact nearest neighbours, block by block with numpy.

A small set of queries (its size is checked) is broadcast and the keys are
scanned once where they lie: each Arrow batch gives its own top k and range,
and only those meet in a shuffle. With more queries, or for a self-join, both
sides are packed into blocks and every pair of blocks is one row of work, so
neither side has to fit anywhere whole. Ranks are by the score rounded to nine
places, then by id, so that equal products can't swap places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lorewell.config import EngineConfig
from lorewell.functions.vectors import matrix, min_max, unit_rows
from lorewell.scratch import materialize

DEFAULT = EngineConfig()
PLACES = 9


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (rounded score descending, id)."""
    rounded = np.round(scores, PLACES)
    at = np.arange(len(ids))
    if k < len(ids):
        at = np.flatnonzero(rounded >= np.partition(rounded, len(ids) - k)[len(ids) - k])
    return at[np.lexsort((ids[at], -rounded[at]))][:k]


def ranked(scores: DataFrame, k: int, name: str = "rank") -> DataFrame:
    """The k best of each query (query_id, key_id, score) with their rank from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", PLACES)), "key_id")
    return scores.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def _schema(queries: DataFrame, keys: DataFrame) -> tuple[str, pa.Schema]:
    kinds = queries.schema["query_id"].dataType, keys.schema["key_id"].dataType
    ddl = f"query_id {kinds[0].simpleString()}, key_id {kinds[1].simpleString()}, score double, low double, high double"
    arrow = [("query_id", to_arrow_type(kinds[0])), ("key_id", to_arrow_type(kinds[1]))]
    return ddl, pa.schema([*arrow, *[(c, pa.float64()) for c in ("score", "low", "high")]])


def _scan(keys: DataFrame, ids: list, q: np.ndarray, k: int | None, ddl: str, arrow: pa.Schema, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        for b in batches:
            if not b.num_rows or not ids:
                continue
            names, m = b.column("key_id"), matrix(b.column("embedding"))
            own = names.to_numpy(zero_copy_only=False)
            for i, s in zip(ids, q @ m.T):
                at = np.arange(len(s)) if k is None else _best(s, own, k)
                n = len(at)
                low, high = pa.array(np.full(n, s.min())), pa.array(np.full(n, s.max()))
                yield pa.RecordBatch.from_arrays([pa.array([i] * n, arrow.field(0).type), names.take(pa.array(at)), pa.array(s[at]), low, high], schema=arrow)

    return keys.select("key_id", "embedding").mapInArrow(run, ddl)


def scores(queries: DataFrame, keys: DataFrame, k: int | None, config: EngineConfig = DEFAULT) -> DataFrame:
    """query_id, key_id, score, low, high: dot products with keys (key_id, embedding) for queries (query_id, embedding).

    ``low`` and ``high`` are the range within the block that a row comes from.
    With ``k`` a block returns its k best rows alone, else all rows.
    """
    ddl, arrow = _schema(queries, keys)
    head = queries.select("query_id", "embedding").limit(config.query_block + 1).toArrow()
    if head.num_rows <= config.query_block:
        ids, q = head["query_id"].to_pylist(), matrix(head["embedding"].combine_chunks())
        shared = keys.sparkSession.sparkContext.broadcast((ids, q))
        return _scan(keys, ids, q, k, ddl, arrow, shared)
    return _grid(queries, keys, k, config.query_block, config.synonymy_key_block, None, ddl, arrow)


def _packed(rows: DataFrame, key: str, size: int, name: str) -> tuple[DataFrame, int]:
    """Blocks of about ``size`` rows, each one row: block, ids, vectors."""
    blocks = max(1, -(-rows.count() // size))
    kind = rows.schema[key].dataType
    arrow = pa.schema([("block", pa.int32()), ("ids", pa.list_(to_arrow_type(kind))), ("vectors", pa.binary())])

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        m = matrix(table["embedding"].combine_chunks())
        ids = pa.array([table[key].to_pylist()], arrow.field("ids").type)
        return pa.table([table["block"].slice(0, 1).cast(pa.int32()), ids, pa.array([m.tobytes()], pa.binary())], schema=arrow)

    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), key, "embedding")
    return materialize(dealt.groupBy("block").applyInArrow(pack, f"block int, ids array<{kind.simpleString()}>, vectors binary"), name), blocks


def _grid(queries: DataFrame, keys: DataFrame, k: int | None, query_block: int, key_block: int, threshold: float | None, ddl: str, arrow: pa.Schema) -> DataFrame:
    q, _ = _packed(queries, "query_id", query_block, "queries")
    d, n = _packed(keys, "key_id", key_block, "keys")
    q = q.select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a_ids, a, b_ids, v in zip(*[b.column(c) for c in ("q_ids", "q", "ids", "vectors")]):
                a_ids, names = a_ids.as_py(), b_ids.values
                own = names.to_numpy(zero_copy_only=False)
                left, right = (np.frombuffer(x.as_buffer(), np.float64) for x in (a, v))
                left, right = left.reshape(len(a_ids), -1), right.reshape(len(own), -1)
                for i, s in zip(a_ids, left @ right.T):
                    at = np.arange(len(s)) if k is None else _best(s, own, k)
                    if threshold is not None:
                        at = at[s[at] >= threshold]
                    m = len(at)
                    if m:
                        low, high = pa.array(np.full(m, s.min())), pa.array(np.full(m, s.max()))
                        yield pa.RecordBatch.from_arrays([pa.array([i] * m, arrow.field(0).type), names.take(pa.array(at)), pa.array(s[at]), low, high], schema=arrow)

    # the files of packed vectors are far smaller than the vectors, so their size mustn't decide on a broadcast
    return q.join(d.hint("merge"), "block").select("q_ids", "q", "ids", "vectors").mapInArrow(run, ddl)


def ranges(found: DataFrame) -> DataFrame:
    """query_id, low, high over all blocks."""
    return found.groupBy("query_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def top_normalised(queries: DataFrame, keys: DataFrame, k: int, config: EngineConfig = DEFAULT) -> DataFrame:
    """query_id, key_id, score, rank: the k best keys of each query, scores min-max normalised over all keys.

    No keys give no rows; if all scores of a query are equal they are 1.
    """
    found = materialize(scores(queries, keys, k, config), "scores")
    best = ranked(found.drop("low", "high"), k)
    return best.join(F.broadcast(ranges(found)) if queries.limit(config.query_block + 1).count() <= config.query_block else ranges(found), "query_id").select(
        "query_id", "key_id", min_max(F.col("score"), F.col("low"), F.col("high")).alias("score"), "rank"
    )


def all_normalised(queries: DataFrame, keys: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """query_id, key_id, score of all keys, min-max normalised: one row for each query and key."""
    found = materialize(scores(queries, keys, None, config), "scores")
    return found.select("query_id", "key_id", "score").join(ranges(found), "query_id").select(
        "query_id", "key_id", min_max(F.col("score"), F.col("low"), F.col("high")).alias("score")
    )


def nearest(queries: DataFrame, keys: DataFrame, k: int, threshold: float | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """query_id, key_id, score, rank: exact k nearest keys by cosine; with ``threshold`` only those at least that near.

    A zero vector has similarity 0 with everything. No keys give no rows.
    """
    ddl, arrow = _schema(queries, keys)
    return ranked(_grid(_units(queries, "query_id"), _units(keys, "key_id"), k, config.synonymy_query_block, config.synonymy_key_block, threshold, ddl, arrow).drop("low", "high"), k)


def _units(rows: DataFrame, key: str) -> DataFrame:
    @F.arrow_udf("array<double>")
    def unit(v: pa.Array) -> pa.Array:
        m = unit_rows(matrix(v))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, max(1, m.shape[1] if m.size else 1), dtype=np.int32)[: len(v) + 1]), pa.array(m.ravel()))

    return rows.select(key, unit(F.col("embedding")).alias("embedding"))
