"""Personalized PageRank for many questions at once.

x' = (1 - d) r + d (P' x + r * mass of nodes without edges). A small graph (its
size is checked) is broadcast as arrays and each question iterates in numpy; a
larger one is iterated as a join and a sum per step. Each step is written and
the one before deleted, so disk holds one step's tables and shuffles at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  for pa.compute
from pyspark.sql import DataFrame, functions as F

from lorewell.config import EngineConfig
from lorewell.scratch import materialize, new_path, remove, write

DEFAULT = EngineConfig()
OUT = pa.schema([("query_id", pa.int64()), ("node_id", pa.string()), ("score", pa.float64())])


def normalised_reset(reset: DataFrame) -> DataFrame:
    """query_id, node_id, weight: negative and NaN weights are 0, and each question's weights add up to 1."""
    clean = reset.withColumn("weight", F.when(F.isnan("weight") | (F.col("weight") < 0), 0.0).otherwise(F.col("weight"))).where("weight > 0")
    summed = clean.groupBy("query_id", "node_id").agg(F.sum("weight").alias("weight"))
    total = summed.groupBy("query_id").agg(F.sum("weight").alias("total"))
    return summed.join(total, "query_id").select("query_id", "node_id", (F.col("weight") / F.col("total")).alias("weight"))


def personalized(edges: DataFrame, reset: DataFrame, steps: int | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """query_id (long), node_id, score of every node reached, for resets (query_id, node_id, weight).

    ``edges`` (src, dst, weight) are symmetric. Scores of a question add up to 1.
    """
    steps = config.ppr_steps if steps is None else steps
    r = materialize(normalised_reset(reset), "reset")
    if edges.limit(config.ppr_broadcast_edges + 1).count() <= config.ppr_broadcast_edges:
        return _in_numpy(edges, r, steps, config.damping)
    return _as_joins(edges, r, steps, config.damping)


def iterate(src: np.ndarray, dst: np.ndarray, p: np.ndarray, reset: np.ndarray, steps: int, damping: float) -> np.ndarray:
    """The iteration on arrays; ``p`` is the share of an edge in its source's weight."""
    n, x = len(reset), reset
    linked = np.zeros(n, bool)
    linked[src] = True
    for _ in range(steps):
        moved = np.bincount(dst, p * x[src], n) if len(src) else np.zeros(n)
        x = (1 - damping) * reset + damping * (moved + reset * x[~linked].sum())
    return x


def _in_numpy(edges: DataFrame, reset: DataFrame, steps: int, damping: float) -> DataFrame:
    table = edges.select("src", "dst", "weight").toArrow()
    names = pa.chunked_array([*table["src"].chunks, *table["dst"].chunks], pa.string()).unique()
    if isinstance(names, pa.ChunkedArray):
        names = names.combine_chunks()
    at = lambda c: pa.compute.index_in(table[c], names).to_numpy().astype(np.int32)
    src, dst = at("src"), at("dst")
    w = table["weight"].to_numpy()
    p = w / np.bincount(src, w, len(names))[src] if len(src) else w
    shared = edges.sparkSession.sparkContext.broadcast((names, src, dst, p))

    def run(group: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        names, src, dst, p = shared.value
        own = pc.index_in(group["node_id"], names)
        lone = group.filter(pc.is_null(own))  # seeds without edges
        every = pa.concat_arrays([names, lone["node_id"].combine_chunks().cast(pa.string())])
        r = np.zeros(len(every))
        r[: len(names)] = np.bincount(own.drop_null().to_numpy(), group.filter(pc.is_valid(own))["weight"].to_numpy(), len(names)) if len(names) else 0
        r[len(names) :] = lone["weight"].to_numpy()
        x = iterate(src, dst, p, r, steps, damping)
        seen = np.flatnonzero(x > 0)
        return pa.table([pa.array(np.full(len(seen), group["query_id"][0].as_py())), every.take(pa.array(seen)), pa.array(x[seen])], schema=OUT)

    return reset.select(F.col("query_id").cast("long").alias("query_id"), "node_id", "weight").groupBy("query_id").applyInArrow(run, "query_id long, node_id string, score double")


def _as_joins(edges: DataFrame, reset: DataFrame, steps: int, damping: float) -> DataFrame:
    degree = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = materialize(edges.join(degree, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")), "shares")
    linked = materialize(degree.select(F.col("src").alias("node_id"), F.lit(True).alias("linked")), "linked")
    r = materialize(reset.join(linked, "node_id", "left").select(F.col("query_id").cast("long").alias("query_id"), "node_id", F.col("weight").alias("r"), F.coalesce("linked", F.lit(False)).alias("linked")), "reset")
    x, last = r.select("query_id", "node_id", F.col("r").alias("x")), None
    for _ in range(steps):
        # only seeds can be without edges: all other mass arrives over an edge
        lost = x.join(r.where("not linked").select("query_id", "node_id"), ["query_id", "node_id"], "left_semi").groupBy("query_id").agg(F.sum("x").alias("lost"))
        moved = x.join(share, x["node_id"] == share["src"]).groupBy("query_id", F.col("dst").alias("node_id")).agg(F.sum(F.col("x") * F.col("p")).alias("x"))
        back = r.join(lost, "query_id", "left").select(
            "query_id", "node_id", (F.col("r") * (F.lit(1 - damping) + F.lit(damping) * F.coalesce("lost", F.lit(0.0)))).alias("x")
        )
        x = moved.select("query_id", "node_id", (F.lit(damping) * F.col("x")).alias("x")).unionByName(back).groupBy("query_id", "node_id").agg(F.sum("x").alias("x"))
        path = new_path(edges.sparkSession, "rank")
        x = write(x, path)
        if last:
            remove(edges.sparkSession, last)
        last = path
    return x.select("query_id", "node_id", F.col("x").alias("score"))
