"""What intermediate tables leave on disk, and what isn't computed at all."""

import glob
import time

from pyspark.sql import functions as F

from lorewell import scratch
from lorewell.config import EngineConfig
from lorewell.operators import graph, knn, ppr


def _blocks(spark):
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()


def test_a_written_table_leaves_no_shuffle_files(spark):
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()
    before = _blocks(spark)
    rows = scratch.materialize(spark.range(100_000).groupBy((F.col("id") % 1013).alias("k")).count(), "disk")
    end = time.time() + 20
    while _blocks(spark) > before and time.time() < end:
        time.sleep(0.1)
    assert _blocks(spark) <= before
    assert rows.count() == 1013 and rows.agg(F.sum("count")).first()[0] == 100_000
    assert spark.conf.get(scratch.CLEANUP, "false") == "false"


def test_pagerank_by_joins_holds_one_step_on_disk(spark):
    pairs = [("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 2.0), ("c", "b", 2.0)]
    edges, seeds = spark.createDataFrame(pairs, "src string, dst string, weight double"), spark.createDataFrame([(1, "a", 1.0)], "query_id long, node_id string, weight double")
    tables = lambda: set(glob.glob(f"{scratch.root(spark).removeprefix('file:')}/lorewell-{spark.sparkContext.applicationId}/rank-*"))
    before = tables()
    found = ppr.personalized(edges, seeds, 9, EngineConfig(ppr_broadcast_edges=0))
    assert len(tables() - before) == 1
    same = {r["node_id"]: r["score"] for r in ppr.personalized(edges, seeds, 9).collect()}
    assert {r["node_id"]: round(r["score"], 12) for r in found.collect()} == {k: round(v, 12) for k, v in same.items()}


def test_no_cosine_is_computed_for_a_threshold_beyond_all(spark, monkeypatch):
    rows = spark.createDataFrame([("x", "baker", [1.0, 0.0]), ("y", "bakery", [1.0, 0.0])], "hash_id string, content string, embedding array<float>")
    assert graph.synonymy_edges(rows).count() == 2
    monkeypatch.setattr(knn, "nearest", lambda *a: 1 / 0)
    none = graph.synonymy_edges(rows, EngineConfig(synonymy_threshold=2.0))
    assert none.count() == 0 and none.columns == ["src", "dst", "weight"]


def test_packed_vectors_are_not_broadcast(spark):
    rows = spark.createDataFrame([(i, [float(i == j) for j in range(64)]) for i in range(64)], "query_id long, embedding array<double>")
    keys = rows.withColumnRenamed("query_id", "key_id")
    plan = knn.nearest(rows, keys, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
