import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lorewell.config import EngineConfig
from lorewell.operators import evaluate, graph, knn, openie, ppr, retrieve

#: Two passages; the second states one fact in two raw forms.
RAW = [("c1", [["Mara Quill", "born in", "Fenwick"]]), ("c2", [["Fenwick", "part of", "Ashdown Shire"], ["Fenwick", "part of!", "Ashdown Shire"]])]


@pytest.fixture()
def triples(spark):
    rows = [(c, c, [], t) for c, t in RAW]
    return openie.triples(spark.createDataFrame(rows, "idx string, passage string, extracted_entities array<string>, extracted_triples array<array<string>>"))


def named(edges, names):
    return {(names.get(r["src"], r["src"]), names.get(r["dst"], r["dst"])): r["weight"] for r in edges.collect()}


@pytest.fixture()
def names(triples):
    return {r["k"]: r["entity"] for r in openie.entities(triples).select(openie.entity_key(F.col("entity")).alias("k"), "entity").collect()}


def test_two_levels_of_dedupe(triples):
    assert openie.facts(triples).count() == 2
    assert {r[0] for r in openie.entities(triples).collect()} == {"mara quill", "fenwick", "ashdown shire"}
    assert {tuple(r) for r in openie.entity_degree(triples).collect()} == {("mara quill", 1), ("fenwick", 2), ("ashdown shire", 1)}


def test_weights(triples, names):
    facts = named(graph.fact_edges(triples), names)
    assert facts["fenwick", "ashdown shire"] == facts["ashdown shire", "fenwick"] == 2 and facts["mara quill", "fenwick"] == 1
    both = named(graph.symmetric(graph.directed(graph.fact_edges(triples), graph.passage_edges(triples))), names)
    assert both["mara quill", "fenwick"] == 2 and both["fenwick", "ashdown shire"] == 4 and both["c1", "fenwick"] == 1


def test_synonym_takes_the_place_of_a_count_in_one_direction(spark):
    row = "src string, dst string, weight double"
    facts = spark.createDataFrame([("a", "b", 5.0), ("b", "a", 5.0)], row)
    out = graph.directed(facts, spark.createDataFrame([], row), spark.createDataFrame([("a", "b", 0.9)], row))
    assert named(out, {}) == {("a", "b"): 0.9, ("b", "a"): 5.0}


def test_pagerank_of_the_example(triples, names, spark):
    edges = graph.symmetric(graph.directed(graph.fact_edges(triples), graph.passage_edges(triples)))
    key = {v: k for k, v in names.items()}
    reset = spark.createDataFrame([(0, key["mara quill"], 1.0), (0, key["fenwick"], 0.5), (0, "c1", 0.05)], "query_id long, node_id string, weight double")
    want = {"mara quill": 0.394719, "fenwick": 0.367357, "ashdown shire": 0.100081, "c1": 0.104875, "c2": 0.032968}
    for config in (EngineConfig(), EngineConfig(ppr_broadcast_edges=0)):
        got = {names.get(r["node_id"], r["node_id"]): r["score"] for r in ppr.personalized(edges, reset, 24, config).collect()}
        assert got == pytest.approx(want, abs=2e-6) and sum(got.values()) == pytest.approx(1)


def test_pagerank_of_a_path():
    src, dst, w = np.array([0, 1, 1, 2]), np.array([1, 0, 2, 1]), np.array([1.0, 1.0, 2.0, 2.0])
    p = w / np.bincount(src, w)[src]
    assert ppr.iterate(src, dst, p, np.array([1.0, 0, 0]), 40, 0.5) == pytest.approx([5 / 9, 1 / 3, 1 / 9])


@pytest.mark.parametrize("limit", [0, 10**6])
def test_seeds_without_edges_keep_their_mass(spark, limit):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    reset = spark.createDataFrame([(7, "a", 1.0), (7, "alone", 1.0), (7, "bad", float("nan")), (8, "alone", 2.0)], "query_id long, node_id string, weight double")
    got = {(r[0], r[1]): r[2] for r in ppr.personalized(edges, reset, 30, EngineConfig(ppr_broadcast_edges=limit)).collect()}
    assert sum(v for (q, _), v in got.items() if q == 7) == pytest.approx(1)
    assert got[8, "alone"] == pytest.approx(1) and (7, "bad") not in got


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 12), st.integers(0, 2**32 - 1))
def test_pagerank_sums_to_one_and_ignores_edge_order(n, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, n, 20), rng.integers(0, n, 20)
    src, dst, w = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(rng.random(20) + 0.1, 2)
    total = np.bincount(src, w, n)
    p, r = w / total[src], rng.dirichlet(np.ones(n))
    x = ppr.iterate(src, dst, p, r, 30, 0.5)
    o = rng.permutation(len(src))
    assert x.sum() == pytest.approx(1) and ppr.iterate(src[o], dst[o], p[o], r, 30, 0.5) == pytest.approx(x)


def test_dense_scores_agree_with_the_grid(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(300)], "key_id long, embedding array<double>")
    asked = rows.where("key_id < 40").withColumnRenamed("key_id", "query_id")
    order = ["query_id", "rank"]
    few = knn.top_normalised(asked, rows, 7).orderBy(order).toPandas()
    many = knn.top_normalised(asked, rows, 7, EngineConfig(query_block=16, synonymy_key_block=64)).orderBy(order).toPandas()
    assert few["key_id"].tolist() == many["key_id"].tolist() and np.allclose(few["score"], many["score"])


def test_equal_scores_are_one_and_go_by_id(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in (3, 1, 2)], "key_id long, embedding array<double>")
    out = knn.top_normalised(rows.where("key_id = 1").withColumnRenamed("key_id", "query_id"), rows, 2).orderBy("rank").collect()
    assert [(r["key_id"], r["score"]) for r in out] == [(1, 1.0), (2, 1.0)]


def test_no_keys_give_no_rows(spark):
    rows = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    none = spark.createDataFrame([], "key_id long, embedding array<double>")
    assert knn.top_normalised(rows, none, 3).count() == 0 and knn.nearest(rows, none, 3).count() == 0


def test_phrase_weights_average_over_occurrences(spark):
    kept = spark.createDataFrame([(0, "a", "b", 1.0), (0, "a", "c", 0.5), (0, "d", "d", 0.0)], "query_id long, s string, o string, score double")
    degree = spark.createDataFrame([("a", 2), ("b", 1)], "entity string, n_chunks long")
    got = {r["phrase"]: r["weight"] for r in retrieve.phrase_weights(kept, degree).collect()}
    assert got == {"a": 0.375, "b": 1.0, "c": 0.5}


def test_qa_metrics(spark):
    rows = spark.createDataFrame([(0, "The cat", ["a cat", "dog"]), (1, "big red dog", ["red dog house"]), (2, "x", [])], "query_id long, answer string, gold_answers array<string>")
    pooled, single = evaluate.qa_scores(rows)
    got = {r["query_id"]: (r["em"], round(r["f1"], 4)) for r in single.collect()}
    assert got == {0: (1.0, 1.0), 1: (0.0, 0.6667), 2: (0.0, 0.0)}
    assert math.isclose(pooled.first()["ExactMatch"], 0.3333)


def test_recall_never_falls_with_k(spark):
    rows = spark.createDataFrame([(0, ["a", "b", "c"], ["c", "a", "z"]), (1, ["a"], [])], "query_id long, docs array<string>, gold array<string>")
    got = [r["recall"] for r in evaluate.recall_at_k(rows)[1].where("query_id = 0").orderBy("k").collect()]
    assert got == sorted(got) and got[0] == pytest.approx(1 / 3) and got[-1] == pytest.approx(2 / 3)


def test_no_queries_give_no_rows(spark):
    none = spark.createDataFrame([], "query_id long, embedding array<double>")
    rows = spark.createDataFrame([(1, [1.0])], "key_id long, embedding array<double>")
    assert knn.top_normalised(none, rows, 3).count() == 0 and knn.all_normalised(none, rows).count() == 0
