"""Hybrid search and store operators on small tables."""

from pyspark.sql import functions as F

from lodestone.operators import hybrid as H
from lodestone.operators import relational as R

HITS = "doc_id long, text string, heading string, content_type string, vector_score double, rrf double, keyword_rank long, exact boolean, graph boolean"


def test_rerank_by_hand(spark):
    rows = [
        (1, "The warranty period of AB-12 is 30 days", "1. Warranty", "table", 0.5, 0.03, 0, True, True),
        (2, None, None, None, None, None, None, None, None),
        (3, "Test corpus: should return ? ? ? ? ? ?", "x", "text", 0.5, 0.03, 40, False, False),
        (4, "", "x", "text", 0.0, 0.0, None, False, False),
    ]
    asked = H.Question("Which warranty period has AB-12?", ["AB-12"], ["warranty", "period"], r"\d+ days", numeric=True)
    got = {r["doc_id"]: r["rerank_score"] for r in H.rerank(spark.createDataFrame(rows, HITS), asked, 10).collect()}
    first = 1.6 * 0.5 + 1.2 * 0.03 + 1.0 + 0.5 + 0.35 + 0.8 + 0.5 + 0.05 * 3 + 0.55 + 0.3 + 0.3
    assert got == {1: round(first, 4), 2: -0.35, 3: round(0.8 + 0.036 - (1.0 + 0.5) - 0.35, 4), 4: -0.35}


def test_rerank_without_shape(spark):
    rows = [(2, "a", "h", "text", 0.1, 0.0, None, False, False), (1, "a", "h", "text", 0.1, 0.0, None, False, False), (3, "a", "h", "text", 0.1, 0.1, None, False, False)]
    got = H.rerank(spark.createDataFrame(rows, HITS), H.Question("?"), 2)
    assert [(r["doc_id"], r["rerank_score"]) for r in got.collect()] == [(3, 0.28), (1, 0.16)]


def test_hybrid_fills_cosines_and_filters(spark):
    chunks = spark.createDataFrame([(1, "a", "text"), (2, "b", "table"), (3, "c", "table")], "doc_id long, text string, content_type string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "doc_id long, embedding array<double>")
    one = lambda *r: spark.createDataFrame(list(r), "doc_id long, score double")
    lists = {"vector": (one((1, 1.0)), 1.0), "keyword": (one((2, 3.0), (3, 2.0)), 1.2)}
    got = [tuple(r) for r in H.hybrid(chunks, vectors, [1.0, 0.0], lists).select("doc_id", "rrf", "keyword_rank", "vector_score").orderBy("doc_id").collect()]
    assert got == [(1, round(1 / 61, 5), None, 1.0), (2, round(1.2 / 61, 5), 0, 0.6), (3, round(1.2 / 62, 5), 1, 0.0)]
    only = H.hybrid(chunks, vectors, [1.0, 0.0], lists, content_types=["text"])
    assert [r["doc_id"] for r in only.collect()] == [1]
    empty = {"vector": (one(), 1.0)}
    assert H.hybrid(chunks, vectors, [1.0, 0.0], empty).count() == 0


def test_replaced_and_repaired_with_nulls(spark):
    stored = spark.createDataFrame([(1, "a"), (None, "n"), (2, "b")], "k long, v string")
    rows = spark.createDataFrame([(None, "new"), (3, "c")], "k long, v string")
    assert sorted(map(tuple, R.replaced(stored, rows, ["k"]).collect()), key=repr) == sorted([(1, "a"), (2, "b"), (None, "new"), (3, "c")], key=repr)
    parents = spark.createDataFrame([(1, 5), (2, 7)], "k long, n int")
    kids = spark.createDataFrame([(1,), (1,)], "k long")
    assert sorted(map(tuple, R.repaired(parents, kids, "k", "n").collect())) == [(1, 2), (2, 0)]


def test_node_search_takes_signs_as_they_are(spark):
    nodes = spark.createDataFrame([("a%b", "A%B", 1), ("axb", "AxB", 9), ("a_b", "A_B", 3)], "norm string, name string, mentions long")
    assert [r["norm"] for r in R.find_nodes(nodes, "A%").collect()] == ["a%b"]
    assert [r["norm"] for r in R.find_nodes(nodes, "a", 2).collect()] == ["axb", "a_b"]


def test_documents_of_mentions(spark):
    rows = spark.createDataFrame([(1, "x", 3), (1, "x", 1), (1, "x", 3), (2, None, None)], "doc_id long, doc_name string, page int")
    got = sorted(map(tuple, R.mention_documents(rows).collect()))
    assert got == [(1, "x", [1, 3]), (2, None, [])]
    assert R.graph_totals(rows.withColumn("node", F.col("doc_id")), rows).first().asDict() == {"nodes": 2, "mentions": 4, "edges": 4}
