"""Counts of edges outside of their domain against the edges themselves."""

from pyspark.sql import functions as F

from quarrygraph.operators import graph


def test_counts_of_edges_outside_their_domain(spark):
    nodes = spark.createDataFrame([("a1", "a"), ("a2", "a"), ("b1", "b"), ("c1", "c")], "id string, type string")
    edges = spark.createDataFrame([("k", "a1", "b1"), ("k", "a1", "b1"), ("k", "b1", "a1"), ("k", "a1", "c1"), ("k", "a1", "gone"), ("k", "gone", "b1"), ("l", "a1", "b1"), ("l", "a1", "b1"), ("l", "c1", "c1"), (None, "a2", "b1"), ("k", None, "b1")], "type string, source string, target string")
    allowed = spark.createDataFrame([("k", "a", "b"), ("k", "c", "a")], "type string, source_type string, target_type string")
    plain = graph.outside_domain(edges, nodes, allowed).groupBy("type", "source_type").agg(F.count(F.lit(1)).alias("n"))
    rows = lambda df: sorted(map(str, map(tuple, df.select("type", "source_type", "n").collect())))
    assert rows(graph.outside_domain_counts(edges, nodes, allowed)) == rows(plain)
