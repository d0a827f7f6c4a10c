"""Searches by products of blocks against plain ones: ties, odd vectors, filters, and no pairs in any plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrygraph.operators import cells, dense, retrieval, vector


def _rows(df):
    return sorted((r.query_id, r["rank"], r[2], round(r.score, 9)) for r in df.collect())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(params=[None, 3])
def small(request, monkeypatch):
    """Blocks of a few rows and groups of a few blocks, or one group."""
    if request.param:
        monkeypatch.setattr(dense, "BLOCK_BYTES", 7 * 8 * 6)
        monkeypatch.setattr(dense, "GROUP_BYTES", 5 * 7 * 8 * 6)
        monkeypatch.setattr(dense, "WAITING_PAIRS", 20)


def _equal_ones(n=400):
    x = np.random.default_rng(4).standard_normal((n, 6))
    x[::3] = x[0]  # a third of all are one vector
    return x


def _best(x, q, k, ok=lambda i: True, least=-2.0):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    score = (u * u[q]).sum(axis=1)
    return [(q, n + 1, i, round(float(score[i]), 9)) for n, i in enumerate(sorted((i for i in range(len(x)) if i != q and ok(i) and score[i] >= least), key=lambda i: (-score[i], i))[:k])]


def test_batches_by_blocks(spark, small):
    x = _equal_ones()
    odd = [(900, [float("nan")] * 6, 0), (901, [float("inf")] + [1.0] * 5, 0), (902, None, 0), (903, [1.0, 2.0], 0), (904, [0.0] * 6, 0), (None, x[0].tolist(), 0)]
    v = spark.createDataFrame([(i, r.tolist(), i % 4) for i, r in enumerate(x)] + odd, "vec_id long, embedding array<double>, label int").repartition(3)
    found = vector.batch_top_k(v, v.where("vec_id % 9 = 0 or vec_id >= 900"), 7)
    assert _rows(found) == sorted(t for q in range(0, 400, 9) for t in _best(x, q, 7))
    assert "Join" not in _plan(found)  # pairs stay in the tasks
    named = v.select(F.concat(F.lit("n"), "vec_id").alias("id"), "embedding")
    asked = v.where("vec_id in (0, 10)").select(F.col("vec_id").alias("id"), "embedding")
    assert [r.id for r in vector.batch_top_k(named, asked, 3, id_col="id", itself=True).where("query_id = 0").orderBy("rank").collect()] == ["n0", "n102", "n105"]


def test_thresholds_of_cells_by_blocks(spark, small):
    x = _equal_ones()
    v = spark.createDataFrame([(i, r.tolist(), i % 4) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    index = cells.build_index(v, cells.fit_centres(v, 9))
    asked = v.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = cells.above_threshold(index, asked, 0.5, 6)
    assert _rows(found) == sorted(t for q in range(0, 400, 9) for t in _best(x, q, 6, least=0.5))
    assert "Join" not in _plan(found)


def test_filtered_cells_by_blocks(spark, small):
    x = _equal_ones()
    v = spark.createDataFrame([(i, r.tolist(), i % 4) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    index = cells.build_index(v, cells.fit_centres(v, 9))
    asked = v.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = cells.nearest(index, asked, 8, types=(1, 3))
    assert _rows(found) == sorted(t for q in range(0, 400, 9) for t in _best(x, q, 8, lambda i: i % 4 in (1, 3)))
    assert "Join" not in _plan(found)


def test_reach_of_many_queries_keeps_to_wanted_nodes(spark):
    """A hub with many neighbours, few of which have a vector: the last step goes to those only, and edges between best nodes alone are grouped."""
    edges = spark.createDataFrame([("in", f"c{i}", "hub", i) for i in range(300)] + [("in", "hub", "top", 300), ("in", "c1", "hub", 301)], "type string, source string, target string, ord long")
    seeds = spark.createDataFrame([("c0", 0, 1), ("c1", 0, 2), ("top", 1, 4)], "id string, block long, mask long")
    wanted = spark.createDataFrame([("c2",), ("c1",), ("c299",), ("hub",)], "id string")
    got = sorted(tuple(r) for r in retrieval.reached_by(seeds, edges, 2, wanted).collect())
    assert got == sorted([("c1", 0, 3), ("c1", 1, 4), ("c2", 0, 3), ("c2", 1, 4), ("c299", 0, 3), ("c299", 1, 4), ("hub", 0, 3), ("hub", 1, 4)])
    assert len(retrieval.reached_by(seeds, edges, 2).select("id").distinct().collect()) == 302
