"""Model calls, the retry machine on a stream, and retrieval for many queries, against plain loops and single calls."""

import datetime
import random
import time

from pyspark.sql import functions as F

from quarrygraph.operators import calls, retrieval, vector
from quarrygraph.streaming import intake


def test_calls_are_bounded_and_errors_are_data(spark):
    def connect():
        import time

        def client(prompt):
            n = int(prompt)
            if n % 5 == 1:
                raise ValueError(f"no {n}")
            time.sleep(30 if n % 20 == 2 else 0.05)
            return f"reply {n}"

        return client

    df = spark.range(40).coalesce(1).select(F.col("id"), F.when(F.col("id") != 3, F.col("id").cast("string")).alias("text"), F.lit("old").alias("reply"))
    began = time.time()
    rows = calls.with_replies(df, F.col("text"), connect, in_flight=4, deadline=1.5).collect()
    assert time.time() - began < 25  # two calls hang
    assert [r.id for r in rows] == list(range(40))
    for r in rows:
        if r.id == 3:
            assert (r.reply, r.error, r.attempts) == (None, "no prompt", 0)
        elif r.id % 5 == 1:
            assert (r.reply, r.error, r.attempts) == (None, f"ValueError: no {r.id}", 2)
        elif r.id % 20 == 2:
            assert r.reply is None and r.error == "timed out" and 1 < r.seconds < 10
        else:
            assert (r.reply, r.error, r.attempts) == (f"reply {r.id}", None, 1)
    assert calls.with_replies(df.limit(0), F.col("text"), connect).count() == 0


def test_fallback_of_a_reply(spark):
    rows = spark.createDataFrame([("a", None), ("  ", None), ("b", "late"), (None, None)], "r string, e string").select(calls.or_fallback(F.col("r"), F.col("e"), F.lit("f")).alias("x")).collect()
    assert [r.x for r in rows] == ["a", "f", "f", "f"]


def test_retry_states_go_on_after_a_stop(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    parts = [
        [(1, "report", None, at(0)), (2, "report", None, at(0)), (3, "report", None, at(0)), (3, "ticket", None, at(1)), (4, "report", None, at(0)), (None, "report", None, at(0)), (5, "odd", True, at(0)), (6, "attempt", False, at(0))],
        [(1, "attempt", False, at(2)), (2, "attempt", False, at(2)), (2, "attempt", False, at(3))],
        [(1, "attempt", True, at(3)), (1, "attempt", False, at(4)), (2, "attempt", False, at(4)), (2, "attempt", True, at(5)), (3, "attempt", True, at(5)), (4, "attempt", False, at(5))],
        [(9, "report", None, at(10_000))], [(9, "report", None, at(10_001))],
    ]
    schema = "event_id long, kind string, passed boolean, at timestamp"
    for part in parts:  # the query is started anew for each
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withWatermark("at", "1 minute")
        intake.run_available(intake.retry_states(stream), lambda batch, n: batch.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/state")
    rows = sorted((r.event_id, r.retries, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert rows == [(1, 2, "fixed"), (2, 3, "gave_up"), (3, 0, "similar_ticket"), (4, 1, "timed_out"), (6, 1, "timed_out")]


def test_retry_states_time_out_alike_in_any_time_zone(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    schema, zone = "event_id long, kind string, passed boolean, at timestamp", spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        for part in ([(1, "report", None, at(0))], [(9, "report", None, at(30))], [(1, "attempt", True, at(40))]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withWatermark("at", "1 minute")
            intake.run_available(intake.retry_states(stream), lambda batch, n: batch.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/state")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [(r.event_id, r.retries, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1, 1, "fixed")]


def test_many_queries_equal_single_ones(spark):
    rng = random.Random(2)
    names = [f"n{i}" for i in range(60)]
    nodes = spark.createDataFrame([(f"id{i}", n) for i, n in enumerate(names)], "id string, name string")
    edges = spark.createDataFrame([("k", f"id{rng.randrange(60)}", f"id{rng.randrange(70)}", i) for i in range(90)], "type string, source string, target string, ord long")
    vectors = spark.createDataFrame([(f"id{i}", None if i % 9 == 0 else [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)], "id string, embedding array<double>")
    asked = [(q, None if q == 7 else [rng.gauss(0, 1) for _ in range(4)], rng.sample(names, rng.randint(0, 2)) + ["nobody"]) for q in range(130)]  # over two masks
    best, between = retrieval.retrieve_subgraphs(nodes, edges, vectors, spark.createDataFrame(asked, "query_id long, query array<double>, entities array<string>"), 2, 1, 6)
    found, links = {}, {}
    for r in best.collect():
        found.setdefault(r.query_id, []).append((r.rank, r.id, round(r.score, 9)))
    for r in between.collect():
        links.setdefault(r.query_id, set()).add((r.type, r.source, r.target))
    assert 7 not in found and len(found) == 129
    for q in (0, 61, 62, 129):
        one, own = retrieval.retrieve_subgraph(nodes, edges, vectors, asked[q][1], asked[q][2], 2, 1, 6)
        assert sorted(found[q]) == [(i + 1, r.id, round(r.score, 9)) for i, r in enumerate(sorted(one.collect(), key=lambda r: (-r.score, r.id)))]
        assert links.get(q, set()) == {tuple(r) for r in own.collect()}


def test_batches_of_queries_equal_single_searches(spark):
    rng = random.Random(3)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(700)], "vec_id long, embedding array<double>")
    rows = vector.batch_top_k(v, v, 2)
    got = {(r.query_id, r.rank): r.vec_id for r in rows.collect()}
    assert len(got) == 1400
    for q in (0, 300, 699):
        query = v.where(F.col("vec_id") == q).first().embedding
        assert [r.vec_id for r in vector.top_k(v.where(F.col("vec_id") != q), query, 2).collect()] == [got[q, 1], got[q, 2]]
    assert vector.batch_top_k(v, v.limit(0), 2).count() == 0


def test_cells_equal_plain_search_and_recall(spark):
    import numpy as np

    from quarrygraph.operators import cells

    rng = np.random.default_rng(2)
    x = rng.standard_normal((30, 12))[rng.integers(0, 30, 3000)] + 0.5 * rng.standard_normal((3000, 12))
    rows = [(i, v.tolist(), i % 5) for i, v in enumerate(x)] + [(5000, None, 1), (5001, [0.0] * 12, 1), (5002, [1.0], 1), (5003, [float("nan")] * 12, 1), (5004, [None] * 12, 1), (7, x[7].tolist(), 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    index = cells.build_index(v, cells.fit_centres(v, 40))
    assert index.rows.count() == 3001 and len(index.cells) > 20
    asked = v.where("vec_id % 60 = 0 or vec_id >= 5000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    score = unit @ unit.T
    found = {}
    for r in cells.above_threshold(index, asked, 0.8, 100_000).collect():
        found.setdefault(r.query_id, set()).add(r.id)
    assert {q: s for q, s in found.items()} == {q: s for q in range(0, 3000, 60) if (s := {int(i) for i in np.flatnonzero(score[q] >= 0.8) if i != q})}
    # only cells that can hold such rows are read
    read = cells._scored(index, cells._probes(index, cells._asked(asked, F.lit(float(np.arccos(0.8)))), None, None), None, False).count()
    assert read < 0.6 * 50 * 3000
    for types in (None, (1, 3)):
        best = {q: [int(i) for i in np.argsort(-score[q]) if i != q and (types is None or i % 5 in types)][:10] for q in range(0, 3000, 60)}
        exact, near = ({}, {})
        for out, probes in ((exact, None), (near, 8)):
            for r in cells.nearest(index, asked, 10, probes, types).orderBy("query_id", "rank").collect():
                out.setdefault(r.query_id, []).append(r.id)
        assert all(len(set(exact[q]) & set(best[q])) >= 9 for q in best) and set(exact) == set(best)
        assert np.mean([len(set(near[q]) & set(best[q])) / 10 for q in best]) >= 0.9
    none = cells.build_index(v.limit(0), cells.fit_centres(v.limit(0), 4))
    assert cells.above_threshold(none, asked).count() == 0 and cells.nearest(none, asked, 3).count() == 0
