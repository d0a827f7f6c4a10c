"""Bounded paths against plain counting and SQL: equal edges, loops, missing ends, repeated starts, and what is dealt out."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrygraph.operators import graph
from quarrygraph.plans import catalog

DATA = "/root/testdata/sf0.001"


def _plain(starts, edges):
    ways = [(s, t, k) for k, (s, t) in enumerate(edges)] + [(t, s, k) for k, (s, t) in enumerate(edges) if s != t]
    of = {}
    for u, v, k in ways:
        of.setdefault(u, []).append((v, k))
    out = []
    for s in starts:
        for v, k in of.get(s, []) if s is not None else []:
            out += [(s, v)] + [(s, x) for x, other in (of.get(v, []) if v is not None else []) if other != k]
    return out


def _held(spark, starts, edges):
    e = spark.createDataFrame([("t", *pair, 7) for pair in edges], "type string, source string, target string, ord long")
    s = spark.createDataFrame([(x,) for x in starts], "id string")
    expected = _plain(starts, edges)
    assert Counter(tuple(r) for r in graph.paths_up_to_two(s, e).collect()) == Counter(expected)
    counts = {r.start: (r.n_paths, r.n_ends) for r in graph.path_counts(s, e).collect()}
    assert counts == {x: (sum(a == x for a, _ in expected), len({b for a, b in expected if a == x} - {None})) for x, _ in expected}


@pytest.fixture(params=[None, 1])
def joined(request, monkeypatch):
    """Broadcast, or joined with everything dealt out and a bitmap that is far too small."""
    if request.param:
        monkeypatch.setattr(graph, "BROADCAST_IDS", 0)
        monkeypatch.setattr(graph, "BITMAP_BITS", 64)


def test_paths_over_odd_edges(spark, joined):
    edges = [("a", "b"), ("a", "b"), ("b", "a"), ("a", "a"), ("a", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", None), (None, "a"), ("c", None), (None, None), ("f", "g"), ("h", "h"), ("i", "j"), ("j", "j")]
    _held(spark, ["a", "b", "f", "a", "h", "i", "gone", None], edges)


def test_paths_of_more_starts_than_a_word_has_bits(spark, joined):
    hubs = [(f"n{i}", f"hub{i % 3}") for i in range(150)]
    _held(spark, [f"n{i}" for i in range(140)], [*hubs, ("hub0", "hub1"), ("n3", "n4"), ("n4", "n3")])


def test_edges_away_from_ends_are_not_dealt(spark):
    near = spark.range(1000).select(F.concat(F.lit("n"), "id").alias("id"))
    edges = spark.range(20_000).select(F.concat(F.lit("n"), "id").alias("source"), F.concat(F.lit("m"), "id").alias("target"))
    found = graph._steps(edges, graph._perhaps_among(near, 1000))
    assert 1000 <= found.count() < 5000  # of 40,000 steps
    assert found.join(near, found.u == near.id).count() == 1000


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no tables")
def test_bounded_path_equals_sql_with_repeated_and_missing_keys(spark, tmp_path):
    con = duckdb.connect()
    more = {"customer": "select * from customer where c_custkey % 7 = 0 union all select * replace (null as c_custkey) from customer where c_custkey % 5 = 0", "nation": "select * from nation where n_nationkey in (3, 4)",
            "orders": "select * replace (null as o_orderkey) from orders where o_orderkey % 9 = 0 union all select * replace (null as o_custkey) from orders where o_orderkey % 9 = 1", "lineitem": "select * from lineitem where l_orderkey % 4 = 0"}
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create table {p.stem} as select * from '{p}'")
    for name, rows in more.items():
        con.execute(f"insert into {name} {rows}")
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"copy {name} to '{tmp_path}/{name}.parquet' (format parquet)")
    expected = con.execute(catalog.oracle_sql()["bounded_path"]).fetchall()
    assert sorted(tuple(r) for r in catalog.queries()["bounded_path"](spark, str(tmp_path)).collect()) == sorted(expected)
