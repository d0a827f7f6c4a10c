"""Small hand-checked fixtures for the rules that the big tables don't reach."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarrygraph.operators import chunking, context, encode, graph, hybrid, loading, resolve, triage, vector
from quarrygraph.sources import python_repo, store

FIXTURES = Path(__file__).resolve().parents[1] / "fixtures" / "sample_project"


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_packing_rules(spark):
    sizes = [400, 400, 700, 1, 1500, 1501, 10, 1490, 1, 3000]
    out = spark.range(1).select(chunking.pack_groups(F.array(*map(F.lit, sizes))).alias("g")).first()["g"]
    groups = {}
    for g, s in zip(out, sizes, strict=True):
        groups.setdefault(g, []).append(s)
    assert list(groups.values()) == [[400, 400, 700], [1], [1500], [1501], [10, 1490], [1], [3000]]


def test_packing_of_nothing(spark):
    assert spark.range(1).select(chunking.pack_groups(F.array().cast("array<int>")).alias("g")).first()["g"] == []


def _vectors(spark):
    return spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [1.0, 0.0], 2), (4, [0.0, 0.0], 1), (5, None, 1), (6, [], 2), (7, [0.6, 0.8], 2)], "vec_id int, embedding array<float>, label int")


def test_vector_edges(spark):
    v = _vectors(spark)
    assert [r.vec_id for r in vector.top_k(v, [1.0, 0.0], 3).collect()] == [1, 3, 7]
    assert [r.vec_id for r in vector.top_k(v, [1.0, 0.0], 3, types=[2]).collect()] == [3, 7]
    assert [r.vec_id for r in vector.top_k_then_filter(v, [1.0, 0.0], 1, [2]).collect()] == [3]
    assert [r.vec_id for r in vector.above_threshold(v, [1.0, 0.0], 0).collect()] == [1, 3]
    assert vector.top_k(v.limit(0), [1.0, 0.0], 3).collect() == []
    assert v.where("vec_id = 4").select(vector.normalized(F.col("embedding")).alias("n")).first()["n"] == [None, None]
    out = values(vector.batch_top_k(v, v.where("vec_id in (1, 4)"), 2), "query_id", "rank", "vec_id")
    assert out == [(1, 1, 3), (1, 2, 7)]


def _graph(spark):
    nodes = spark.createDataFrame([(c, c, "t") for c in "abcdexy"], "id string, name string, type string")
    edges = spark.createDataFrame([("k", "a", "b", 0), ("k", "b", "c", 1), ("k", "c", "a", 2), ("k", "c", "d", 3), ("k", "a", "a", 4), ("k", "a", "b", 5), ("l", "a", "b", 6), ("k", "d", "gone", 7), ("k", "x", "y", 8)], "type string, source string, target string, ord long")
    return nodes, edges


@pytest.mark.parametrize("hops, ball, n_edges", [(0, "a", 0), (1, "abc", 4), (2, "abcd", 6), (3, "abcd", 7)])
def test_n_hop(spark, hops, ball, n_edges):
    nodes, edges = _graph(spark)
    seen, touched = graph.n_hop(spark.createDataFrame([("a",)], "id string"), nodes, edges, hops)
    assert "".join(r.id for r in seen.orderBy("id").collect()) == ball
    assert touched.count() == n_edges


def test_n_hop_without_seeds(spark):
    nodes, edges = _graph(spark)
    seen, touched = graph.n_hop(spark.createDataFrame([], "id string"), nodes, edges, 2)
    assert seen.count() == 0 and touched.count() == 0


def test_edges_once_and_induced(spark):
    nodes, edges = _graph(spark)
    assert graph.distinct_edges(edges).count() == 8
    assert values(graph.induced(edges, spark.createDataFrame([("c",), ("d",)], "id string")), "source", "target") == [("c", "d")]


def test_merge_rules(spark):
    kg = spark.createDataFrame([("f", "a", "t", "old", "", 0), ("f", "b", "t", "", "", 1), ("f", "a", "t", "new", "", 2), ("f", "c", "t", "", "", 3)], "file_path string, name string, type string, content string, summary string, ord long")
    hits = spark.createDataFrame([("c1", "f", "mixed", "", ["z", "b"], 0.9, 1), ("c2", "f", "mixed", "", ["b"], 0.4, 2), ("c3", "f", "file_section", "", ["module"], 0.8, 3), ("c4", "g", "class", "", ["a"], 0.8, 4)],
                                 "chunk_id string, file_path string, chunk_type string, content string, element_names array<string>, score double, rank int")
    out = [(r.source, r.name, round(r.combined_score, 3), r.content) for r in hybrid.best(hybrid.merge(kg, hits)).collect()]
    assert out == [("both", "b", 0.7, ""), ("kg", "a", 0.5, "new"), ("kg", "c", 0.5, ""), ("vector", "module", 0.4, ""), ("vector", "a", 0.4, "")]


def test_keys_and_rejects(spark):
    schema = "id string, type string, name string, file_path string, parent string, line_number int, ord long"
    rows = spark.createDataFrame([("x1", "class", "A", "p", None, 1, 0), ("", "class", "A", "a\\b.py", None, 3, 1), ("", "method", "m", "p", "A", 4, 2), ("", None, "n", "p", None, 1, 3), (None, "function", "", "p", None, 1, 4),
                                  ("", "class", "A", "a/b.py", None, 9, 5), ("", "file", "f", "a_b.py", None, 1, 6), ("", "file", "f", "a/b_py", None, 1, 7)], schema)
    stored = values(loading.documents(rows), "unique_key", "ord")
    assert stored == [("class:a/b.py:A", 1), ("file:a_b.py", 6), ("method:p:A:m:4", 2), ("x1", 0)]
    assert sorted(r.ord for r in loading.validated(rows)[1].collect()) == [3, 4]
    kept, lost = loading.resolve(spark.createDataFrame([("uses", "x1", "method:p:A:m:4"), ("uses", "x1", "?")], "type string, source string, target string"), loading.documents(rows))
    assert values(kept, "_from", "_to", "collection") == [("Class/x1", "Method/method_p_A_m_4", "Uses")] and lost.count() == 1


def test_triage_text(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    text = "within 5\n  File \"/a/b.py\", line 12, in run\n  File \"/c.py\", line 3\nKeyError: 'k'"
    fields = triage.trace_fields(F.lit(text))
    assert [get(fields[k]) for k in ("primary_file", "primary_line", "primary_function", "error_type")] == ["/a/b.py", 12, "5", "KeyError"]  # also within "within"
    assert [get(triage.trace_fields(F.lit("nothing"))[k]) for k in ("primary_file", "primary_line", "error_type")] == ["", 0, ""]
    many = "\n".join(f"- bullet number {i}" for i in range(14))
    assert len(get(triage.fixes(F.lit(many)))) == 10 and len(get(triage.steps(F.lit(many)))) == 14
    assert get(triage.fixes(F.lit("short\n- tiny\nplease change: that line"))) == ["please change: that line"]
    assert get(triage.parsed_reply(F.lit('```json\n{"classification": "network"}\n```')))["classification"] == "network"
    assert get(triage.parsed_reply(F.lit("{broken")))["classification"] == "other"
    assert get(triage.search_query(F.lit("All fine"), F.lit("x/m.py.py"), F.lit(None).cast("string"))) == "m"


@pytest.fixture(scope="module")
def project(spark):
    files = python_repo.python_files(spark, str(FIXTURES), ("__pycache__",))
    return python_repo.repository(files, f"{FIXTURES}/")


def test_extraction(project):
    nodes = {(r.type, r.name, r.parent) for r in project["nodes"].where("file_path like '%/a.py'").collect()}
    assert nodes == {("file", "a.py", None), ("class", "Box", None), ("attribute", "size", "Box"), ("method", "__init__", "Box"), ("method", "doubled", "Box"), ("class", "Inner", None), ("method", "deep", "Inner"),
                     ("function", "helper", None), ("function", "decorated", None), ("function", "later", None)}
    assert [r.file_path.rsplit("/", 1)[1] for r in project["errors"].collect()] == ["bad.py"]
    assert values(project["imports"], "alias", "full_name") == [("Box", "pkg.a.Box"), ("a", "pkg.a"), ("assist", "pkg.a.helper"), ("noimports", "noimports"), ("os", "os")]


def test_usage(spark, project):
    edges = resolve.usage_edges(project["nodes"], project["imports"], project["uses"])
    names = {r.id: (r.file_path.rsplit("/", 1)[1], r.name) for r in project["nodes"].collect()}
    assert {(names[r.source][1], *names[r.target]) for r in edges.collect()} == {
        ("caller", "b.py", "local"), ("caller", "a.py", "Box"), ("caller", "a.py", "helper"), ("caller", "b.py", "caller"), ("caller", "noimports.py", "alone")}
    kinds = {r.type for r in resolve.structural_edges(project["nodes"]).collect()}
    assert kinds == {"defines_class", "defines_function", "has_method", "has_attribute"}


def test_contexts(project):
    rows = {(r.name, r.file_path.rsplit("/", 1)[1]): r for r in context.with_contexts(project["nodes"], project["class_names"]).collect()}
    box = rows["Box", "a.py"]
    assert box.attributes == ["size", "twice", "value"] and box.metadata.method_names == ["__init__", "doubled"]
    assert box.summary == "Class 'Box' with 2 methods and 3 attributes. A box with a value."
    assert rows["doubled", "a.py"].full_context.startswith('# Parent Class: Box\n"""A box with a value."""\n\n# Method: doubled\n')
    assert rows["decorated", "a.py"].signature.splitlines()[0] == "def decorated("
    assert rows["a.py", "a.py"].summary.startswith("File: a.py (")


def test_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    built = store.load_or_build(spark, str(tmp_path / "x"), ("t",), lambda: {"t": df})
    assert values(built["t"], "k", "v") == [(1, "a"), (2, "b")]
    assert store.load_or_build(spark, str(tmp_path / "x"), ("t",))["t"].count() == 2
    with pytest.raises(ValueError):
        store.load_or_build(spark, str(tmp_path / "none"), ("t",))
    more = spark.createDataFrame([(2, "x", 1), (3, "y", 1), (3, "z", 2)], "k int, v string, o int")
    assert values(store.insert_new(df, more, "k", "o"), "k", "v") == [(1, "a"), (2, "b"), (3, "y")]
    assert values(store.upsert(df, more, "k", "o"), "k", "v") == [(1, "a"), (2, "x"), (3, "z")]


def test_encoder(spark, project):
    nodes = context.with_contexts(project["nodes"], project["class_names"])
    rows = encode.embedded(nodes, dim=16).collect()
    assert all((r.embedding is None) == (r.type == "attribute") for r in rows)


def test_packing_over_ranges_equals_one_scan(spark):
    import random

    from quarrygraph.operators import chunking

    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.choice([0, 1, 3, 9, 10, 11, 25, None])) for i in range(600)]
    expected, state = {}, {}
    for by, i, size in rows:
        size = size or 0
        group, held, closed = state.get(by, (-1, 0, True))
        if size > 10 or closed or held + size > 10:
            group, held = group + 1, size
        else:
            held += size
        state[by] = group, held, size > 10
        expected[i] = group
    found = chunking.packed(spark.createDataFrame(rows, "by string, ord long, size long"), "by", "ord", chunking.F.col("size"), 10)
    assert {r.ord: r.group for r in found.collect()} == expected
    assert chunking.packed(spark.createDataFrame([], "by string, ord long, size long"), "by", "ord", chunking.F.col("size"), 10).count() == 0
