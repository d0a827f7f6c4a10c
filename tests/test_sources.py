"""Folders, JSON arrays and packing over ranges, against plain Python."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarrygraph.operators import chunking
from quarrygraph.sources import folders, json_array, python_repo, shared, store
from quarrygraph.sources.shared import free_names, running_total


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def _records(n, seed=0):
    rng = random.Random(seed)
    odd = ["", "plain", "a } b", "{[", 'quote " here', "back\\slash", '\\"}', "line\nbreak", "é日本", "]}],{", "x" * 2000, "\\"]
    return [{"id": i, "text": rng.choice(odd) + rng.choice(odd), "deep": {"a": [rng.choice(odd), "}"], "b": None}} for i in range(n)]


@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_json_array_of_many_splits(spark, small_splits, tmp_path, layout):
    records = _records(300)
    (tmp_path / "a.json").write_text(json.dumps(records, **layout))
    schema = "id long, text string, deep struct<a:array<string>,b:string>, missing string"
    assert spark.read.text(f"{tmp_path}/a.json", lineSep="}").rdd.getNumPartitions() > 50
    rows = sorted(json_array.read_json_array(spark, f"{tmp_path}/a.json", schema).collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(300))
    assert [{"id": r.id, "text": r.text, "deep": {"a": r.deep.a, "b": r.deep.b}} for r in rows] == records and {r.missing for r in rows} == {None}


@pytest.mark.parametrize("text", ["[]", " [ ]\n", '[{"id": 1}]', '\n[\n{"id":1}\n]\n'])
def test_short_json_arrays(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    assert [(r.id, r.place) for r in json_array.read_json_array(spark, f"{tmp_path}/a.json", "id long").collect()] == ([(1, 0)] if "1" in text else [])


def test_json_array_round_trip(spark, tmp_path):
    records = _records(200, 1)
    df = spark.createDataFrame([(r["id"], r["text"], None) for r in records], "id long, `a.b` string, none int").repartition(5).orderBy("id")
    json_array.write_json_array(df, f"{tmp_path}/out.json")
    assert json.loads((tmp_path / "out.json").read_text()) == [{"id": r["id"], "a.b": r["text"], "none": None} for r in records]
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["out.json"]
    json_array.write_json_array(df.limit(0), f"{tmp_path}/out.json")
    assert json.loads((tmp_path / "out.json").read_text()) == []


def test_export_is_read_again(spark, tmp_path):
    nodes = spark.createDataFrame([("b", "n2", "class", "a\\b.py", None, 1), ("a", "n1", "file", "é", [0.5, 2.0], 0)], "id string, name string, type string, file_path string, embedding array<float>, ord long")
    edges = spark.createDataFrame([("calls", "a", "b"), (None, "b", "a")], "type string, source string, target string").coalesce(1)
    store.write_export(nodes, edges, str(tmp_path))
    raw = json.loads((tmp_path / "nodes.json").read_text())
    assert [(r["id"], r["file_path"], r["embedding"]) for r in raw] == [("a", "é", [0.5, 2.0]), ("b", "a/b.py", [])]
    found, links = store.read_export(spark, str(tmp_path))
    assert [(r.id, r.type, r.ord) for r in found.orderBy("ord").collect()] == [("a", "file", 0), ("b", "class", 1)]
    assert sorted(tuple(r) for r in links.collect()) == [("UNKNOWN", "b", "a", 1), ("calls", "a", "b", 0)]
    schema, index = (json.loads((tmp_path / f"{n}.json").read_text()) for n in ("schema", "index_config"))
    assert {r["kind"] for r in schema} == {"node_types", "edge_types", "node_field", "edge_ends"} and index[0]["options"]["similarity"] == "cosine"


def test_walk_reads_hidden_names_and_prunes(spark, tmp_path, monkeypatch):
    for name in ("pkg/__init__.py", "pkg/_private/.odd.py", "pkg/a.py", "venv/lib/b.py", "pkg/test_a.py", "pkg/deep/er/c.py", "pkg/data.txt"):
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(f"# {name}\n")
    (tmp_path / "src/pkg/bytes.py").write_bytes(b"x = '\xff'\n")
    closed = tmp_path / "src/venv/shut"
    closed.mkdir()
    closed.chmod(0)  # a pruned folder isn't listed
    files = folders.walk(spark, f"{tmp_path}/src", ("venv", "test_a"), ".py")
    closed.chmod(0o700)
    names = sorted(r.path.removeprefix(f"{tmp_path}/src/") for r in files.collect())
    assert names == ["pkg/__init__.py", "pkg/_private/.odd.py", "pkg/a.py", "pkg/bytes.py", "pkg/deep/er/c.py"]
    read = {r.path.removeprefix(f"{tmp_path}/src/"): r.content for r in folders.read_files(files, 10).collect()}
    assert read["pkg/_private/.odd.py"] == "# pkg/_private/.odd.py\n" and read["pkg/bytes.py"] == "x = '�'\n" and sorted(read) == names
    assert folders.walk(spark, f"{tmp_path}/nothing").count() == 0
    assert python_repo.python_files(spark, f"file://{tmp_path}/src", ("venv", "test_a")).count() == 5


def test_running_total(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v long").repartition(4)
    total, expected = 0, {}
    for k, v in rows:
        expected[k] = total
        total += v
    assert {r.k: r.before for r in running_total(df, ["k"], "v", "before").collect()} == expected


def test_free_names(spark):
    df = spark.range(1).select(F.lit(1).alias("Part"), F.lit(2).alias("_part"))
    assert free_names(df, "part", "part", "other") == ["__part", "___part", "other"]


@pytest.mark.parametrize("most", [1, 100])
def test_packed_keeps_every_row_once(spark, most):
    rng = random.Random(most)
    rows = [(rng.choice([None, "a", "a", "a", "b", f"s{i % 40}"]), rng.choice([None, *range(30)]) if rng.random() < 0.5 else i, rng.choice([None, 0, 1, 5, 99, 100, 101, 300]), i, "old") for i in range(3000)]
    rows += rows[:50]
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "source string, ord long, size long, range int, group string").repartition(3)
        found = chunking.packed(df, "source", "ord", F.col("size"), most)
        assert found.columns == ["source", "ord", "size", "range", "group"]
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    expected = []
    for items in by.values():
        group, held, closed = -1, 0, True
        for r in sorted(items, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or 0)):
            n = r[2] or 0
            opens = n > most or closed or held + n > most
            group, held, closed = group + opens, n if opens else held + n, n > most
            expected.append((*r[:2], n, group))
    assert sorted(((r.source, r.ord, r["size"] or 0, r.group) for r in got), key=str) == sorted(expected, key=str)
    assert sorted(r.range for r in got) == sorted(r[3] for r in rows)
    assert chunking.packed(df.limit(0), "source", "ord", F.col("size")).count() == 0


def test_long_texts_take_little_memory_and_are_worked_on_in_stretches():
    import random
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    data = np.frombuffer((b'{"a": "' + b"x" * 4_000_000 + b'\\\\\\" {", "b": [1]}'), np.uint8)
    tracemalloc.start()
    brackets, steps, after = json_array._structure(data, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(data) and steps.tolist() == [1, 1, -1, -1] and after == 0
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * 9 + ["g"]), pa.array([0] * 5 + [1] * 5), pa.array(["y" * 400_000] * 10)], names=["file", "block", "value"])
    assert list(json_array._stretches(batch)) == [(0, 2), (2, 4), (4, 5), (5, 7), (7, 9), (9, 10)]
    rng = random.Random(3)
    for _ in range(300):  # against one byte at a time
        text = "".join(rng.choice('\\\\"{}[]a') for _ in range(30)) + "}"
        for inside in (0, 1):
            open_, escaped, places = inside, False, []
            for i, c in enumerate(text):
                if c == '"' and not escaped:
                    open_ = 1 - open_
                elif c in "{}[]" and not open_:
                    places.append(i)
                escaped = c == "\\" and not escaped
            got, _, end = json_array._structure(np.frombuffer(text.encode(), np.uint8), inside)
            assert got.tolist() == places and end == open_, text


def test_array_is_written_without_a_second_copy(spark, tmp_path):
    import threading

    df = spark.range(0, 300_000, 1, 8).select("id", F.md5(F.col("id").cast("string")).alias("text"))
    most, done = [0], threading.Event()

    def watch():
        while not done.is_set():
            total = 0
            for p in tmp_path.rglob("*"):
                try:
                    total += p.stat().st_size if p.suffix != ".crc" and p.is_file() else 0
                except OSError:  # gone meanwhile
                    pass
            most.append(total)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        json_array.write_json_array(df, f"{tmp_path}/out.json")
    finally:
        done.set()
        watcher.join()
    size = (tmp_path / "out.json").stat().st_size
    assert len(most) > 20 and size <= max(most) < 1.5 * size
    assert [r["id"] for r in json.loads((tmp_path / "out.json").read_text())] == list(range(300_000))


def test_export_of_edges_takes_one_shuffle_and_leaves_no_files(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from quarrygraph.plans import catalog

    data = "/root/testdata/sf0.001"
    if not Path(data).is_dir():
        pytest.skip("no tables")
    edges = catalog._edges_in_order(spark, data)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Exchange rangepartitioning" in plan
    rows = [tuple(r) for r in edges.collect()]
    assert rows == sorted(set(rows), key=lambda r: (r[0] is None, r[0] or "", *r[1:])) and len(rows) > 10_000
    own = shared.passing_session(spark)
    assert own.conf.get("spark.sql.shuffle.partitions") == "4" and own.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}")
    found = catalog.queries()["export_edges"](spark, data)
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["objects"]
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: r[3]) == [(t or "UNKNOWN", a, b, i) for i, (t, a, b) in enumerate(rows)]


def test_export_of_nodes_deals_out_each_text_once_and_leaves_no_files(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from quarrygraph.plans import catalog, star

    data = "/root/testdata/sf0.001"
    if not Path(data).is_dir():
        pytest.skip("no tables")
    plan = catalog._nodes_by_order(spark, data).orderBy("ord")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Exchange rangepartitioning(doc_id" in plan
    assert plan.index("AS full_context") < plan.index("Exchange ")  # texts are repeated above it
    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}")
    found = catalog.queries()["export_nodes"](spark, data)
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["objects"]
    assert found.count() == star.file_nodes(spark, data).count() == found.select("ord").distinct().count()
