"""Suffix dedup, Jaccard join, nearest neighbours and the pipeline against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrygraph.llm import ann, jaccard_join, suffix_dedup
from quarrygraph.llm.components import connected_components


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def corpus(seed=0):
    """Texts with exact and near copies (a large group of them too), a frequent passage, repeats within a text, and odd ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, texts = fresh(60), []
    base = fresh(150)
    for _ in range(120):  # near copies of one text
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(150)] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 40
    for _ in range(60):
        own = fresh(rng.randint(0, 120))
        at = rng.randint(0, len(own))
        texts.append(" ".join(own[:at] + (passage if rng.random() < 0.5 else []) + own[at:]))
    for _ in range(40):  # chains at the edge of the threshold
        copy = texts[-1].split() if rng.random() < 0.7 else fresh(90)
        for _ in range(rng.randint(0, 4)):
            if copy:
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += ["", None, "   ", "One", "one", "two words", "a b c", "c b a", "A  b\tc", "again " * 300, "again " * 310, " ".join(fresh(6000))]
    rng.shuffle(texts)
    return texts


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"cls": F.lit(1), "_id": F.lit(2), "n": F.lit(3), "lang": F.lit("x"), "source": F.lit("s"), "n_chars": F.lit(1)})


def _components(texts, k=3, percent=90):
    sets = []
    for t in texts:
        w = _words(t)
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize("seed, most", [(0, 8), (1, 0)])
def test_jaccard_components(spark, seed, most, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PAIRS_PER_ROW", most)  # 0: rounds of pivots until the last
    monkeypatch.setattr(jaccard_join, "CHUNK", 2000)
    texts = corpus(seed)
    rows = jaccard_join.jaccard_components(frame(spark, texts).repartition(3), 3, 90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == _components(texts)


def test_jaccard_edges(spark):
    docs = frame(spark, ["same words in here", "same words in here", None, ""]).unionByName(frame(spark, ["same words in here"]))
    rows = sorted((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(docs).collect())
    assert rows == [(0, 0), (0, 0), (1, 0), (2, 2), (3, 3)]
    assert sorted(r.doc_id for r in jaccard_join.keep_one_of_each(docs).collect()) == [0, 2, 3]
    none = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert jaccard_join.keep_one_of_each(none).count() == docs.count()
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_pairs_of_a_group_grow_as_its_members(spark, k, percent, monkeypatch):
    written, write = [], jaccard_join.materialize

    def counted(df, label):
        out = write(df, label)
        if label in ("compared", "candidates"):
            written.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = [rng.choice(vocabulary) for _ in range(100)]
    for members in (300, 1200):
        texts = []
        for _ in range(members):  # near copies of one text with up to three edits
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                at, kind = rng.randrange(len(copy)), rng.choice("sid")
                copy[at : at + (kind != "i")] = [] if kind == "d" else [rng.choice(vocabulary)]
            texts.append(" ".join(copy))
        written.clear()
        rows = jaccard_join.jaccard_components(frame(spark, texts), k, percent).collect()
        assert sum(written) <= 6 * members
        if members == 300:
            assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == _components(texts, k, percent)


def test_components_of_paths_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    links = spark.createDataFrame(pairs, "a long, b long")
    found = {r.node: r.label for r in connected_components(links).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def _repeats(texts, least):
    classes = defaultdict(list)
    for i, t in enumerate(texts):
        classes[tuple(_words(t))].append(i)
    holders = defaultdict(set)
    for w in classes:
        for s in range(len(w) - least + 1):
            holders[w[s : s + least]].add(w)
    out = {}
    for w, ids in classes.items():
        if len(w) < least:
            continue
        spans = [(0, len(w))] if len(ids) > 1 else []
        for s in range(len(w) - least + 1) if not spans else ():
            if len(holders[w[s : s + least]]) > 1:
                if spans and s <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], s + least)
                else:
                    spans.append((s, s + least))
        out |= {i: spans for i in ids if spans}
    return out


def test_repeated_passages(spark):
    texts = corpus(3)
    found = defaultdict(list)
    for r in suffix_dedup.repeated_passages(frame(spark, texts).repartition(3)).collect():
        found[r.doc_id].append((r.start_word, r.end_word))
        assert r.other_id is not None and r.n_words == len(_words(texts[r.doc_id]))
    expected = _repeats(texts, 50)
    assert set(found) == set(expected)
    assert all(sorted(found[i]) == expected[i] for i in expected)
    assert suffix_dedup.repeated_passages(frame(spark, texts).limit(0)).count() == 0
    assert suffix_dedup.repeated_passages(frame(spark, ["", None, "short text"] * 3)).count() == 0


def test_passages_that_no_neighbour_shares_in_full(spark):
    rng = random.Random(17)
    vocabulary = [f"w{i}" for i in range(500)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = []
    for _ in range(40):  # passages of about 50 words, shared in part by some, in other parts by others
        core = fresh(70)
        for _ in range(7):
            a, b = rng.randint(0, 14), rng.randint(56, 70)
            texts.append(" ".join(fresh(rng.randint(0, 30)) + core[a:b] + fresh(rng.randint(0, 30))))
    texts += texts[:3]
    docs = frame(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") != 5, F.col("doc_id")))
    found = defaultdict(list)
    for r in suffix_dedup.repeated_passages(docs.repartition(5)).collect():
        found[5 if r.doc_id is None else r.doc_id].append((r.start_word, r.end_word))
    expected = _repeats(texts, 50)
    assert len(expected) > 100 and {i: sorted(x) for i, x in found.items()} == expected


def test_only_windows_in_question_are_looked_up(spark, monkeypatch):
    """What goes on to be grouped by window is asked for, even where all windows fall into one bucket, as most do in large tables."""
    kept, written = {}, suffix_dedup.materialize
    monkeypatch.setattr(suffix_dedup, "BUCKETS", 1)
    monkeypatch.setattr(suffix_dedup, "discard", lambda *tables: None)
    monkeypatch.setattr(suffix_dedup, "materialize", lambda df, label: kept.update({label: written(df, label)}) or kept[label])
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = []
    for _ in range(3):  # one pair shares a passage, and on either side of it many share more words of it
        core = fresh(76)
        texts += [" ".join(fresh(5) + core[a:b] + fresh(5)) for a, b in ((0, 76), (20, 70))]
        for _ in range(40):
            head = fresh(20)
            texts += [" ".join(x + fresh(5)) for x in (head + core[24:], head + core[24:], fresh(5) + core[:65])]
    found = defaultdict(list)
    for r in suffix_dedup.repeated_passages(frame(spark, texts)).collect():
        found[r.doc_id].append((r.start_word, r.end_word))
    assert {i: sorted(x) for i, x in found.items()} == _repeats(texts, 50)
    asked = {r.window for r in kept["asked"].collect()}
    several = {r.window for r in kept["several"].collect()}
    assert several and several <= asked


def test_texts_that_repeat_themselves(spark):
    rng = random.Random(6)
    head, tail = ([f"{c}{i}" for i in range(80)] for c in "ht")
    phrase = [f"p{i}" for i in range(7)]
    texts = [" ".join(x) for x in (["w"] * 300, ["w"] * 420 + ["z"], head + ["w"] * 260 + tail, phrase * 40, tail[:60] + phrase * 55 + ["q"] * 10, ["q"] * 49, [rng.choice("ab") for _ in range(400)], phrase * 9 + ["w"] * 20 + phrase * 9, ["w"] * 55, head[30:] + ["w"] * 51)]
    found = defaultdict(list)
    for r in suffix_dedup.repeated_passages(frame(spark, texts).repartition(3)).collect():
        found[r.doc_id].append((r.start_word, r.end_word))
    expected = _repeats(texts, 50)
    assert len(expected) > 6 and {i: sorted(x) for i, x in found.items()} == expected
    # a text of one word has as many records as contexts, however long it is
    docs = spark.createDataFrame([("w " * 20_000, list(range(19_950)))], "text string, wanted array<int>")
    assert suffix_dedup._contexts(docs, 50).count() < 100


def _runs_compared(records, least, order):
    """(cls, start, end, other) of each record with the last one of the run before it and the first one of the run behind."""
    rows = sorted(records, key=lambda r: (r["suffix"], *(r[c] for c in order), r["cls"], r["at"]))
    runs, out = [], set()
    for r in rows:
        if runs and (runs[-1][0]["suffix"], runs[-1][0]["cls"]) == (r["suffix"], r["cls"]):
            runs[-1].append(r)
        else:
            runs.append([r])

    def alike(a, b):
        pairs = zip(np.frombuffer(a, "<u4").tolist(), np.frombuffer(b, "<u4").tolist(), strict=True)
        return next((i for i, (x, y) in enumerate(pairs) if x != y or not x), len(a) // 4)

    for k, run in enumerate(runs):
        for r in run:
            for o in [*(x[-1] for x in runs[max(k - 1, 0) : k]), *(x[0] for x in runs[k + 1 : k + 2])]:
                after, before = alike(r["after"], o["after"]), alike(r["before"], o["before"])
                if o["suffix"] == r["suffix"] and after + before + suffix_dedup.K >= least:
                    out.add((r["cls"], r["at"] - before, r["at"] + suffix_dedup.K + after, o["cls"]))
    return out


@pytest.mark.parametrize("batch, partitions", [(3, 1), (5, 1), (3, 23), (4096, 23)])
def test_neighbours_over_borders(spark, batch, partitions, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SORTED_ROWS", batch)
    rng = np.random.default_rng(4)
    base, records = rng.integers(1, 1 << 32, (2, 30)).astype("<u4"), []
    for at in range(400):  # long runs of few classes that share their passages in different lengths
        sides = base.copy()
        for side in sides:
            side[rng.integers(8, 31) :] = rng.integers(1, 4)
        cls = b"a" if rng.random() < 0.85 else bytes([98 + int(rng.integers(0, 3))])
        records.append({"suffix": at // 150, "cls": cls, "at": 100 + at, "last": 100 + at, "after": sides[0].tobytes(), "before": sides[1].tobytes()})
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        table = spark.createDataFrame([tuple(r.values()) for r in records], suffix_dedup._RECORD)
        found = suffix_dedup._matches(table, 50, ["after", "before"]).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert {(bytes(r.cls), r.start, r.end, bytes(r.other)) for r in found} == _runs_compared(records, 50, ["after", "before"])


def _brute(ids, x, k, every):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            s = x @ q
            order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:k]
            out[i] = [ids[j] for j in order]
    return out


@pytest.mark.parametrize("level", [False, True])
def test_nearest(spark, level):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((8, 16))
    x = centres[rng.integers(0, 8, 600)] + 0.5 * rng.standard_normal((600, 16))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if level else x * rng.uniform(0.2, 3, (600, 1))
    x[100:260] = x[100]  # one very common vector
    x = x.astype(np.float32).astype(np.float64)
    odd = [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16), (960, []), (980, [1.0, 2.0]), (1000, [None] * 16), (None, [1.0] * 16)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd + [(40, x[40].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"x": F.lit(1), "id": F.lit(2), "label": F.lit(3)})
    found = defaultdict(list)
    for r in ann.nearest(vectors, 20, 20).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
        assert abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-9
    expected = _brute(np.arange(600), x, 20, 20)
    assert set(found) == set(expected) and all(len(v) == 20 for v in found.values())
    assert np.mean([len(set(found[i]) & set(expected[i])) / 20 for i in expected]) >= 0.95
    assert found[100] == expected[100]  # ties go to the smaller ids
    assert ann.nearest(vectors.where("vec_id >= 900")).count() == 0 and ann.nearest(vectors.limit(0)).count() == 0
    few = ann.nearest(vectors.where("vec_id in (0, 1, 2)"), 20, 20)
    assert [(r.query_id, r["rank"]) for r in few.orderBy("rank").collect()] == [(0, 1), (0, 2)]


@pytest.mark.parametrize("clustered", [False, True])
def test_nearest_over_many_cells(spark, clustered):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((6000, 16))
    x = x * 0.2 + rng.standard_normal((40, 16))[rng.integers(0, 40, 6000)] if clustered else x
    x = x.astype(np.float32).astype(np.float64)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = defaultdict(list)
    for r in ann.nearest(vectors, 20, 20, cell=200).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    expected = _brute(np.arange(6000), x, 20, 20)
    assert set(found) == set(expected) and all(len(v) == 20 for v in found.values())
    assert np.mean([len(set(found[i]) & set(expected[i])) / 20 for i in expected]) >= 0.9


def test_projected_cells_cover_all_points():
    points = np.random.default_rng(0).standard_normal((5000, 4))
    tree = ann.TopTree(points[:500], 13)
    cells = tree.cell_of(points)
    assert cells.min() >= 0 and cells.max() < tree.cells and np.bincount(cells).max() < 1500
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 0.01


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    words = {"xx": ["the", "of", "and", "thing", "with", "house", "river"], "yy": ["der", "und", "nicht", "haus", "über", "für", "wasser"]}
    rows = [(i, " ".join(rng.choice(words[lang]) + (str(rng.randint(0, 99)) if rng.random() < 0.3 else "") for _ in range(rng.randint(40, 80))), lang) for i, lang in enumerate(["xx", "yy"] * 60)]
    item = " ".join(rng.choice(words["xx"]) + str(rng.randint(0, 99)) for _ in range(30))
    texts = [*(t for _, t, _ in rows), rows[0][1], rows[1][1] + " haus", "的" * 100, "the river with " + item, "the house password=abcdefgh1234 of the river", None, ""]
    langs = [*(x for *_, x in rows), "xx", "yy", None, "xx", "xx", None, None]
    data = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    gone = {120, 121, 122, 123, 125, 126}
    docs, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
    kept = {r.doc_id: r for r in docs.collect()}
    assert set(kept) == set(range(len(texts))) - gone and counts == [124, 122, 121, 121]
    assert kept[124].text == "the house <assign> of the river" and kept[124].n_chars == len(kept[124].text)
    assert all(kept[i].text == texts[i] for i in kept if i != 124)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in packed} == set(kept)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("seed, most", [(0, 8), (1, 0)])
def test_jaccard_components_of_the_pipeline(spark, seed, most, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PAIRS_PER_ROW", most)
    texts = corpus(seed)
    rows = jaccard_join.jaccard_components(frame(spark, texts).repartition(3), 5, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == _components(texts, 5, 80)


def test_pipeline_joins_near_copies_of_five_words(spark, tmp_path):
    base = [f"w{i}" for i in range(100)]
    near, far = list(base), list(base)
    near[30] = near[60] = "other"  # five words: 86 / 106 = 0.81, three words: 92 / 104 = 0.88
    far[20] = far[50] = far[80] = "else"  # five words: 81 / 111 = 0.73
    docs = frame(spark, [" ".join(x) for x in (base, near, far)])
    kept = corpus_pipeline.join_near_copies(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == [0, 2]


def test_texts_of_few_words_make_few_pairs(spark, monkeypatch):
    made = []
    merged, chained = jaccard_join._merged, jaccard_join._chained

    def tried(lists, percent):
        of_known = lists.groupBy("key", "known").agg(F.count(F.lit(1)).alias("n"))
        made.append(of_known.groupBy("key").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("p")).agg(F.sum("p")).first()[0] or 0)
        return merged(lists, percent)

    def chains(*args):
        out, rest = chained(*args)
        made.append(out.count())
        return out, rest

    monkeypatch.setattr(jaccard_join, "_merged", tried)
    monkeypatch.setattr(jaccard_join, "PAIRS_PER_ROW", 16)  # with 64, lists this short are merged as they are
    monkeypatch.setattr(jaccard_join, "_chained", chains)
    rng, sums = random.Random(1), []
    for n in (1000, 4000):
        texts = [" ".join(rng.choice("abcdef") for _ in range(30)) for _ in range(n)]
        made.clear()
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
        sums.append(sum(made))
        sets = [frozenset(zip(w, w[1:], w[2:], strict=False)) for w in (t.split() for t in texts)]
        linked = [(i, j) for i in range(0, n, 7) for j in range(n) if i != j and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
        assert all(found[i] == found[j] for i, j in linked)
    assert sums[1] < 6 * sums[0], sums


@pytest.mark.parametrize("seed", range(2))
def test_chains_find_all_links(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PAIRS_PER_ROW", 0)
    monkeypatch.setattr(jaccard_join, "CHAIN_PAIRS", 0)
    monkeypatch.setattr(jaccard_join, "CHAIN_SHINGLES", 1000)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    rng = random.Random(seed)
    texts = []
    for _ in range(120):
        words = [rng.choice("abcdefgh") for _ in range(rng.choice([4, 8, 30, 60]))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            words = [rng.choice("abcdefgh") if rng.random() < 0.02 else w for w in words]
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links, sets = [], [{" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                links.append((i, j))
    for _ in texts:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    found = jaccard_join.jaccard_components(docs).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(label))


def test_kept_rows_have_all_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", "x", 7, "p"), (2, "one two three four five six", "y", 8, "q"), (3, "", "z", 9, None)], "doc_id long, text string, _quarry_id string, `a.b` int, kept_id string")
    kept = jaccard_join.keep_one_of_each(docs, k=5, percent=80)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "one two three four five six", "x", 7, "p"), (3, "", "z", 9, None)]
