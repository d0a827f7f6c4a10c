"""Fill-in-middle, HyperMinHash near-dedup and conversation repair on small tables, against brute force."""

import random
import re
from collections import defaultdict
from functools import cache
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrygraph.llm import conversation_repair, fill_middle, minhash_dedup, queries
from quarrygraph.llm.common import streamed_sha256
from quarrygraph.llm.shingles import shingle_sets

ODD = ["", None, "a", "?", "aB c1", "é" * 300, "word " * 200, "x" * 1000, "日本 abc\n\ndef", "has <P> inside", "<S>", "same text", "same text", "<P", "M> a<"] + [f"some words of text {i}, é and more; " * (i % 7 + 1) for i in range(60)]


def documents(spark, texts, ids=None):
    rows = [(i, t, "en", "clash", 5) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, cls string, n long").repartition(3)


def _filled(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("chunk", [7, 64, 1 << 16])
def test_fill_middle_equals_brute_force(spark, chunk):
    ids = [*range(len(ODD) - 2), 3, None]
    short, long = fill_middle.fill_in_middle(documents(spark, ODD, ids), chunk=chunk)
    got, found = [], defaultdict(list)
    for r in long.collect():
        found[r.doc_id, r.row].append(r)
    for parts in [*found.values(), *([r] for r in short.collect())]:
        parts.sort(key=lambda r: r.part)
        assert {r.parts for r in parts} == {len(parts)}
        assert len({(r.n, r.form, r.prefix_chars, r.middle_chars) for r in parts}) == 1
        r = parts[0]
        got.append((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, "".join(p.output for p in parts)))
    assert sorted(map(str, got)) == sorted(str((i, *_filled(i, t))) for i, t in zip(ids, ODD, strict=True))


def test_fill_middle_query(spark, tmp_path):
    texts = [*ODD, "long words and é " * 9000, "z" * 200_000, "é1 " * 50_000 + "<M>"]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op11_fill_middle(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        n, form, prefix, middle, out = _filled(i, t)
        r = rows[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == sha256(out.encode()).hexdigest() and r.restored_sha256 == sha256((t or "").encode()).hexdigest()
    documents(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op11_fill_middle(spark, f"{tmp_path}/none").count() == 0


def test_functions_compose_to_one_scan():
    rng = random.Random(5)
    for _ in range(50):
        text = "".join(rng.choice("ab é1") for _ in range(rng.randint(1, 60))).encode()
        cuts = sorted({0, len(text), *(rng.randrange(len(text)) for _ in range(rng.randint(0, 9)))})
        unit, behind, counts = fill_middle.scan(np.frombuffer(text, np.uint8), np.array(cuts))
        state, units = fill_middle.compose(behind, counts)
        whole, end, n = fill_middle.scan(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        starts = np.flatnonzero(whole)
        assert units.tolist() == [int((starts < c).sum()) for c in cuts] and units[-1] == n[0, 0] and state[-1] == end[0, 0]


def test_streamed_digests(spark):
    rows = [(k, i, f"{k}-{i}é" * (i % 3) if i % 5 else None) for k in (None, 1, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, i int, t string").repartition(4)
    found = {r.k: r.h for r in streamed_sha256(df, ["k"], ["i"], "t", "h", "|").collect()}
    assert found == {k: sha256("|".join(t for a, _, t in rows if a == k and t is not None).encode()).hexdigest() for k in (None, 1, 2)}
    assert streamed_sha256(df.limit(0), ["k"], ["i"], "t", "h").count() == 0


def _shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def _near(ids, texts, k, percent):
    sets, label = [_shingles(t, k) for t in texts], list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    by = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            by[x].add(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            if 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        r = root(i)
        least[r] = min((y for y in (least.get(r), x) if y is not None), default=None)
    return sorted(((x, len(s), least[root(i)]) for i, (x, s) in enumerate(zip(ids, sets, strict=True))), key=str)


def _copies(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 3, 5, 12, 40, 150, 400]))] for _ in range(60)]
    texts = []
    for b in base:
        chain = b
        for _ in range(rng.randint(1, 6)):
            chain = [rng.choice(words) if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else w for w in chain]
            texts.append(" ".join(chain if rng.random() < 0.7 else chain[: max(1, int(len(chain) * rng.uniform(0.75, 1)))]))
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates_equal_brute_force(spark, seed):
    texts = [*_copies(seed), "", None, " \t\n", "One Two three four", "one two THREE four", "É word", "é word"]
    rng = random.Random(seed)
    centre = [f"c{i}" for i in range(120)]
    for _ in range(250):  # a group of near copies, some of them off the centre's reach
        copy = list(centre)
        for _ in range(rng.randint(1, 7)):
            copy[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    ids = [*range(len(texts) - 1), None]
    found = minhash_dedup.near_duplicates(documents(spark, texts, ids), k=4, percent=80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == _near(ids, texts, 4, 80)


def test_near_duplicates_make_few_pairs(spark, monkeypatch):
    made, linked = [], minhash_dedup._linked

    def counted(pairs, *rest):
        made.append(pairs.count())
        return linked(pairs, *rest)

    monkeypatch.setattr(minhash_dedup, "_linked", counted)
    rng = random.Random(1)
    for n in (200, 800):
        centre = [f"c{i}" for i in range(150)]
        texts = [" ".join(centre), *(" ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.015 and i < 100 else w for i, w in enumerate(centre)) for _ in range(n))]
        made.clear()
        found = minhash_dedup.near_duplicates(documents(spark, texts), k=4).collect()
        assert sum(r.component_id == 0 for r in found) > 0.95 * n and sum(made) < 20 * n, made
    # few words, many texts: hardly any of them are alike
    made.clear()
    texts = [" ".join(rng.choice("abcdef") for _ in range(30)) for _ in range(2000)]
    minhash_dedup.near_duplicates(documents(spark, texts), k=4).collect()
    assert sum(made) < 2000


def test_near_duplicates_query_and_empty_table(spark, tmp_path):
    documents(spark, ["a b c d e", "a b c d e", "other words here at all"]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op12_minhash_dedup(spark, str(tmp_path)).collect()}
    assert rows == {0: (2, 0, True), 1: (2, 0, False), 2: (2, 2, True)}
    assert minhash_dedup.near_duplicates(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        minhash_dedup.near_duplicates(documents(spark, []), percent=70)


@pytest.mark.parametrize("n", [4, 9, 60, 700])
def test_registers_of_similar_sets(n):
    rng = np.random.default_rng(n)
    shared, found, missed = n * 8 // 9 if n > 8 else n, [], 0
    for _ in range(400):
        both = rng.integers(0, 1 << 63, shared, np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
        extra = [np.concatenate([both, rng.integers(0, 1 << 63, m, np.int64).view(np.uint64) * np.uint64(2)]) for m in (n - shared, n - shared if n > 8 else 1)]
        a, b = (minhash_dedup.sketch(np.unique(x)) for x in extra)
        keys = minhash_dedup.band_keys(np.stack([a, b]))
        missed += not (keys[0] == keys[1]).any()
        found.append(minhash_dedup.estimate(a[None], b[None], np.array([len(extra[0])]), np.array([len(extra[1])]))[0])
    true = shared / (len(extra[0]) + len(extra[1]) - shared)
    assert abs(np.mean(found) - true) < 0.03 and missed == 0
    assert not minhash_dedup.ruled_out(np.array(found), np.full(400, n), round(100 * true)).any()


def _repaired(rows):
    """(blank, duplicate, truncated, illegal, gaps, cost, audit, messages) of ordered (turn, role, text), by plain search."""
    faults, seen = [], set()
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") or not a or not b for a, b in zip(initials, initials[1:], strict=False))
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @cache
    def best(i, state, inserted):
        ways = []
        if inserted < 3:
            for letter, name in (("u", "user"), ("a", "assistant")):
                if letter in after[state]:
                    c, audit, out = best(i, letter, inserted + 1)
                    ways.append((c + 2, "I" + audit, ((name, ""), *out)))
        if i == len(rows):
            if state in ("", "a"):
                ways.append((0, "", ()))
            return min(ways, default=(10**9, "", ()))
        _, role, text = rows[i]
        c, audit, out = best(i + 1, state, 0)
        ways.append((c + 3, "D" + audit, out))
        if faults[i] not in ("blank", "duplicate"):
            late = faults[i] == "truncated"
            if role[:1] in after[state]:
                c, audit, out = best(i + 1, role[:1], 0)
                ways.append((c + late, "K" + audit, ((role, text), *out)))
            for letter, name in (("u", "user"), ("a", "assistant")):
                if letter in after[state]:
                    c, audit, out = best(i + 1, letter, 0)
                    ways.append((c + 2 + late, "R" + audit, ((name, text), *out)))
        return min(ways, key=lambda w: w[:2])

    cost, audit, out = best(0, "", 0)
    return faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, gaps, cost, audit, list(out)


def _talks(seed, n, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "ai", "", "user "]
    texts = ["Yes.", "No!", "cut off", "", "  \t", "Why? ", "é。", "Well. \x0b", "a\nb.", *(f"t{i}." for i in range(20))]
    rows = []
    for conv in [None, *range(n)]:
        turn = rng.randint(-2, 3)
        for _ in range(rng.randint(1, longest)):
            turn += rng.choice([1, 1, 1, 1, 0, 3])
            rows.append((conv, None if rng.random() < 0.05 else turn, None if rng.random() < 0.05 else rng.choice(roles), None if rng.random() < 0.05 else rng.choice(texts)))
    return rows


def _ordered(df):
    by = defaultdict(list)
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    for r in df.select("conv_id", "turn", blank("role"), blank("text")).withColumn("h", F.xxhash64("text")).collect():
        by[r.conv_id].append(r)
    return {k: [(r.turn, r.role, r.text) for r in sorted(v, key=lambda r: (r.turn is not None, r.turn or 0, r.role.encode(), r.h))] for k, v in by.items()}


@pytest.mark.parametrize(("seed", "n", "longest", "rows"), [(0, 200, 9, 4096), (1, 60, 12, 3), (2, 2, 40, 5), (3, 12, 30, 1)])
def test_repair_equals_brute_force(spark, seed, n, longest, rows):
    table = _talks(seed, n, longest)
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit("clash"), "hash": F.lit(1), "segment": F.lit(2)}).repartition(3)
    found = defaultdict(list)
    for r in conversation_repair.repair_conversations(df, segment_rows=rows).collect():
        found[r.conv_id].append(r)
    expected = {k: _repaired(v) for k, v in _ordered(df).items()}
    assert found.keys() == expected.keys()
    for k, parts in found.items():
        parts.sort(key=lambda r: r.segment)
        assert [r.segment for r in parts] == list(range(len(parts))) and {r.segments for r in parts} == {len(parts)}
        sums = tuple(sum(r[c] for r in parts) for c in ("blank", "duplicate", "truncated", "illegal", "gaps", "cost"))
        assert (*sums, "".join(r.audit for r in parts), [(m.role, m.text) for r in parts for m in r.messages]) == expected[k], k


def test_repair_query_equals_brute_force(spark, tmp_path):
    table = [*_talks(7, 150, 8), *[(500, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(9000)]]
    spark.createDataFrame(table, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    damaged = []
    for conv, turn, role, text in table:
        role, text = (" " if x is None else x for x in (role, text))
        fault = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (conv, turn, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
        damaged += [row] * (0 if fault == 0 else 2 if fault == 3 else 1)
    ordered = _ordered(spark.createDataFrame(damaged, "conv_id long, turn long, role string, text string"))
    rows = queries.op13_conversation_repair(spark, str(tmp_path)).collect()
    assert len(rows) == len({r[0] for r in table})
    for r in rows:
        got = (r.blank, r.duplicate, r.truncated, r.illegal, r.gaps, r.cost, r.audit)
        if r.conv_id == 500:  # too deep for the search: the letters must still give the text
            assert len(r.audit) >= 9000 - 900 and r.audit.count("K") > 7000
            continue
        *expected, out = _repaired(ordered.get(r.conv_id, []))
        assert got == tuple(expected)
        assert r.repaired_sha256 == sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()


def test_long_conversation_in_segments_equals_one(spark):
    rng = random.Random(4)
    table = [(1, i, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["Fine.", f"turn {i}.", f"cut {i}"])) for i in range(3000)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(2)
    results = []
    for rows in (4096, 100):
        parts = sorted(conversation_repair.repair_conversations(df, segment_rows=rows).collect(), key=lambda r: r.segment)
        results.append((sum(r.cost for r in parts), "".join(r.audit for r in parts), [tuple(m) for r in parts for m in r.messages]))
    assert results[0] == results[1]


def test_repair_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op13_conversation_repair(spark, str(tmp_path)).count() == 0
