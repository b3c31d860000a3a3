"""Operators on whole corpora against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from athletrack.llm import bwt, neardup, phrases, pii, quality, registry, repeats
from athletrack.llm.anchors import sliding_least
from athletrack.llm.base import read, without
from athletrack.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, True, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id long")


def some_docs(n=160, seed=1):
    """Random texts, exact copies, near copies of several degrees, shared passages, odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("th", "er", "On", "an", "é", "in", "ou")) for _ in range(rng.randrange(1, 5)))
    passage = " ".join(word() for _ in range(70))
    out = []
    for i in range(n):
        kind = i % 8
        words = [word() for _ in range(rng.randrange(3, 150))]
        if kind == 1 and out:
            out.append((i, rng.choice(out)[1]))
            continue
        if kind in (2, 3, 4) and out:
            words = (rng.choice(out)[1] or "x").split() or ["x"]
            for _ in range(rng.randrange(1, 6)):
                words[rng.randrange(len(words))] = word()
        if kind == 5:
            words[1:1] = passage.split()[rng.randrange(20) :]
        out.append((i, rng.choice((" ", "\n", "  ")).join(words)))
    return out + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "two words"), (n + 6, "the the " * 300)]


# --- near duplicates


def brute_components(rows, words=3, percent=85):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = frozenset(zip(*(w[k:] for k in range(words)))) if len(w) >= words else frozenset([tuple(w)]) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80), (1, 50)])
def test_near_duplicates(spark, words, percent):
    rows = some_docs()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(table(spark, rows), neardup.Shape(words, percent)).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute_components(rows, words, percent).items()}


def test_near_duplicates_odd_tables(spark):
    df = table(spark, [(None, "same words in here"), (5, "same words in here"), (5, "same words in here"), (7, "Same words in here")])
    rows = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, neardup.Shape(3, 85)).collect()), key=str)
    assert rows == [(5, 5, True), (5, 5, True), (7, 5, False), (None, None, True)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    assert neardup.near_duplicates(table(spark, [(1, None), (2, "")])).where("kept").count() == 2


def test_near_duplicates_of_each_text_of_an_id(spark):
    base = [f"w{k}" for k in range(120)]
    near = lambda k: " ".join([*base[:k], "zz", *base[k + 1 :]])
    other = " ".join(f"v{k}" for k in range(120))
    df = table(spark, [(1, "aaa first in order, like nothing else"), (1, near(10)), (2, near(50)), (3, other), (4, other + " more")])
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, neardup.Shape(3, 85)).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 3, True), (4, 3, False)}


def test_one_component_for_all_texts_of_an_id(spark):
    a, b = " ".join(f"a{k}" for k in range(120)), " ".join(f"b{k}" for k in range(120))
    df = table(spark, [(0, b), (1, a), (1, b), (2, a + " more"), (3, None), (3, "c c c"), (3, "d d d"), (4, "d d d")])
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, neardup.Shape(3, 85)).collect()}
    assert got == {(0, 0, True), (1, 0, False), (2, 0, False), (3, 3, True), (4, 3, False)}


def test_rows_without_some_ids(spark):
    df = table(spark, [(1, "a"), (2, "b"), (2, "c"), (None, "d"), (3, None)])
    for limit in (500_000, 0):  # broadcast, and the join beyond the bound
        assert sorted(r["text"] or "" for r in without(df, df.where("doc_id = 2"), limit).collect()) == ["", "a", "d"]
        assert sorted(r["text"] or "" for r in without(df, df.where("doc_id is null"), limit).collect()) == ["", "a", "b", "c"]


def test_links_inside_a_bucket():
    """The second round: members that their hub doesn't reach, in one block and between two."""
    shape = neardup.Shape(1, 50)
    texts = {1: "a b c d e f g h", 2: "a b c d e f g h i", 3: "p q r s", 4: "p q r s t", 5: "x y z"}
    minima = {i: shape.minima(shape.shingles(t)) for i, t in texts.items()}

    def first_band(i, j):
        same = (minima[i] == minima[j]).reshape(-1, neardup.ROWS).all(1)
        return int(same.argmax()) if same.any() else None

    for i, j in ((1, 2), (3, 4)):
        rows = pd.DataFrame({"rep": list(texts), "component": list(texts), "minima": [m.tobytes() for m in minima.values()], "text": list(texts.values()), "band": first_band(i, j), "side": 0})
        assert (i, j) in {tuple(x) for x in neardup._across(rows, shape).itertuples(index=False)}
        rows["side"] = [int(k == j) for k in rows["rep"]]
        assert (i, j) in {tuple(x) for x in neardup._across(rows, shape).itertuples(index=False)}
        rows["component"] = 0
        assert not len(neardup._across(rows, shape))


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, k) for k in range(201, 260)] + [(7, 7), (None, 3)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in list(root)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- phrases

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(docs, items, window=10):
    split = lambda t: _WORD.findall((t or "").translate(LOWER))
    found = defaultdict(set)
    for item, t in items:
        w = split(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            found[tuple(w[k : k + n])].add(item)
    out = {}
    for i, t in docs:
        w, hit, have = split(t), set(), set()
        for phrase, of in found.items():
            n = len(phrase)
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == phrase:
                    hit.update(range(k, k + n))
                    have |= of
        out[i] = (len(w), len(hit), sorted(map(str, have)), bool(hit))
    return out


def test_contamination(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(25)] + ["the"] * 20 + ["É"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.choice((0, 1, 3, 9, 10, 11, 40)))) for k in range(30)] + [(30, None), (31, "the " * 14), (32, "...Solo!"), (33, "w1-w2 W3")]
    docs = [(k, text(rng.randrange(60))) for k in range(60)]
    for k in range(60, 90):
        body, item = docs[k - 60][1].split(), (rng.choice(items)[1] or "").split()
        lo = rng.randrange(len(item) + 1)
        body[5:5] = item[lo : lo + rng.randrange(30)]
        docs.append((k, "(" + ", ".join(body).upper().replace("É", "É") + ")"))
    docs += [(100, None), (101, ""), (102, " . "), (103, "the " * 500), (104, "solo"), (105, "x w1 w2 w3")]
    frame = spark.createDataFrame([(k, t, 1) for k, t in items] + [(None, "w1 w2 w3 w4", 1)], "item_id long, text string, doc_id long")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in phrases.contamination(table(spark, docs), frame).collect()}
    assert got == brute_contamination(docs, items)


def test_contamination_of_each_text_of_an_id(spark):
    """Places in two texts of one id don't meet."""
    rows = [(1, "z0 z1 z2 z3 z4 z5 x x x x"), (1, "y y y y y y z6 z7 z8 z9"), (2, "z0 z1 z2 z3 z4 z5 z6 z7 z8 z9 y"), (2, "a b"), (2, "a b")]
    items = spark.createDataFrame([(7, " ".join(f"z{k}" for k in range(10)))], "item_id long, text string")
    got = sorted(tuple(r) for r in phrases.contamination(table(spark, rows), items).select("doc_id", "n_words", "n_hit", "contaminated").collect())
    assert got == [(1, 10, 0, False), (1, 10, 0, False), (2, 2, 0, False), (2, 2, 0, False), (2, 11, 10, True)]
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    rows = [(k % 7, text(rng.randrange(30))) for k in range(60)]
    items = [(k, text(rng.choice((2, 3, 10, 12)))) for k in range(8)]
    got = Counter(tuple(r) for r in phrases.contamination(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "n_words", "n_hit", "contaminated").collect())
    assert got == Counter((i, n, hit, bad) for i, t in rows for n, hit, _, bad in brute_contamination([(i, t)], items).values())


def test_contamination_odd_tables(spark):
    docs = table(spark, [(1, "a b"), (1, "a b"), (None, "a b"), (2, None)])
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    rows = sorted(((r["doc_id"], r["n_words"], r["contaminated"]) for r in phrases.contamination(docs, items).collect()), key=str)
    assert rows == [(1, 2, True), (1, 2, True), (2, 0, False), (None, 2, False)]
    assert phrases.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    assert phrases.contamination(docs.limit(0), items).count() == 0


def test_contamination_repeated_items(spark):
    long = [f"a{k}" for k in range(14)]
    other = [f"b{k}" for k in range(12)]
    items = [(1, " ".join(long)), (1, " ".join(long)), (2, " ".join(long)), (2, " ".join(other)), (2, "a0 b1 c2"), (3, " ".join(long[:8])), (3, None)]
    docs = [(1, "x " + " ".join(long)), (2, " ".join(other) + " y"), (3, " ".join(long[:9]) + " z"), (4, " ".join(other[:9])), (5, "a0 b1 c2"), (6, "a0 b1 a2")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in phrases.contamination(table(spark, docs), frame).collect()}
    assert got == brute_contamination(docs, items)
    assert got[1] == (15, 14, ["1", "2", "3"], True) and got[2] == (13, 12, ["2"], True)


def test_proximity(spark):
    docs = table(spark, [(1, "alpha x x beta x gamma"), (2, "alpha " + "x " * 50 + "beta gamma"), (3, "alpha beta")])
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    terms = phrases.vocabulary(items)
    found = phrases.proximity_matches(phrases.index(docs, terms), phrases.item_terms(items, terms), within=10).collect()
    assert [(r["doc_id"], r["pos"], r["span"]) for r in found] == [(1, 5, 6)]


# --- repeats


def brute_repeats(rows, length):
    count = Counter()
    data = {i: (t or "").encode() for i, t in rows}
    for x in data.values():
        count.update(x[k : k + length] for k in range(len(x) - length + 1))
    out = {}
    for i, x in data.items():
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if count[x[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(x)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = (len(x), sum(gone), runs, bytes(b for b, g in zip(x, gone) if not g))
    return out


@pytest.mark.parametrize("limit, hot", [(10**6, 10**6), (0, 10**6), (10**6, 2)])
def test_repeats(spark, limit, hot):
    rng = random.Random(4)
    base = some_docs(120, seed=5)
    extra = [(300, "ab" * 400), (301, "x" * 500), (302, base[0][1] * 3), (303, "é" * 199), (304, "".join(rng.choice("ab") for _ in range(3_000)))]
    rows = base + extra + [(305, "lead " + extra[4][1][700:1_300] + " tail"), (306, extra[4][1][899:1_098]), (307, extra[4][1][899:1_099])]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(table(spark, rows), limit=limit, hot=hot).collect()}
    assert got == brute_repeats(rows, repeats.LENGTH)


def test_repeats_odd_tables(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = sorted(((r["doc_id"], r["n_removed"]) for r in repeats.remove_repeats(table(spark, [(1, long), (1, long), (2, "z" * 100), (None, long + "!"), (1, "other text")])).collect()), key=str)
    assert rows == [(1, 0), (1, 400), (1, 400), (2, 0), (None, 400)]
    assert repeats.remove_repeats(table(spark, [])).count() == 0


def test_sliding_least():
    rng = np.random.default_rng(7)
    for n, width in ((1, 1), (10, 3), (50, 7), (64, 64), (30, 1)):
        values = rng.integers(0, 20, n).astype(np.uint64)
        expected = {i for k in range(n - width + 1) for i in range(k, k + width) if values[i] == values[k : k + width].min()}
        assert set(sliding_least(values, width).tolist()) >= expected


# --- pipeline and queries


def test_pipeline(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        sizes.append(docs.count())
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    assert docs.select("doc_id").distinct().count() == sizes[-1]


def test_decisions_take_effect(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    once = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    again = neardup.near_duplicates(once)
    assert once.count() < docs.count() and again.where("not kept").count() == 0
    clean = corpus_pipeline.drop_contaminated(spark, docs, sf_dir)
    truth = brute_contamination([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in read(spark, sf_dir, "benchmark").collect()])
    assert {r["doc_id"] for r in clean.collect()} == {i for i, t in truth.items() if not t[3]}


def test_queries_on_the_tables(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in read(spark, sf_dir, "documents").collect()]
    queries = registry.queries()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries["op1_neardup"](spark, sf_dir).collect()}
    assert got == brute_components(rows)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries["op5_repeats"](spark, sf_dir).collect()}
    assert got == {i: (*t[:3], hashlib.sha256(t[3]).hexdigest()) for i, t in brute_repeats(rows, 200).items()}
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in queries["op6_decontamination"](spark, sf_dir).collect()}
    items = [(r["item_id"], r["text"]) for r in read(spark, sf_dir, "benchmark").collect()]
    assert got == {i: (t[0], t[1], len(t[2]), hashlib.sha256(",".join(t[2]).encode()).hexdigest(), t[3]) for i, t in brute_contamination(rows, items).items()}
    assert {len(queries[n](spark, sf_dir).columns) >= 3 for n in queries} == {True}


def test_pipeline_on_odd_documents(spark, tmp_path):
    rows = [(None, None, "en", "s", None), (None, "null id", "en", "s", 7), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "some words, mail a.b@c.de", "de", "s", 20), (3, "x " * 40_000, "en", "s", 80_000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing like it at all"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {None, 1, 2, 3} and len(got) == len(rows)
    extra = spark.createDataFrame([(1, "some words in a text", 0.1, 3, True)], "doc_id long, text string, quality_score double, of long, kept boolean")
    model = (np.zeros(quality.BUCKETS + 1), 1.0)
    assert quality.accepted(extra, model).columns == extra.columns and quality.accepted(extra, (model[0], -1.0)).count() == 0
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_contaminated):
        assert stage(spark, extra, str(tmp_path)).columns == extra.columns
    assert pii.redact(extra).columns == extra.columns


def test_bwt_merge_is_exact():
    rng = random.Random(1)
    for length in (1, 2, 3, 5, 8):
        for _ in range(60):
            shards = [[bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 4))]
            strings = {(s, t, k): x[k : k + length] for s, texts in enumerate(shards) for t, x in enumerate(texts) for k in range(len(x) - length + 1)}
            counts = Counter(strings.values())
            assert sorted(bwt.repeated(shards, length)) == sorted(k for k, v in strings.items() if counts[v] > 1)
