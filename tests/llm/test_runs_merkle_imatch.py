"""Periodic runs, the Merkle manifest and I-Match fingerprints against brute force, and their edge cases."""

import math
import random
import re
from collections import Counter
from hashlib import sha256
from statistics import mean
from zlib import crc32

import numpy as np
import pytest

from athletrack.llm import base, imatch, merkle, registry, runs

ROWS = "doc_id long, source string, lang string, n_chars long, text string, kept boolean, idx long, tree long, runs string, leaf string, bucket long, lead boolean"


def frame(spark, texts, ids=None, langs=None, parts=3):
    """Documents, with columns whose names clash with results and inner columns."""
    ids = range(len(texts)) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    return spark.createDataFrame([(i, f"s{k % 2}", lang, k, t, True, 7, 8, "x", "y", 9, False) for k, (i, t, lang) in enumerate(zip(ids, texts, langs))], ROWS).repartition(parts)


def hexed(text):
    return sha256(text.encode()).hexdigest()


# --- runs


def brute_runs(words):
    w, out = np.array([hash(x) for x in words], np.int64), []
    for q in range(1, len(w) // 3 + 1):
        same = np.concatenate([[False], w[q:] == w[:-q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            start, length = a, b - a + q
            inside = w[start : start + length]
            if length >= max(24, 3 * q) and not any((inside[p:] == inside[:-p]).all() for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text, tamper=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if tamper and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None,) * 3
    milli = 1000 * best[1] // best[2] if found else None
    return len(found), *best, milli, hexed("".join(f"{s},{length},{q}\n" for s, length, q in found)), hexed(" ".join(x for i, x in enumerate(words) if i not in gone))


def periodic_texts(n=300, seed=5):
    rng = random.Random(seed)
    out = [None, "", " \n", "a", "a " * 23, "a " * 24, "a b " * 12, "a b " * 11 + "a", "x " + "a " * 5_000, "a b c d e f g h i " * 3, "a b c d e f g h i " * 3 + "a", "é \x1c " * 30]
    for k in range(n):
        words = [rng.choice("abc" if k % 3 else "ab") for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            piece = [rng.choice("abcd") for _ in range(rng.randrange(1, 30))]
            block = (piece * rng.randrange(2, 8))[: rng.randrange(10, 150)]
            if rng.random() < 0.3:
                block[rng.randrange(len(block))] = "z"
            at = rng.randrange(len(words) + 1)
            words[at:at] = block
        out.append(rng.choice((" ", "\n", "\t ")).join(words))
    return out


def test_runs_against_brute_force(spark):
    texts = periodic_texts()
    ids = [None, 1, 1, *range(2, len(texts) - 1)]
    got = sorted(map(str, map(tuple, runs.digests(runs.periodic_runs(frame(spark, texts, ids), runs.repeated_tail)).collect())))
    assert got == sorted(str((i, *brute_digest(i, t))) for i, t in zip(ids, texts))
    plain = {r["doc_id"]: r for r in runs.digests(runs.periodic_runs(frame(spark, texts))).collect()}
    assert all(tuple(plain[k])[1:] == brute_digest(k, t, False) for k, t in enumerate(texts))
    assert runs.digests(runs.periodic_runs(frame(spark, texts).limit(0))).count() == 0


def test_overlapping_runs_of_several_periods():
    words = ("a b " * 20 + "a b c " * 20 + "d " * 30 + "a b c d e f g h i j k l m n o p q r s t u v w " * 4).split()
    assert runs.find_runs(np.unique(words, return_inverse=True)[1]) == brute_runs(words)


def test_query_of_runs(spark, sf_dir):
    docs = base.read(spark, sf_dir, "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in registry.op13_runs(spark, sf_dir).collect()}
    assert got == {r["doc_id"]: brute_digest(r["doc_id"], r["text"]) for r in docs}
    assert sum(g[0] for g in got.values()) > 0


# --- Merkle


def brute_merkle(rows):
    def h(*parts):
        return hexed("".join(parts))

    def value(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
        return out

    def path(tree, k):
        for level in tree[:-1]:
            yield level[k ^ 1] if k ^ 1 < len(level) else None, k & 1
            k >>= 1

    leafed = [(r, h(*map(value, r))) for r in rows]  # rows: doc_id, source, lang, n_chars, text
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted(((r, leaf) for r, leaf in leafed if r[2] == lang), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1])) for lang in langs]
    trees = [levels([leaf for _, leaf in g]) for g in groups]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, (g, tree) in enumerate(zip(groups, trees)):
        for i, (r, leaf) in enumerate(g):
            hit = r[0] is not None and crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            folded = h(*map(value, (*r[:3], r[3] + 1, r[4]))) if hit else leaf
            siblings = []
            for other, right in [*path(tree, i), *path(top, k)]:
                folded = h(folded) if other is None else h(other, folded) if right else h(folded, other)
                siblings += [] if other is None else [other]
            out.append((r[0], leaf, tree[-1][0], top[-1][0], h(*siblings), folded, folded == top[-1][0]))
    return sorted(map(str, out))


def merkle_rows(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("sizes", [[1], [2], [3], [5, 1], [1, 1, 1], [2_100, 1_024, 1_025, 7]])
def test_merkle_of_any_shape(spark, sizes):
    langs = [lang for lang, n in zip((None, "en", "é", "de"), sizes) for _ in range(n)]
    df = frame(spark, [f"text {k % 50}" for k in range(len(langs))], langs=langs)
    assert sorted(map(str, map(tuple, merkle.merkle(df).collect()))) == brute_merkle(merkle_rows(df))


def test_merkle_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "a", "en", 3, ""), (5, "a", "en", None, "x"), (5, "a", "en", None, "x"), (5, "b", "en", 1, "y" * 100_000), (-3, "", "", -1, "é\n"), (0, "a", None, 2**62, "-")]
    rows += [(k, "s", "fr", k, None) for k in range(60)]
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, idx long, level int")
    assert sorted(map(str, map(tuple, merkle.merkle(df).collect()))) == brute_merkle(rows)
    assert merkle.merkle(df.limit(0)).count() == 0


def test_proofs_of_some_rows(spark):
    """A part of the leaves: their blocks fetch the nodes that the other leaves would give."""
    df = frame(spark, [f"t{k}" for k in range(3_000)], langs=[("en", "de")[k % 3 == 0] for k in range(3_000)])
    whole = {r["doc_id"]: tuple(r) for r in merkle.merkle(df).collect()}
    placed, nodes = merkle.manifest(merkle.leaves(df))
    some = merkle.proofs(placed.where("doc_id % 97 = 5 or doc_id in (0, 1, 2999)"), nodes).collect()
    assert len(some) > 30 and all(tuple(r) == whole[r["doc_id"]] for r in some)
    assert any(r["verified"] for r in some) and not all(r["verified"] for r in some)


def test_query_of_merkle(spark, sf_dir):
    rows = merkle_rows(base.read(spark, sf_dir, "documents"))
    assert sorted(map(str, map(tuple, registry.op12_merkle(spark, sf_dir).collect()))) == brute_merkle(rows)


# --- I-Match


def some_texts(n=400, seed=6):
    """Texts of a long-tailed vocabulary, some of them equal."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(5_000)]
    out = [" ".join(words[min(int(rng.paretovariate(0.6)), 4_999)] for _ in range(rng.randrange(20, 200))) for _ in range(n)]
    return out + out[:20] + [None, "", "...", "É", "the " * 40_000]


def brute_bitmap(texts, idf=imatch.IDF):
    counts = Counter()
    for t in texts:
        counts.update({int(h) % imatch.CELLS for h in imatch.terms(t or "")})
    low, high = len(texts) * math.exp(-idf[1]), len(texts) * math.exp(-idf[0])
    bitmap = np.zeros(imatch.CELLS, bool)
    bitmap[[c for c, n in counts.items() if max(low, 1) <= n <= high]] = True
    return np.packbits(bitmap, bitorder="little")


def brute_comparison(ids, texts, bitmap):
    rows = sorted(zip(ids, [t or "" for t in texts]), key=lambda r: (r[0] is not None, r[0] or 0))
    marks = [imatch.fingerprint(t, bitmap) for _, t in rows]
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        second = imatch.fingerprint(changed, bitmap)
        yield i, len(t), hexed(changed), marks[k], second, imatch.likeness(marks[k], second), imatch.likeness(marks[k], marks[(k + 1) % len(rows)])


def test_lexicon_and_comparison(spark):
    texts = some_texts()
    ids = [*range(-200, -200 + len(texts) - 1), None]
    df = frame(spark, texts, ids, parts=7)
    bitmap = imatch.lexicon(df, (1.0, 5.0))
    assert (bitmap == brute_bitmap(texts, (1.0, 5.0))).all() and bitmap.any()
    assert sorted(map(tuple, imatch.compare_edited(df, bitmap).collect()), key=str) == sorted(brute_comparison(ids, texts, bitmap), key=str)
    rows = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(df, bitmap).collect()}
    assert all(rows[i] == imatch.fingerprint(t or "", bitmap) for i, t in zip(ids, texts))
    assert rows[-200] == rows[200]  # equal texts


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_comparison_of_small_tables(spark, n):
    texts, ids = ["one two three four", None, "five six"][:n], [3, 1, 2][:n]
    df = frame(spark, texts, ids)
    bitmap = imatch.lexicon(df)
    assert sorted(map(tuple, imatch.compare_edited(df, bitmap).collect())) == sorted(brute_comparison(ids, texts, bitmap))


def test_repeated_ids_give_a_row_each(spark):
    texts = ["a b c", "a b c", "d e f", None] * 5
    df = frame(spark, texts, [1, 1, 1, None] * 5)
    out = imatch.compare_edited(df, imatch.lexicon(df)).collect()
    assert len(out) == 20 and Counter(r["n_chars"] for r in out) == {5: 15, 0: 5}


def test_likeness_tells_shares():
    texts = some_texts(300, 8)[:300]
    bitmap = brute_bitmap(texts, (1.0, 6.0))
    marks = [imatch.fingerprint(t, bitmap) for t in texts]

    def near(share):
        return mean(imatch.likeness(m, imatch.fingerprint(" ".join(t.split()[int(share * len(t.split())) :] + u.split()[: int(share * len(t.split()))]), bitmap)) for t, u, m in zip(texts, texts[1:], marks))

    few, half, most = near(0.1), near(0.5), near(0.9)
    others = mean(map(imatch.likeness, marks, marks[1:]))
    assert few > half + 0.1 > most + 0.2 and half > others + 0.15, (few, half, most, others)
    assert imatch.likeness(marks[0], marks[0]) == 1.0


def test_query_of_imatch(spark, sf_dir):
    docs = base.read(spark, sf_dir, "documents").select("doc_id", "text").collect()
    ids, texts = [r["doc_id"] for r in docs], [r["text"] for r in docs]
    got = sorted(map(tuple, registry.op11_imatch(spark, sf_dir).collect()))
    assert got == sorted(brute_comparison(ids, texts, brute_bitmap(texts)))
    assert mean(r[5] for r in got) > mean(r[6] for r in got) + 0.2
