"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The driver fits on a bounded sample of labelled rows (``SAMPLE`` examples) and indexes every term of theirs. Terms
count by how much their presence is tied to the label, but none is left out; document frequencies are counted over
all documents. The index is bounded by the sample, so it is broadcast; every task then looks up its own documents,
some dozens at a time.

Similar examples share a block. Each block has the largest weight of every term in it, so a document's best possible
cosine in a block is known before the block is visited, and blocks that can't reach its k-th best so far are left
out: the k nearest are exact. Terms of many examples are held as dense columns, the others as postings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from athletrack.llm.anchors import powers, prefix_hashes, window_hashes
from athletrack.llm.base import fold, label_sample, sliced
from athletrack.llm.trees import isotonic

SAMPLE = 6_000
NEIGHBOURS = 15
BLOCK = 128
HEAD = 1_024  # terms with dense columns
FIRST = 4  # blocks that a document visits before any is left out
TOGETHER = 64  # documents that are looked up together
PRIOR = 0.3  # similarity that the prior counts for in a vote
MEMO = 50_000
_IN_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
Vector = tuple[np.ndarray, np.ndarray]


def words(texts: list[str | None]) -> Vector:
    """(text, hash) of every word of the texts, A-Z lower-cased. Words are told apart by 64-bit hashes."""
    data = np.frombuffer(b"\0".join([b"", *((t or "").encode("utf-8", "surrogatepass").lower() for t in texts), b""]), np.uint8)
    edges = np.diff(_IN_WORD[data].astype(np.int8))
    start, stop = np.flatnonzero(edges == 1) + 1, np.flatnonzero(edges == -1) + 1
    up, down = _powers(len(data))
    row = np.searchsorted(np.flatnonzero(data == 0), start) - 1  # a text may hold further zeros
    if data.size - np.count_nonzero(data) != len(texts) + 1:
        row = np.searchsorted(np.cumsum([1, *(len((t or "").encode("utf-8", "surrogatepass")) + 1 for t in texts)]), start, "right") - 1
    return row, window_hashes(prefix_hashes(data, up), down, start, stop)


def _powers(n: int, held: list = [powers(1 << 16)]) -> Vector:  # noqa: B006  grown as needed
    if len(held[0][0]) < n:
        held[0] = powers(2 * n)
    return held[0]


def in_parts(texts: list[str | None], size: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Neighbouring texts of about ``size`` characters together, with the number of the first; long texts are alone."""
    part, first, held = [], 0, 0
    for k, text in enumerate(texts):
        if part and held + len(text or "") > size:
            yield first, part
            part, first, held = [], k, 0
        part.append(text)
        held += len(text or "")
    if part:
        yield first, part


class Vocabulary:
    """Numbers the terms of the examples, which are known by their hashes."""

    def __init__(self, texts: list[str | None]):
        self.hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(words(part)[1]) for _, part in in_parts(texts))]))

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count), in this order; other words are left out."""
        out = []
        for first, part in in_parts(texts):
            row, h = words(part)
            if not len(self.hashes):
                continue
            key = np.sort(h)  # looked up in order
            at = np.minimum(np.searchsorted(self.hashes, key), len(self.hashes) - 1)
            order = np.argsort(h, kind="stable")
            known = self.hashes[at] == key
            pair, n = np.unique((row[order][known] + first) * len(self.hashes) + at[known], return_counts=True)
            out.append((pair // len(self.hashes), pair % len(self.hashes), n))
        return tuple(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in out)]) for k in range(3))


def ties(row: np.ndarray, term: np.ndarray, labels: np.ndarray, n_terms: int) -> np.ndarray:
    """The weight of each term: the root of one plus the chi-square of its presence and the label.

    One is what a term without any tie is expected to have, so that no term is left out.
    """
    have, have_one = np.bincount(term, minlength=n_terms).astype(float), np.bincount(term, labels[row], n_terms)
    n, ones = len(labels), labels.sum()
    b, c = have - have_one, ones - have_one
    of = have * (n - have) * ones * (n - ones)
    chi = np.where(of > 0, n * (have_one * (n - have - c) - b * c) ** 2 / np.maximum(of, 1), 0.0)
    return np.sqrt(1 + chi)


def spans(lo: np.ndarray, hi: np.ndarray) -> Vector:
    """All numbers from each ``lo`` to before its ``hi``, and how many each has."""
    sizes = hi - lo
    return np.arange(sizes.sum()) + np.repeat(lo - sizes.cumsum() + sizes, sizes), sizes


def blocked(dense: np.ndarray, size: int) -> list[np.ndarray]:
    """The rows in blocks of at most ``size`` similar ones: halved along their main direction again and again."""
    done, todo = [], [np.arange(len(dense))] if len(dense) else []
    while todo:
        part = todo.pop()
        if len(part) <= size:
            done.append(part)
            continue
        centred = dense[part] - dense[part].mean(0)
        along = np.cos(np.arange(dense.shape[1], dtype=float))  # any start will do
        for _ in range(8):
            along = centred.T @ (centred @ along)
            along /= max(np.sqrt(along @ along), 1e-300)
        order = part[np.argsort(centred @ along, kind="stable")]
        half = -(-len(part) // (2 * size)) * size
        todo += [order[half:], order[:half]]
    return done


class Index:
    """Block-max inverted index of unit vectors; ``nearest`` gives the k largest cosines above zero, exactly.

    Equal cosines go to the example that comes first.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int, block: int = BLOCK, head: int = HEAD):
        self.n = n
        common = np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[:head]
        self.column = np.full(n_terms, -1, np.int32)
        self.column[common] = np.arange(len(common))
        dense = np.zeros((self.n, len(common)))
        in_head = self.column[term] >= 0
        dense[doc[in_head], self.column[term[in_head]]] = weight[in_head]
        blocks = blocked(dense, block)
        self.example = np.concatenate(blocks) if blocks else np.zeros(0, int)  # by place
        self.start = np.append(0, np.cumsum([len(x) for x in blocks])).astype(int)
        self.n_blocks = len(blocks)
        self.dense = dense[self.example]
        self.best_head = np.array([self.dense[lo:hi].max(0) for lo, hi in zip(self.start, self.start[1:])]).reshape(self.n_blocks, len(common))
        place, of_block = np.empty(self.n, int), np.repeat(np.arange(self.n_blocks), np.diff(self.start))
        place[self.example] = np.arange(self.n)
        term, weight, doc = term[~in_head], weight[~in_head], place[doc[~in_head]]
        order = np.lexsort((doc, term))
        self.place, self.weight = doc[order].astype(np.int32), weight[order]
        slot = term[order] * max(1, self.n_blocks) + of_block[self.place]
        # a slot is a term in a block that has it: slots of term t are first[t] to first[t + 1], their postings likewise
        some, at = np.unique(slot, return_index=True)
        self.at = np.append(at, len(slot))
        self.slot_block = (some % max(1, self.n_blocks)).astype(np.int32)
        self.best = np.maximum.reduceat(self.weight, at) if len(at) else np.zeros(0)
        self.first = np.searchsorted(some, np.arange(n_terms + 1) * max(1, self.n_blocks))

    def nearest(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, m: int, k: int) -> list[Vector]:
        """(examples, cosines) of each of ``m`` queries, nearest first."""
        n, b = self.n, self.n_blocks
        if not n:
            return [(np.zeros(0, int), np.zeros(0))] * m
        column = self.column[term]
        head = column >= 0
        asked = np.zeros((m, self.dense.shape[1]))
        asked[row[head], column[head]] = weight[head]
        row, term, weight = row[~head], term[~head], weight[~head]
        slots, sizes = spans(self.first[term], self.first[term + 1])
        row, weight = np.repeat(row, sizes), np.repeat(weight, sizes)
        bound = asked @ self.best_head.T + np.bincount(row * b + self.slot_block[slots], weight * self.best[slots], minlength=m * b).reshape(m, b)
        postings, sizes = spans(self.at[slots], self.at[slots + 1])
        rare = np.bincount(np.repeat(row, sizes) * n + self.place[postings], np.repeat(weight, sizes) * self.weight[postings], minlength=m * n).reshape(m, n)
        by_bound = np.argsort(-bound, axis=1, kind="stable")
        visit = np.zeros((m, b), bool)
        np.put_along_axis(visit, by_bound[:, :FIRST], True, 1)
        first, scores, least = visit, np.zeros((m, n)), np.full(m, 1e-12)
        for again in (False, True):
            if again:
                visit = ~first & (bound >= least[:, None])
            for j in np.flatnonzero(visit.any(0)):
                rows, lo, hi = np.flatnonzero(visit[:, j]), self.start[j], self.start[j + 1]
                scores[rows, lo:hi] = asked[rows] @ self.dense[lo:hi].T + rare[rows, lo:hi]
            if not again:
                for i in range(m):
                    seen = np.concatenate([scores[i, self.start[j] : self.start[j + 1]] for j in by_bound[i, :FIRST]])
                    if len(seen) >= k:
                        least[i] = max(1e-12, np.partition(seen, -k)[-k] - 1e-9)
        found, of = np.nonzero(scores >= least[:, None])
        ends = np.searchsorted(found, np.arange(m + 1))
        out = []
        for lo, hi in zip(ends, ends[1:]):
            examples, cosines = self.example[of[lo:hi]], scores[found[lo], of[lo:hi]].round(9) if lo < hi else np.zeros(0)
            best = np.lexsort((examples, -cosines))[:k]
            best = best[cosines[best] > 0]
            out.append((examples[best], cosines[best]))
        return out


class Model:
    """Labelled examples as unit vectors, how they vote, and what a vote means (fitted leaving each one out).

    ``idf`` has the weight of each term: its inverse document frequency times its tie to the label.
    """

    def __init__(self, vocabulary: Vocabulary, idf: np.ndarray, ids: list[int], labels: np.ndarray, counted: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.vocabulary, self.idf, self.ids, self.labels = vocabulary, idf, np.array(ids, np.int64), labels
        self.prior = float((labels.sum() + 1) / (len(ids) + 2))
        row, term, weight = self.weighed(*counted, len(ids))
        self.index = Index(row, term, weight, len(ids), len(idf))
        none = np.bincount(row, minlength=len(ids)) == 0
        #: no term of any example: the share of label 1 among such examples
        self.nothing = float((labels[none].sum() + self.prior) / (none.sum() + 1))
        votes = []
        for at in range(0, len(ids), TOGETHER):
            lo, hi = np.searchsorted(row, (at, at + TOGETHER))
            m = min(TOGETHER, len(ids) - at)
            for j, (near, cosines) in enumerate(self.index.nearest(row[lo:hi] - at, term[lo:hi], weight[lo:hi], m, NEIGHBOURS + 1), at):
                others = near != j  # an example does not vote for itself
                votes.append(self.vote(near[others][:NEIGHBOURS], cosines[others][:NEIGHBOURS])[0])
        votes, y = np.array(votes)[~none], labels[~none]
        self.curve = isotonic(votes, y) if len(y) else (np.zeros(1), np.array([self.prior]))
        self.memo: dict[bytes, tuple[float, list[int]]] = {}

    def weighed(self, row: np.ndarray, term: np.ndarray, n: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The unit vectors of ``m`` texts."""
        weight = (1 + np.log(n)) * self.idf[term]
        return row, term, weight / np.maximum(np.sqrt(np.bincount(row, weight**2, m)), 1e-12)[row]

    def vote(self, ids: np.ndarray, cosines: np.ndarray) -> tuple[float, list[int]]:
        return float((cosines @ self.labels[ids] + PRIOR * self.prior) / (cosines.sum() + PRIOR)), self.ids[ids].tolist()

    def score(self, texts: list[str | None]) -> list[tuple[float, list[int]]]:
        """(score, evidence) of each text; equal vectors are looked up once."""
        row, term, weight = self.weighed(*self.vocabulary.count(texts), len(texts))
        ends = np.searchsorted(row, np.arange(len(texts) + 1))
        if len(self.memo) >= MEMO:
            self.memo.clear()
        keys, new = [], {}
        for k, (lo, hi) in enumerate(zip(ends, ends[1:])):
            keys.append(hashlib.blake2b(term[lo:hi].tobytes() + weight[lo:hi].tobytes(), digest_size=16).digest() if lo < hi else b"")
            if keys[-1] and keys[-1] not in self.memo:
                new.setdefault(keys[-1], k)
        if new:
            want = np.full(len(texts), -1)
            want[list(new.values())] = np.arange(len(new))
            asked = want[row] >= 0
            for key, near in zip(new, self.index.nearest(want[row][asked], term[asked], weight[asked], len(new), NEIGHBOURS)):
                vote, evidence = self.vote(*near)
                self.memo[key] = float(np.interp(vote, *self.curve)), evidence
        return [self.memo[key] if key else (self.nothing, []) for key in keys]


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term, n) as two byte strings for each batch."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()) for k in (0, 1)], ["term", "n"])


def frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """The number of documents, and of those with each term. Every task sends a row for each of its terms."""
    n_terms = len(vocabulary.hashes)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(n_terms + 1, np.int64)  # the last one counts documents
        for batch in sliced(batches):
            have[:n_terms] += np.bincount(sent.value.count(batch.column(0).to_pylist())[1], minlength=n_terms)
            have[n_terms] += batch.num_rows
        some = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(have[some])], ["term", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = np.zeros(n_terms + 1)
    for r in rows.mapInArrow(packed, "term binary, n binary").toLocalIterator():  # a number for each term of the sample at most
        df[np.frombuffer(r["term"], np.int64)] = np.frombuffer(r["n"], np.int64)
    return int(df[-1]), df[:-1]


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", limit: int = SAMPLE) -> Model:
    """Fitted on all terms of at most ``limit`` labelled examples."""
    sample = label_sample(docs, labels, label, keep, limit)
    texts, ids, y = [r["text"] for r in sample], [r["doc_id"] for r in sample], np.array([r["label"] for r in sample], float)
    vocabulary = Vocabulary(texts)
    counted = vocabulary.count(texts)
    del sample, texts
    n, df = frequencies(docs, vocabulary)
    idf = (np.log((1 + n) / (1 + df)) + 1) * ties(*counted[:2], y, len(df))
    return Model(vocabulary, idf, ids, y, counted)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score double, evidence array<long>) for every row.

    ``evidence`` has the doc_ids of the nearest labelled examples, nearest first. Texts that share no term with any
    example, null and empty ones too, get the share of label 1 among such examples and no evidence. Repeated rows
    each give a row, a null doc_id stays null, other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(model)  # the terms of SAMPLE texts at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, TOGETHER):
            found = model.value.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, evidence array<long>")


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0, limit: int = SAMPLE) -> DataFrame:
    """Scores of all documents by examples outside the held-out fold."""
    rest = fold(F.col("doc_id"), parts)
    return score(docs, train(docs, labels, rest != held_out, "toxic", limit)).select(
        "doc_id",
        F.coalesce(rest == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "evidence",
    )
