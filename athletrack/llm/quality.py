"""Quality classifier: learned vectors of hashed words and character n-grams, averaged over the document.

The driver fits on a bounded sample of labelled rows (``SAMPLE``) by stochastic gradient descent in numpy; the
model is a table of ``BUCKETS`` vectors and a softmax layer, of fixed size. Scoring reads every whole text; as the
output layer is linear in the average, each bucket adds one number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from athletrack.llm.base import fold, label_sample, sliced

BITS = 16
BUCKETS = 1 << BITS
DIM = 8
SAMPLE = 4_000
EPOCHS = 5
AGAIN = BUCKETS  # the row of the feature "same word as the one before"
AGAIN_WEIGHT = 12  # it counts like the n-grams of an average word
PIECE = 1 << 18  # bytes looked at together
GRAMS = (3, 4, 5)
_K = np.uint32(0x01000193)
_MIX = np.uint32(0x9E3779B1)
_INVERSE = np.uint32(pow(0x01000193, -1, 1 << 32))


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    h = (h ^ np.uint32(n * 0x85EB)) * _MIX
    h ^= h >> np.uint32(15)
    return (h * _MIX) >> np.uint32(32 - BITS)


def hashed(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start positions, buckets) of the words, then of the character n-grams, then of repeated words.

    ``data``: bytes of lower-cased words with one space before, between and after them. An n-gram may start or end
    at a space, so word ends are part of it, but holds none inside.
    """
    space = data == 32
    wide = data.astype(np.uint32)
    powers = np.cumprod(np.full(len(data), _K), dtype=np.uint32)
    inverse = np.cumprod(np.full(len(data), _INVERSE), dtype=np.uint32)
    total = np.concatenate([np.zeros(1, np.uint32), np.cumsum(wide * powers, dtype=np.uint32)])
    ends = np.flatnonzero(space)
    start, stop = ends[:-1] + 1, ends[1:]
    word = stop > start
    start, stop = start[word], stop[word]
    words = (total[stop] - total[start]) * inverse[start]
    yield start, _buckets(words, 1)
    seen = np.cumsum(space, dtype=np.int32)
    for n in GRAMS:
        if len(data) >= n:
            last = len(data) - n + 1
            inside = seen[n - 2 : n - 2 + last] == seen[:last]  # no space after the first byte and before the last
            at = np.flatnonzero(inside)
            h = np.zeros(last, np.uint32)
            for j in range(n):
                h *= _K
                h += wide[j : j + last]
            yield at, _buckets(h[at], n)
    same = np.flatnonzero((words[1:] == words[:-1]) & (start[1:] == stop[:-1] + 1))
    yield start[1:][same], np.full(len(same), AGAIN)


def pieces(text: str | None) -> list[bytes]:
    """A text's words for ``hashed``; very long texts in several pieces, cut at spaces."""
    data = b" " + b" ".join((text or "").lower().encode("utf-8", "surrogatepass").split()) + b" "
    out = []
    while len(data) > 2 * PIECE and (cut := data.find(b" ", PIECE)) < len(data) - 1:
        out.append(data[: cut + 1])
        data = data[cut:]
    return [*out, data]


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a document and their shares of all its features (shares sum to one; none: empty)."""
    counts = np.zeros(BUCKETS + 1)
    for data in pieces(text):
        for _, buckets in hashed(np.frombuffer(data, np.uint8)):
            counts += np.bincount(buckets, minlength=BUCKETS + 1)
    counts[AGAIN] *= AGAIN_WEIGHT
    index = np.flatnonzero(counts)
    return index, counts[index] / max(counts.sum(), 1)


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS, dim: int = DIM, rate: float = 2.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights of each bucket towards label 1 in the averaged log odds, and the bias. Classes weigh the same."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1 / dim, (BUCKETS + 1, dim))
    out, bias = np.zeros((dim, 2)), np.zeros(2)
    bags = [(*bag(t), y) for t, y in rows]
    counts = np.bincount([y for _, y in rows], minlength=2)
    if not counts.all():  # nothing to tell apart: the share of the only class, or one half
        p = (counts[1] + 1) / (counts.sum() + 2)
        return np.zeros(BUCKETS + 1), float(np.log(p / (1 - p)))
    weight = counts.sum() / (2 * counts)
    steps = epochs * len(bags)
    out += rng.normal(0, 0.1, out.shape)
    for step, at in enumerate(i for _ in range(epochs) for i in rng.permutation(len(bags))):
        index, share, y = bags[at]
        lr = rate * (1 - step / steps)
        h = share @ vectors[index]
        z = h @ out + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y] -= 1
        p *= weight[y]
        down = out @ p
        out -= lr * 0.5 * np.outer(h, p)
        bias -= lr * 0.05 * p
        # shares are small, so a step on the vectors is larger, as with one vector for each of the features
        vectors[index] -= (lr * 40 * share / np.sqrt((share**2).sum() * len(share)))[:, None].clip(max=lr) * down
    step = out[:, 1] - out[:, 0]
    return vectors @ step, float(bias[1] - bias[0])


def scores(texts: list[str | None], weights: np.ndarray, bias: float) -> np.ndarray:
    """Probabilities of label 1. Texts are looked at together in groups of about ``PIECE`` bytes."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    group: list[bytes] = []
    owner: list[int] = []

    def flush() -> None:
        data = np.frombuffer(b"".join(group), np.uint8)
        starts = np.cumsum([0, *map(len, group)])[:-1]
        each, n = np.zeros(len(data)), np.zeros(len(data), np.int32)
        for at, buckets in hashed(data):
            by = AGAIN_WEIGHT if len(buckets) and buckets[0] == AGAIN else 1
            each[at] += by * weights[buckets]  # positions of one kind are distinct
            n[at] += by
        np.add.at(total, owner, np.add.reduceat(each, starts))
        np.add.at(count, owner, np.add.reduceat(n, starts))
        group.clear()
        owner.clear()

    size = 0
    for i, text in enumerate(texts):
        for data in pieces(text):
            group.append(data)
            owner.append(i)
            size += len(data)
            if size > PIECE:
                flush()
                size = 0
    if group:
        flush()
    return 1 / (1 + np.exp(-np.clip(bias + total / np.maximum(count, 1), -500, 500)))


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", limit: int = SAMPLE) -> tuple[np.ndarray, float]:
    return fit([(r["text"], r["label"]) for r in label_sample(docs, labels, label, keep, limit)])


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score double) for every row: the estimated odds that the label is 1, from the whole text.

    Null and empty texts get the score of the bias alone. Repeated rows each give a row, a null doc_id stays null,
    other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(part.column(1).to_pylist(), *model.value))], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def quality(docs: DataFrame, labels: DataFrame, parts: int = 3, held_out: int = 1, limit: int = SAMPLE) -> DataFrame:
    """Scores of all documents by a model that never saw labels of the held-out fold."""
    rest = fold(F.col("doc_id"), parts)
    scored = score(docs, train(docs, labels, rest != held_out, "quality", limit))
    return scored.select(
        "doc_id",
        F.coalesce(rest == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, model: tuple[np.ndarray, float], least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, with all their columns; texts are read where they are."""
    model = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))  # fixed size
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            yield part.filter(pa.array(scores(part.column(at).to_pylist(), *model.value) >= least))

    return docs.mapInArrow(run, docs.schema)
