"""Runs of words that repeat with a period: an online sparse dynamic programme over diagonals.

A diagonal is a lag: the words of a text against the words ``lag`` places before. Word by word, the active diagonals
add to their match length where the earlier occurrence is the same word, and a diagonal that ends emits its run at
once if it has matched long enough. Diagonals are few because they open only where they can become a run: where a
window of words has its nearest earlier occurrence at most its own size back. Windows of 13 words find the periods up
to 13 (the shortest run, 24 words, still holds one), windows of twice the size the next ones; a period shows as the
nearest earlier occurrence of every window at least as long, as a shorter lag would be a smaller period. Frequent
words thus cost nothing by themselves, and the work is n log n in a text's words.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athletrack.llm.base import sliced

LEAST = 24  # words of a run
TIMES = 3  # periods of a run
STEPS = (1, 2, 4, 5)  # from words to windows of 13 words
CHUNK = 1 << 24  # bytes of a text that are split at a time
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MIX = np.uint64(0x9E3779B97F4A7C15)
Edit = Callable[[object, np.ndarray], np.ndarray]


def numbered(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers, and the word of each number. Only distinct words are held as objects."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids, at = array("q"), 0
    while at < len(data):
        cut = _SPACE.search(data, at + CHUNK)  # no word is cut
        end = cut.start() if cut else len(data)
        ids.extend(map(number.__getitem__, data[at:end].split()))
        at = end
    return np.array(ids, np.int64), list(number)


def repeats_windows(words: np.ndarray) -> bool:
    """Whether two windows of 13 words may be equal; never false where they are."""
    if len(words) < LEAST:
        return False
    h = words.astype(np.uint64) * _MIX
    for step in STEPS:
        h = h ^ (h >> np.uint64(29))
        h = h[:-step] * _MIX + h[step:]
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def openings(words: np.ndarray) -> list[tuple[int, int]]:
    """(place, lag) in order, where a window that ends at ``place`` has its nearest earlier occurrence ``lag`` back, at most its size."""

    def pairs(rank: np.ndarray, step: int) -> np.ndarray:
        return np.unique(rank[:-step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1]

    rank, size, out = words, 1, []
    for step in STEPS:
        rank, size = pairs(rank, step), size + step
    least = 0
    while True:
        order = np.argsort(rank, kind="stable")
        same = rank[order[1:]] == rank[order[:-1]]
        lag = np.zeros(len(rank) + 1, np.int64)  # of the window that begins at each place, after one that has none
        lag[order[1:] + 1] = np.where(same, order[1:] - order[:-1], 0)
        lag[(lag <= least) | (lag > size)] = 0  # smaller ones showed in smaller windows
        first = np.flatnonzero((lag[1:] != lag[:-1]) & (lag[1:] > 0))  # the diagonal stays active along a stretch of one lag
        out.append(np.stack([first + size - 1, lag[first + 1]], 1))
        if not same.any() or len(words) <= TIMES * size:
            break
        least = size
        rank, size = pairs(rank, size), 2 * size
    return sorted(map(tuple, np.concatenate(out).tolist()))


def find_runs(numbers: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period.

    A run is a stretch with smallest period q, of at least max(LEAST, TIMES * q) words, that no neighbouring word extends.
    """
    if not repeats_windows(numbers):
        return []
    words, opened = numbers.tolist(), openings(numbers)
    active: dict[int, int] = {}  # lag: words matched so far
    runs, k, at = [], 0, 0

    def emit(end: int, ended: list[int]) -> None:
        least: dict[int, int] = {}  # a stretch that several diagonals give has the smallest as its period
        for lag in ended:
            length = active.pop(lag) + lag
            if length >= max(LEAST, TIMES * lag):
                least[end - length] = min(lag, least.get(end - length, lag))
        runs.extend((start, end - start, lag) for start, lag in least.items())

    while active or k < len(opened):
        if not active:
            at = opened[k][0]
        if at == len(words):
            break
        ended = []
        for lag in active:
            if words[at] == words[at - lag]:
                active[lag] += 1
            else:
                ended.append(lag)
        if ended:
            emit(at, ended)
        while k < len(opened) and opened[k][0] == at:
            lag, k = opened[k][1], k + 1
            if lag not in active:
                back = at
                while back >= lag and words[back] == words[back - lag]:
                    back -= 1
                active[lag] = at - back
        at += 1
    emit(len(words), list(active))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for words that no run contains after its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) == 0


def periodic_runs(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """(doc_id, n_words, runs, text) for every row: its runs by start and period, and the words that no run repeats, joined by one space.

    ``edit`` may change the word numbers of a row, given its doc_id, before runs are looked for. Each row is judged by
    itself, so nothing is shuffled: repeated rows give equal rows, a null doc_id stays null. Null and empty texts have
    no words, no runs and an empty text. A text is held by one task, as numbers. Other columns are not read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts, found, texts = [], [], []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, spelled = numbered(data or b"")
                if edit is not None and len(words):
                    words = edit(doc_id, words)
                runs = find_runs(words)
                counts.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                left = words[kept_words(len(words), runs)] if runs else words
                texts.append(b" ".join(map(spelled.__getitem__, left.tolist())))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, run_type), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "text"])

    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, schema)


def repeated_tail(doc_id: object, words: np.ndarray) -> np.ndarray:
    """The tail of one text in ten, by the hash of its doc_id, made periodic; a null doc_id changes nothing."""
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    i = np.arange(n)
    i[a:] = a + (i[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return words[i]


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, the run of the greatest exponent, runs_sha256, collapsed_sha256)."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    # runs come by start and period, so the first of the greatest wins; products of lengths and periods are exact
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
