"""Exact removal of long strings that repeat anywhere in a corpus.

A byte goes if a string of ``length`` bytes that covers it also starts somewhere else. Equal strings have the same
anchor (``anchors``), so only positions around repeated anchors matter. An anchor's context is what strings through
it can cover: ``length - size`` bytes before it and ``length`` after its start. Contexts that occur twice are covered
whole. Contexts that share their anchor with different ones are compared string by string: all their strings of
``length`` bytes are counted, inside a task that holds one context of each kind, or as rows if an anchor has very many.

This is not the merging of Burrows-Wheeler transforms; README.md says why, with figures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from athletrack.llm.anchors import mixed, powers, prefix_hashes, sliding_least, window_hashes
from athletrack.llm.base import written

LENGTH, SIZE = 200, 100
BROADCAST_CONTEXTS = 5_000_000  # 10 bytes each
HOT_CONTEXTS = 20_000  # of one anchor; their strings are counted as rows instead of inside a task
WHOLE, MIXED, HOT = 1, 2, 4
_PLACE = np.uint64(0x9E3779B97F4A7C15)


class Marks:
    """Anchors of a text, with hashes of the anchor and of its whole context."""

    def __init__(self, length: int = LENGTH, size: int = SIZE):
        self.length, self.size, self.up, self.down = length, size, np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def __call__(self, data: bytes) -> tuple[np.ndarray, ...]:
        """(anchor hash, context hash, position, context start, context end), int64 each."""
        n = len(data)
        if n < self.length:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        if n >= len(self.up):
            self.up, self.down = powers(2 * n + 1)
        prefix = prefix_hashes(np.frombuffer(data, np.uint8), self.up)
        start = np.arange(n - self.size + 1)
        h = window_hashes(prefix, self.down, start, start + self.size)
        pos = sliding_least(h, self.length - self.size + 1)
        lo, hi = np.maximum(0, pos - (self.length - self.size)), np.minimum(n, pos + self.length)
        shape = ((pos - lo) * (2 * self.length) + (hi - pos)).astype(np.uint64)
        context = mixed(window_hashes(prefix, self.down, lo, hi) + shape * _PLACE + h[pos] * np.uint64(3))
        return h[pos].view(np.int64), context.view(np.int64), pos, lo, hi


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def version(data: bytes) -> int:
    """Tells texts of one doc_id apart."""
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def contexts(docs: DataFrame, length: int = LENGTH, size: int = SIZE) -> DataFrame:
    """(h, context, n, kinds): contexts of anchors that occur more than once; ``kinds`` counts the anchor's contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(length, size)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found = [marks(_bytes(t)) for t in batch.column(0).slice(at, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], ["h", "context"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "h long, context long")
    kinds = rows.groupBy("h", "context").agg(F.count(F.lit(1)).alias("n"))
    of_anchor = Window.partitionBy("h")
    kinds = kinds.withColumn("all", F.sum("n").over(of_anchor)).withColumn("kinds", F.count(F.lit(1)).over(of_anchor)).where(F.col("all") > 1)
    return kinds.select("h", "context", "n", "kinds")


def _emit(found, flags, data: bytes, doc, seen: set[int], out: dict[str, list]) -> None:
    """Rows for a text's repeated anchors: covered runs, and contexts to compare."""
    h, context, pos, lo, hi = found
    v = version(data)
    whole = (flags & WHOLE).astype(bool)
    start, stop = lo[whole & (hi - lo >= LENGTH)], hi[whole & (hi - lo >= LENGTH)]
    if len(start):
        cut = np.flatnonzero(start[1:] > np.maximum.accumulate(stop)[:-1]) + 1
        for a, b in zip(start[np.append(0, cut)].tolist(), np.maximum.accumulate(stop)[np.append(cut - 1, len(stop) - 1)].tolist()):
            _row(out, doc, v, a, b, None, None, 0, False, False, 0)
    for i in np.flatnonzero(flags & MIXED):
        if whole[i]:
            if int(context[i]) in seen:
                continue
            seen.add(int(context[i]))
        _row(out, doc, v, int(lo[i]), int(hi[i]), int(h[i]), data[lo[i] : hi[i]], int(pos[i] - lo[i]), bool(whole[i]), bool(flags[i] & HOT), int(context[i]))


_FIELDS = ("doc_id", "v", "start", "end", "h", "bytes", "at", "whole", "hot", "context")


def _row(out: dict[str, list], *values) -> None:
    for name, value in zip(_FIELDS, values):
        out[name].append(value)


def _schema(kind: str) -> str:
    return f"doc_id {kind}, v long, start long, end long, h long, bytes binary, at int, whole boolean, hot boolean, context long"


def _batch(out: dict[str, list], id_type: pa.DataType) -> pa.RecordBatch:
    types = (id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(_FIELDS, types)], list(_FIELDS))


def _flag(hot: int) -> Column:
    many = F.when(F.col("n") > 1, WHOLE).otherwise(0)
    return many + F.when(F.col("kinds") > 1, MIXED).otherwise(0) + F.when(F.col("kinds") > hot, HOT).otherwise(0)


def covered_here(docs: DataFrame, known: DataFrame, length: int, size: int, hot: int) -> DataFrame:
    """Covered runs and contexts to compare, with all repeated contexts (a checked number) in every task."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = (batch.column(k).to_numpy(zero_copy_only=False).astype(t).tobytes() for k, t in enumerate((np.int64, np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], ["context", "flags"])

    rows = known.select("context", _flag(hot)).mapInArrow(packed, "context binary, flags binary").toLocalIterator()
    got = [(np.frombuffer(r[0], np.int64), np.frombuffer(r[1], np.uint8)) for r in rows]
    keys, flags = (np.concatenate([g[k] for g in got] or [np.zeros(0, t)]) for k, t in enumerate((np.int64, np.uint8)))
    order = np.argsort(keys)
    held = docs.sparkSession.sparkContext.broadcast((keys[order], flags[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, flags = held.value
        marks, seen = Marks(length, size), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = {n: [] for n in _FIELDS}
                part = batch.slice(at, 200)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = marks(data := _bytes(text))
                    if len(found[0]) and len(keys):
                        where = np.minimum(np.searchsorted(keys, found[1]), len(keys) - 1)
                        hit = keys[where] == found[1]
                        if hit.any():
                            _emit([x[hit] for x in found], flags[where[hit]], data, doc, seen, out)
                yield _batch(out, batch.column(0).type)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, _schema(dict(docs.dtypes)["doc_id"]))


def covered_by_join(docs: DataFrame, known: DataFrame, length: int, size: int, hot: int) -> DataFrame:
    """The same without a broadcast: contexts are joined, and go back to their documents as arrays."""
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.col("text").cast("string"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(length, size)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [marks(_bytes(t))[1] for t in part.column(1).to_pylist()]
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), list(map(len, found)))))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(found))], ["doc_id", "context"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen = Marks(length, size), set()
        for batch in batches:
            out = {n: [] for n in _FIELDS}
            for doc, text, have in zip(*(batch.column(k).to_pylist() for k in range(3))):
                table = {c["context"]: c["flag"] for c in have}
                found = marks(data := _bytes(text))
                hit = np.array([c in table for c in found[1].tolist()], bool)
                if hit.any():
                    got = np.array([table[c] for c in found[1][hit].tolist()])
                    _emit([x[hit] for x in found], got, data, doc, seen, out)
            yield _batch(out, batch.column(0).type)

    facts = known.select("context", _flag(hot).alias("flag"))
    met = texts.mapInArrow(places, f"doc_id {kind}, context long").join(facts, "context")
    of_doc = met.groupBy("doc_id").agg(F.collect_set(F.struct("context", "flag")).alias("have"))  # bounded by the document
    of_doc = of_doc.withColumnRenamed("doc_id", "of")
    return texts.join(of_doc, F.col("doc_id").eqNullSafe(F.col("of"))).select("doc_id", "text", "have").mapInArrow(back, _schema(kind))


def _keys(rows: pd.DataFrame, marks: Marks) -> tuple[np.ndarray, np.ndarray]:
    """(keys, whether there is one) by context and by the distance d of a string's start before the anchor."""
    length, spare = marks.length, marks.length - marks.size
    size = rows["bytes"].map(len).to_numpy()
    if len(marks.up) <= length + spare:
        marks.up, marks.down = powers(length + spare + 1)
    grid = np.zeros((len(rows), length + spare), np.uint64)
    for i, b in enumerate(rows["bytes"]):
        grid[i, : len(b)] = np.frombuffer(b, np.uint8)
    prefix = np.zeros((len(rows), length + spare + 1), np.uint64)
    np.cumsum((grid + np.uint64(1)) * marks.up[: length + spare], 1, out=prefix[:, 1:])
    at, h = rows["at"].to_numpy(), mixed(rows["h"].to_numpy().astype(np.int64).view(np.uint64))
    good = np.zeros((len(rows), spare + 1), bool)
    keys = np.zeros((len(rows), spare + 1), np.uint64)
    place = np.arange(spare + 1, dtype=np.uint64) * _PLACE
    for d in range(spare + 1):
        s = at - d
        i = np.flatnonzero((s >= 0) & (s + length <= size))
        good[i, d] = True
        keys[i, d] = mixed(mixed((prefix[i, s[i] + length] - prefix[i, s[i]]) * marks.down[s[i]]) ^ h[i] * np.uint64(5)) + place[d]
    return keys, good


def _repeated(rows: pd.DataFrame, marks: Marks) -> pd.DataFrame:
    """Runs covered by strings that two contexts of an anchor share. ``rows`` holds all contexts of its anchors."""
    rows = rows.drop_duplicates(["h", "context", "doc_id", "v", "start"])
    many = rows["whole"].to_numpy(bool)
    rows = pd.concat([rows[many].drop_duplicates(["h", "context"]), rows[~many]])
    keys, good = _keys(rows, marks)
    _, where, count = np.unique(keys[good], return_inverse=True, return_counts=True)
    twice = np.zeros_like(good)
    twice[good] = count[where] > 1
    out = []
    ids, v, first, whole = rows["doc_id"].to_numpy(), rows["v"].to_numpy(), (rows["start"] + rows["at"]).to_numpy(), rows["whole"].to_numpy(bool)
    for i in np.flatnonzero(twice.any(1) & ~whole):
        s = np.sort(first[i] - np.flatnonzero(twice[i]))
        cut = np.flatnonzero(np.diff(s) > marks.length) + 1
        out += [(ids[i], v[i], int(r[0]), int(r[-1]) + marks.length) for r in np.split(s, cut)]
    return pd.DataFrame(out, columns=["doc_id", "v", "start", "end"])


def compared(rows: DataFrame, length: int, size: int) -> DataFrame:
    """(doc_id, v, start, end) from contexts of anchors that have several."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks, rest = Marks(length, size), None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf])
            if len(pdf) < 4_000:
                rest = pdf
                continue
            last = pdf["h"] == pdf["h"].iloc[-1]  # may go on
            rest = pdf[last]
            if not last.all():
                yield _repeated(pdf[~last], marks)
        if rest is not None and len(rest):
            yield _repeated(rest, marks)

    dealt = rows.where("h is not null and not hot").repartition("h").sortWithinPartitions("h")
    return dealt.mapInPandas(run, f"doc_id {kind}, v long, start long, end long")


def compared_as_rows(rows: DataFrame, length: int, size: int) -> DataFrame:
    """The same for anchors with very many contexts: every string is a row, counted before and after the shuffle."""
    kind = dict(rows.dtypes)["doc_id"]

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = Marks(length, size)
        for batch in batches:
            for k in range(0, len(batch), 2_000):
                pdf = batch.iloc[k : k + 2_000]
                keys, good = _keys(pdf, marks)
                i, d = np.nonzero(good)
                start = (pdf["start"] + pdf["at"]).to_numpy()[i] - d
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[i], "v": pdf["v"].to_numpy()[i], "start": start, "whole": pdf["whole"].to_numpy(bool)[i], "key": keys[i, d].view(np.int64)})

    each = written(rows.where("hot").mapInPandas(strings, f"doc_id {kind}, v long, start long, whole boolean, key long"), "repeats-strings")
    twice = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return each.where("not whole").join(twice, "key", "left_semi").select("doc_id", "v", "start", (F.col("start") + length).alias("end"))


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left, bytes removed, maximal removed runs."""
    left, at, removed, runs = [], 0, 0, 0
    for s, e in sorted(spans):
        if s > at or not runs:
            runs += 1
            left.append(data[at:s])
            removed += e - s
        elif e > at:
            removed += e - at
        at = max(at, e)
    return b"".join([*left, data[at:]]), removed, runs


def remove_repeats(docs: DataFrame, length: int = LENGTH, size: int = SIZE, limit: int = BROADCAST_CONTEXTS, hot: int = HOT_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for every row.

    Null and empty texts, and texts below ``length`` bytes, lose nothing. Equal rows are repeats of each other. A null
    doc_id is kept as such. Other columns are not read.
    """
    known = written(contexts(docs, length, size), "repeats-contexts")
    covered = covered_here if known.limit(limit + 1).count() <= limit else covered_by_join
    found = covered(docs, known, length, size, hot)
    found = written(found, "repeats-found")
    spans = found.where("h is null").select("doc_id", "v", "start", "end").unionByName(compared(found, length, size))
    if not found.where("hot").isEmpty():
        spans = spans.unionByName(compared_as_rows(found, length, size))
    of_doc = spans.groupBy(F.col("doc_id").alias("of")).agg(F.collect_set(F.struct("v", "start", "end")).alias("spans"))  # bounded by the document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rows = []
                for text, have in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    data = _bytes(text)
                    v = version(data) if have else 0
                    kept, removed, runs = cut(data, [(s["start"], s["end"]) for s in have or () if s["v"] == v])
                    rows.append((len(data), removed, runs, kept))
                columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    texts = docs.select("doc_id", F.col("text").cast("string"))
    whole = texts.join(of_doc, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "spans")
    return whole.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
