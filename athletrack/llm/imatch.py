"""Document fingerprints by I-Match with randomised lexicons.

The lexicon holds the terms within a band of inverse document frequency, counted over all documents. A fingerprint
hashes a document's sorted distinct terms of the lexicon, and those of randomised subsets of it: level k of the subsets
keeps a term with probability 2^-k, in up to 32 disjoint subsets. Equal hashes in the large subsets tell that two texts
are all but equal, those in the small ones that they share a part.

The lexicon is a bitmap over 2^22 hashed cells: half a megabyte at any size of the corpus, so it is broadcast. A term
stands in the lexicon if its cell's frequency is in the band. Tasks count in one dense array and send it compressed,
and only the bitmap reaches the driver.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athletrack.llm.base import hash_sample, sliced

CELLS = 1 << 22
BLOCK = 1 << 12  # cells that are added up together
IDF = (2.3, 9.2)  # natural logarithms: in at most one of 10 and at least one of 10,000 documents
LEVELS = 16  # the smallest subsets keep one term of 65,536
SUBSETS = 32  # of a level at most
SPARSE = 20  # subsets of a level that two texts may fill, so that most hold a single term
NONE = ""  # no term of the document is in the subset
PER_PART = 40  # rows of a sample for each partition, to cut the range of ids
_TERM = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.cumsum([0, *(min(1 << level, SUBSETS) for level in range(LEVELS + 1))])
_LEVEL = np.arange(LEVELS + 1, dtype=np.uint64)[:, None]
_LEVEL_MARK, _LEVEL_SHIFT = _LEVEL * _MIX, np.minimum(np.uint64(64) - _LEVEL, np.uint64(63))


def terms(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the terms: lower-cased runs of letters and digits."""
    found = set(_TERM.findall(text.lower()))
    digests = b"".join([xxhash.xxh3_64_digest(t.encode("utf-8", "surrogatepass")) for t in found])
    return np.sort(np.frombuffer(digests, ">u8").astype(np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CELLS - 1)).astype(np.int64)


def lexicon(docs: DataFrame, idf: tuple[float, float] = IDF) -> np.ndarray:
    """The bitmap of the cells whose document frequency over all of ``docs`` is within the band."""
    n = docs.count()
    low, high = n * math.exp(-idf[1]), n * math.exp(-idf[0])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.uint32)
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                counts[np.unique(_cells(terms(text or "")))] += 1
        rows = counts.reshape(-1, BLOCK)
        some = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([zlib.compress(rows[k].tobytes(), 1) for k in some], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, out = None, None, []
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block != held:
                    if held is not None:
                        out.append((held, total))
                    held, total = block, np.zeros(BLOCK, np.uint64)
                total += np.frombuffer(zlib.decompress(packed), np.uint32)
        if held is not None:
            out.append((held, total))
        flags = [np.packbits((total >= max(low, 1)) & (total <= high), bitorder="little").tobytes() for _, total in out]
        yield pa.RecordBatch.from_arrays([pa.array([block for block, _ in out], pa.int32()), pa.array(flags, pa.binary())], ["block", "flags"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "block int, counts binary")
    whole = counted.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(add, "block int, flags binary")
    bitmap = np.zeros(CELLS // 8, np.uint8)
    for row in whole.collect():  # CELLS bits
        bitmap[row["block"] * BLOCK // 8 : (row["block"] + 1) * BLOCK // 8] = np.frombuffer(row["flags"], np.uint8)
    return bitmap


def fingerprint(text: str, bitmap: np.ndarray) -> str:
    """A hash for each subset of the lexicon, or a mark where it has no term of the text.

    A text that has terms, but none of the lexicon, counts with all of them; one without terms has one hash, of itself.
    """
    found = terms(text)
    if not len(found):
        return "=" + xxhash.xxh3_64_hexdigest(text.encode("utf-8", "surrogatepass"))
    cells = _cells(found)
    within = (bitmap[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1
    found = found[within] if within.any() else found
    place = _mixed(found ^ _LEVEL_MARK) >> _LEVEL_SHIFT
    place[0] = 0  # the whole lexicon
    at, term = np.nonzero(place < SUBSETS)
    slot = _FIRST[at] + place[at, term].astype(np.int64)
    sums = np.zeros(_FIRST[-1], np.uint64)
    np.add.at(sums, slot, _mixed(found)[term])  # of the distinct terms, in whatever order
    filled = np.bincount(slot, minlength=_FIRST[-1]) > 0
    hashes = _mixed(sums) >> np.uint64(48)
    return ",".join([f"{h:04x}" if some else NONE for h, some in zip(hashes.tolist(), filled.tolist())])


def likeness(one: str, other: str) -> float:
    """The share of terms that two texts have in common, as the sparse subsets tell it; 1 for equal fingerprints.

    These are the levels of which the two fill few subsets: such a subset mostly holds one term, which is shared or
    not. The fuller ones are equal for copies only.
    """
    if one == other:
        return 1.0
    if "=" in (one[:1], other[:1]):
        return 0.0
    a, b = one.split(","), other.split(",")
    equal = total = 0
    for lo, hi in zip(_FIRST[:-1], _FIRST[1:]):
        pairs = [(x, y) for x, y in zip(a[lo:hi], b[lo:hi]) if x != NONE or y != NONE]
        if hi - lo == SUBSETS and (len(pairs) <= SPARSE or hi == _FIRST[-1]):
            equal, total = equal + sum(x == y for x, y in pairs), total + len(pairs)
    return equal / total if total else 0.0


def fingerprints(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(doc_id, fingerprint) for every row, each by its own text: nulls as empty, equal texts alike, null ids too."""
    spread = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t or "", spread.value) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _dealt(docs: DataFrame) -> DataFrame:
    """(doc_id, text, bucket, lead, tie): documents in ranges of doc_id, the first of each range also at the end of the range before.

    Ranges are cut by a sample of bounded size; rows are in order of doc_id (null first) and then of the hash of their
    text, so that rows of one doc_id are cut, too. One exchange of the texts.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("tie"))
    sample = sorted((r["key"], r["tie"]) for r in hash_sample(keyed.select("key", "tie"), F.xxhash64("key", "tie"), PER_PART * parts).collect())
    cuts = sorted(set(sample[k * len(sample) // parts] for k in range(1, parts))) if sample else []

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, pa.RecordBatch]]:
        for batch in batches:
            keys = list(zip(batch.column("key").to_pylist(), batch.column("tie").to_pylist()))
            at = [bisect.bisect_right(cuts, k) for k in keys]
            yield keys, at, batch

    def where(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple[int, int]] = {}
        for keys, at, _ in places(batches):
            for b, k in zip(at, keys):
                if b not in least or k < least[b]:
                    least[b] = k
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array([k[0] for k in least.values()], pa.int64()), pa.array([k[1] for k in least.values()], pa.int64())], ["bucket", "key", "tie"])

    firsts = keyed.select("key", "tie").mapInArrow(where, "bucket int, key long, tie long").groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("first"))
    heads = {r["bucket"]: (r["first"]["key"], r["first"]["tie"]) for r in firsts.collect()}  # one for each partition
    used = sorted(heads)
    before = {b: used[i - 1] for i, b in enumerate(used)}  # the last range is before the first

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, at, batch in places(batches):
            take = list(range(len(keys)))
            lead = [i for i in take if keys[i] == heads.get(at[i])]
            rows = pa.Table.from_batches([batch.select(["doc_id", "text", "key", "tie"])]).take(pa.array(take + lead, pa.int64()))
            to = pa.array(at + [before[at[i]] for i in lead], pa.int64())
            flags = pa.array([False] * len(take) + [True] * len(lead), pa.bool_())
            yield from rows.append_column("bucket", to).append_column("lead", flags).combine_chunks().to_batches()

    kind = dict(docs.dtypes)["doc_id"]
    dealt = keyed.select("doc_id", "text", "key", "tie").mapInArrow(deal, f"doc_id {kind}, text string, key long, tie long, bucket long, lead boolean")
    return dealt.repartitionById(parts, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "lead", "key", "tie")


def compare_edited(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    A document's edited text has its last half replaced by the beginning of the next one's. The next document is the
    one after it by doc_id, of the last one the first; rows without a doc_id come before all others, and rows of one
    doc_id, in order of the hash of their text, are next to each other. Nulls are empty texts. A table of one row is its
    own next. Texts go through a task one after the other, two at a time.
    """
    spread = docs.sparkSession.sparkContext.broadcast(bitmap)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, doc_id, text, fingerprint of the row before
        for batch in sliced(batches):
            out = []
            for doc_id, text, bucket, lead in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "lead"))):
                text = text or ""
                if lead and held is None:
                    continue
                mark = fingerprint(text, spread.value)
                if held is not None and held[0] == bucket:
                    _, of, own, first = held
                    changed = edited(own, text)
                    second = fingerprint(changed, spread.value)
                    out.append((of, len(own), sha256(changed.encode()).hexdigest(), first, second, likeness(first, second), likeness(first, mark)))
                held = None if lead else (bucket, doc_id, text, mark)
            if out:
                kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _dealt(docs).select("doc_id", "text", "bucket", "lead").mapInArrow(run, schema)
