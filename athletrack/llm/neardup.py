"""Near duplicates by MinHash: banded signatures, links verified on full sets, connected components.

Equal sets are one class, so copies cost one row each. Buckets of equal bands are linked in two rounds. First every
class is compared with one hub of its bucket, the class that meets the most others. Then buckets that still hold
several components are compared block by block inside tasks, across components only and each pair in its first
common band; a block returns a spanning forest of the links that it found. No pairs of a group are ever listed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athletrack.llm.base import sliced, written
from athletrack.llm.components import components

ROWS = 5
MISS = 1e-6  # a pair at the threshold shares no band with a probability below this
BLOCK = 1_024  # classes of a bucket that are compared with as many others in one group
BROADCAST_IDS = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shape:
    """Words of a shingle, threshold in percent, bands of ``ROWS`` minima."""

    def __init__(self, words: int = 5, percent: int = 80, seed: int = 11):
        self.words, self.percent = words, percent
        self.bands = math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))
        self.size = self.bands * ROWS
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 32, self.size, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, self.size, dtype=np.uint32)
        #: minima that pairs at the threshold have in common, five standard deviations below the mean
        p = percent / 100
        self.agree = int(self.size * p - 5 * math.sqrt(self.size * p * (1 - p)))

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles; texts of fewer words are one shingle, none if no word."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        n = min(self.words, len(words))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for j in range(n):
            out = (out ^ h[j : len(h) - n + 1 + j]) * _MIX
            out ^= out >> np.uint64(29)
        return np.unique(out)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = ((shingles * _MIX) >> np.uint64(32)).astype(np.uint32)
        out = np.full(self.size, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 1_024):
            part = x[at : at + 1_024, None] * self.a
            part += self.b
            np.minimum(out, part.min(0), out=out)
        return out

    def similar(self, x: np.ndarray, y: np.ndarray) -> bool:
        if 100 * min(len(x), len(y)) < self.percent * max(len(x), len(y)):
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both > 0 and 100 * both >= self.percent * (len(x) + len(y) - both)


def signatures(docs: DataFrame, shape: Shape) -> DataFrame:
    """(doc_id, n_shingles, key, minima, bands): key is a digest of the set, null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(shape.bands, dtype=np.uint64) * _MIX
        for batch in sliced(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                if not len(s := shape.shingles(text)):
                    rows.append((0, None, None, None))
                    continue
                m = shape.minima(s)
                bands = numbers.copy()
                for j in range(ROWS):
                    bands = (bands ^ m[j::ROWS]) * _MIX
                    bands ^= bands >> np.uint64(31)
                rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), m.tobytes(), bands.view(np.int64)))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", "n_shingles", "key", "minima", "bands"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, key binary, minima binary, bands array<long>")


def _verified(pairs: DataFrame, shape: Shape) -> DataFrame:
    """(u, v) of the rows (u, v, u_text, v_text) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in sliced(batches):
            keep = []
            for u, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if u != last:  # rows of a hub come one after another
                    last, held = u, shape.shingles(u)
                keep.append(shape.similar(held, shape.shingles(text)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    kind = dict(pairs.dtypes)
    return pairs.select("u", "v", "u_text", "v_text").mapInArrow(run, f"u {kind['u']}, v {kind['v']}")


def _across(rows: pd.DataFrame, shape: Shape) -> pd.DataFrame:
    """Links (u, v) of a block of a bucket, or between two blocks: enough to connect what is similar."""
    rows = rows.sort_values(["side", "rep"], kind="stable")
    ids, band, block = rows["rep"].to_numpy(), int(rows["band"].iloc[0]), rows["side"].to_numpy()
    group = {c: k for k, c in enumerate(rows["component"].unique())}
    root = list(range(len(group)))
    part = rows["component"].map(group).to_numpy()

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    m = np.stack([np.frombuffer(x, np.uint32) for x in rows["minima"]])
    texts, sets = rows["text"].to_numpy(), {}

    def held(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shape.shingles(texts[i])
        return sets[i]

    out = []
    two = block[0] != block[-1]
    for i in range(len(ids)):
        others = np.arange(i + 1, len(ids))
        if two:  # pairs inside a block are met where the block is alone
            others = others[block[others] != block[i]]
        others = others[part[others] != part[i]]
        if not len(others):
            continue
        same = m[others] == m[i]
        good = same.sum(1) >= shape.agree
        good[good] = same[good].reshape(-1, shape.bands, ROWS).all(2).argmax(1) == band  # the first common band only
        for j in others[good]:
            if find(part[i]) != find(part[j]) and shape.similar(held(i), held(j)):
                root[find(part[i])] = find(part[j])
                out.append((ids[i], ids[j]))
    return pd.DataFrame(out, columns=["u", "v"]).astype({"u": rows["rep"].dtype, "v": rows["rep"].dtype})


def _linked_buckets(multi: DataFrame, texts: DataFrame, reps: DataFrame, known: DataFrame, shape: Shape) -> DataFrame:
    """Second round: links across components inside buckets, where the hub left several."""
    part = known.select(F.col("node").alias("rep"), "component")
    rows = multi.where("rep <> hub").select("h", "band", "rep").join(part, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    rows = written(rows, "near-rest")
    open_buckets = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("h", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(open_buckets, "h").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("h", "band", "rep", "component", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    rows = rows.join(reps.select("rep", "minima"), "rep").join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep")
    kind = dict(multi.dtypes)["rep"]
    return rows.groupBy("h", "lo", "hi").applyInPandas(lambda pdf: _across(pdf, shape), f"u {kind}, v {kind}")


def _same_ids(usable: DataFrame, reps: DataFrame) -> DataFrame | None:
    """(u, v) between a doc_id of several texts and the classes of all of them; None if each has one text."""
    several = written(usable.groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("doc_id"), "near-repeated")
    n = several.count()
    if not n:
        return None
    rows = usable.select("doc_id", "key").join(F.broadcast(several) if n <= BROADCAST_IDS else several, "doc_id").distinct()
    return rows.join(reps.select("key", "rep"), "key").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))


def near_duplicates(docs: DataFrame, shape: Shape | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Empty and null texts have no shingles and no links: a component of their own, kept. Rows that repeat a doc_id are
    taken as one document's, which is linked by each of its texts and has one component; each gives a row. A null doc_id links nothing, has a null component and is kept.
    Other columns are not read.
    """
    shape = shape or Shape()
    signed = written(signatures(docs, shape), "near-signatures")
    usable = signed.where("key is not null and doc_id is not null")
    reps = written(usable.groupBy("key").agg(F.min(F.struct("doc_id", "minima", "bands")).alias("r")).select("key", F.col("r.doc_id").alias("rep"), "r.minima", "r.bands"), "near-classes")

    banded = reps.select("rep", F.posexplode("bands").alias("band", "h"))
    several = banded.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # counted and joined, so that a large bucket is no single task
    multi = written(banded.join(several, "h"), "near-buckets")
    met = multi.groupBy("rep").agg(F.sum("n").alias("met"))
    hubs = multi.join(met, "rep").groupBy("h").agg(F.max_by("rep", F.struct("met", -F.col("rep"))).alias("hub"))
    multi = written(multi.join(hubs, "h"), "near-hubs")

    wanted = multi.select(F.col("rep").alias("doc_id")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", F.col("text").cast("string")).join(wanted, "doc_id", "left_semi")
    texts = written(texts.distinct(), "near-texts")  # each text of a doc_id

    pairs = multi.where("rep <> hub").select(F.col("hub").alias("u"), F.col("rep").alias("v")).distinct()
    pairs = pairs.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("v_text")), "v").join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("u_text")), "u")
    first = _verified(pairs, shape)
    same = _same_ids(usable, reps)
    first = written(first if same is None else first.unionByName(same), "near-links")
    known = written(components(first), "near-components")
    more = written(_linked_buckets(multi, texts, reps, known, shape), "near-links")
    known = components(first.unionByName(more)) if not more.isEmpty() else known

    of_class = reps.select("key", "rep").join(known.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(of_class, "key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
