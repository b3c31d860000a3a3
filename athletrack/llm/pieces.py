"""SentencePiece encoding and decoding through one table of the corpus's distinct marked words.

Pieces of the model never reach from one whitespace-marked word into the next. So texts are split into words, chunk
by chunk: a chunk keeps its distinct words, dealt to buckets by their hash, and for every text the numbers of its
words. The words of all chunks meet by bucket, where each distinct one is segmented once; the ids go back to the
chunks that asked and are joined to the texts by position. What is shuffled is a chunk's distinct words and the
numbers, never a row for each token, and no word is hot: a chunk asks for it once.

Chunks are made twice, once for their words and once for their numbers, as that takes less than keeping them on disk.
A chunk is known by a digest of its words, so a chunk that came out otherwise is noticed instead of mixed up.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athletrack.llm.base import sliced

MARK = "▁"
CHUNK = 32_000_000  # characters of a chunk, about; a longer text is one by itself
BUCKET = 8_000_000  # characters of the corpus for each bucket
MOST_BUCKETS = 1 << 16
_WORD = re.compile(f"{MARK}+[^{MARK}]*")


def words(text: str | None) -> list[str]:
    """The marked words of a text, each without its first marker (the library puts one before a text by itself)."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return [w[1:] for w in _WORD.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


class Segmenter:
    """The library, for single words and for decoding."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = map(self.sp.id_to_piece, range(self.sp.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("the model has pieces that cross whitespace markers")
        self.mark_id = self.sp.piece_to_id(MARK)

    def segment(self, found: list[str]) -> list[list[int]]:
        ids = self.sp.encode([w.replace(MARK, " ") for w in found], num_threads=1)
        return [x if w else [self.mark_id] for w, x in zip(found, ids)]

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids) if ids else ""


@lru_cache(maxsize=2)
def segmenter(model_path: str) -> Segmenter:
    return Segmenter(model_path)


def _pack(found: list[str]) -> bytes:
    return zstandard.compress(" ".join(found).encode(), 1)  # no word holds a space


def _unpack(data: bytes) -> list[str]:
    return zstandard.decompress(data).decode().split(" ")


def _planes(numbers: np.ndarray) -> bytes:
    """Four-byte numbers, compressed byte by byte: their upper bytes are mostly alike."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def chunks(docs: DataFrame, n_buckets: int, size: int = CHUNK) -> DataFrame:
    """(chunk, docs, sizes, numbers, words): ids of a chunk's documents, how many words each has, the numbers of all
    these words, and the distinct words packed by bucket; numbers count through the buckets. ``chunk`` is a digest of
    the words: chunks of the same words in the same order have the same."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, held = [], [], 0
        number: dict[str, int] = defaultdict(itertools.count().__next__)

        def made(id_type: pa.DataType) -> pa.RecordBatch:
            distinct = list(number)
            bucket = np.fromiter((zlib.crc32(w.encode()) % n_buckets for w in distinct), np.int64, len(distinct))
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            packed = [_pack([distinct[i] for i in order[lo:hi]]) if lo < hi else None for lo, hi in zip(ends, ends[1:])]
            row = ([hashlib.blake2b(b"".join(x or b"-" for x in packed), digest_size=16).hexdigest()], [ids], [list(map(len, found))], [_planes(place[np.concatenate(found)])], [packed])
            types = (pa.string(), pa.list_(id_type), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], ["chunk", "docs", "sizes", "numbers", "words"])

        for batch in sliced(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and held + len(text or "") > size:
                    yield made(batch.column(0).type)
                    ids, found, held = [], [], 0
                    number = defaultdict(itertools.count().__next__)
                w = words(text)
                ids.append(doc)
                found.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
                held += len(text or "")
            id_type = batch.column(0).type
        if ids:
            yield made(id_type)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"chunk string, docs array<{kind}>, sizes array<int>, numbers binary, words array<binary>")


def segments(asked: DataFrame, model_path: str) -> DataFrame:
    """(chunk, bucket, sizes, ids, n_new) of the rows (chunk, bucket, packed): the ids of the words, in their order.

    ``n_new`` words of the row were segmented for it; the others were known from rows before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, known, last = segmenter(model_path), {}, None
        for batch in sliced(batches, 50):
            rows = []
            for bucket, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if bucket != last:  # rows of a bucket come one after another
                    known, last = {}, bucket
                found = _unpack(packed)
                new = [w for w in found if w not in known]
                known.update(zip(new, library.segment(new)))
                ids = [known[w] for w in found]
                sizes = np.fromiter(map(len, ids), np.int32, len(ids))
                rows.append((_planes(sizes), _planes(np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(sizes.sum()))), len(new)))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["chunk", "bucket", "sizes", "ids", "n_new"])

    dealt = asked.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "chunk string, bucket int, sizes binary, ids binary, n_new long")


def _joined(batches: Iterator[pa.RecordBatch], model_path: str, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Texts' ids from (docs, sizes, numbers, parts) of chunks."""
    library = segmenter(model_path)
    for batch in sliced(batches, 1):
        parts = sorted(batch.column(3).to_pylist()[0] or (), key=lambda p: p["bucket"])
        none = np.zeros(0, np.int32)
        sizes, ids = (np.concatenate([none, *(_numbers(p[k]) for p in parts)]) for k in ("sizes", "ids"))
        start = np.cumsum(sizes, dtype=np.int64) - sizes
        if batch.column(3)[0].as_py() is None and any(batch.column(1)[0].as_py()):
            raise RuntimeError("the documents came in another order the second time; write them to a table first")
        numbers, ends = _numbers(batch.column(2)[0].as_py()), np.cumsum([0, *batch.column(1)[0].as_py()])
        docs = batch.column(0)[0].values
        for at in range(0, len(docs), 200):
            to = min(at + 200, len(docs))
            n = numbers[ends[at] : ends[to]]
            long = sizes[n].astype(np.int64)
            stop = np.cumsum(long)
            got = ids[np.repeat(start[n] - stop + long, long) + np.arange(long.sum())]
            offsets = np.append(0, stop)[ends[at : to + 1] - ends[at]].astype(np.int32)
            columns = [docs.slice(at, to - at), pa.ListArray.from_arrays(pa.array(offsets), pa.array(got, pa.int32()))]
            if with_text:
                columns.append(pa.array([library.decode(got[lo:hi].tolist()) for lo, hi in zip(offsets, offsets[1:])], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])


def n_buckets(docs: DataFrame, size: int = BUCKET) -> int:
    chars = docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    return min(1 + chars // size, MOST_BUCKETS)


def encode(docs: DataFrame, model_path: str, with_text: bool = False, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, ids array<int>[, decoded]) for every row, as the library encodes its whole text.

    Null and empty texts have no ids and decode to an empty text. Repeated rows each give a row, a null doc_id stays
    null, other columns are not read. ``decoded`` is the library's decode of all ids. ``docs`` should be a stored
    table: it is read twice and must come in the same order, else the job stops with an error.
    """
    kind = dict(docs.dtypes)["doc_id"]
    cut = chunks(docs, n_buckets(docs, bucket), chunk)
    asked = cut.select("chunk", F.posexplode("words").alias("bucket", "packed")).where("packed is not null")
    parts = segments(asked, model_path).groupBy("chunk").agg(F.collect_set(F.struct("bucket", "sizes", "ids")).alias("parts"))  # a chunk's buckets
    schema = f"doc_id {kind}, ids array<int>" + ", decoded string" * with_text
    met = cut.select("chunk", "docs", "sizes", "numbers").join(parts, "chunk", "left").select("docs", "sizes", "numbers", "parts")
    return met.mapInArrow(lambda it: _joined(it, model_path, with_text), schema)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
