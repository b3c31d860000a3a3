"""A Merkle manifest of a table, and proofs of its rows by an octopus multiproof.

Rows are leaves of a tree for each language, and the roots of those trees are leaves of one tree more. The manifest is
a table of all nodes (tree, level, idx, hash), built bottom-up: a task takes blocks of 1,024 consecutive nodes and
returns the ten levels above them, so the number of rounds is the logarithm of the table to the base of 1,024.

Proofs: leaves are dealt by block. Each block computes the least set of node coordinates that its leaves' proofs need
and its own leaves do not give; these are fetched from the manifest in one join, the interiors that several proofs
share are derived once from the block's leaves, and each proof is expanded where it is. Fetched coordinates are a few
dozen for a whole block, so the manifest's nodes hardly move.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from athletrack.llm.base import sliced, written
from athletrack.llm.phrases import small

LEVELS = 10  # that a block rises in one task
BLOCK = 1 << LEVELS
TOP = -1  # the tree over the languages' roots
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree long, level int, idx long, n long, hash string"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """The digest of a row's values: - for null, otherwise the number of UTF-8 bytes, a colon and the value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, leaf, claimed): the leaf of every row, and the leaf that the row would have after tampering, where there is any.

    Tampering adds 1 to n_chars where 7 divides the hash of doc_id; a null doc_id is left alone, and a null n_chars stays null.
    """
    parts = [F.col(c) for c in FIELDS]
    tampered = [F.try_add(c, F.lit(1)) if c == "n_chars" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return docs.select(F.col("lang").cast("string").alias("lang"), "doc_id", leaf(*parts).alias("leaf"), F.when(hit, leaf(*tampered)).alias("claimed"))


def ranked(df: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``idx``, the place of each row among those of its ``by`` in ``order`` (nulls first), and ``n``, how many there are.

    One exchange by range, so that a large group is in many tasks; ``order`` must tell all rows apart that matter. Only
    counts by partition and group are summed up over partitions.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [by, *order]
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), name)
    counts = dealt.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_of")).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_count"))
    group = Window.partitionBy("_by")  # a row for each partition at most
    before = F.sum("_count").over(group.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1))
    counts = written(counts.select("_by", "_of", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_count").over(group).alias("n")), f"{name}-counts")
    out = dealt.join(small(counts), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_of")))
    return out.select(*df.columns, (F.col("_row") - F.col("_first") + F.col("_before")).alias("idx"), "n")


def _levels(hashes: list[str], n: int) -> Iterator[list[str]]:
    """The levels above a block of a level of ``n`` nodes: nothing above a root."""
    for _ in range(LEVELS):
        if n <= 1:
            return
        hashes = [digest(*hashes[k : k + 2]) for k in range(0, len(hashes), 2)]
        n = (n + 1) // 2
        yield hashes


def _above(nodes: DataFrame) -> DataFrame:
    """The nodes of the ten levels above ``nodes``, which are whole levels of their trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        hashes: list[str] = []
        out: list[tuple] = []

        def close() -> None:
            tree, level, block, n = held
            at = block * BLOCK
            for up, row in enumerate(_levels(hashes, n), 1):
                out.extend((tree, level + up, (at >> up) + k, -(-n >> up), h) for k, h in enumerate(row))

        for batch in batches:
            for tree, level, idx, n, h in zip(*(c.to_pylist() for c in batch.columns)):
                if held != (key := (tree, level, idx // BLOCK, n)):
                    if held is not None:
                        close()
                    held, hashes = key, []
                hashes.append(h)
            if out:
                yield _nodes(out)
                out = []
        if held is not None:
            close()
        if out:
            yield _nodes(out)

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.select("tree", "level", "idx", "n", "hash").repartition(parts, "tree", F.shiftright("idx", LEVELS)).sortWithinPartitions("tree", "idx")
    return dealt.mapInArrow(run, NODE)


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["tree", "level", "idx", "n", "hash"])


def grown(bottom: DataFrame) -> DataFrame:
    """All levels above (tree, idx, n, hash): written nodes with their level and how many of it the tree has."""
    at = bottom.select("tree", F.lit(0).alias("level"), "idx", "n", "hash")
    out, level = [at], 0
    while (at.agg(F.max("n")).first()[0] or 0) > 1:
        made = written(_above(at), "merkle-nodes")
        out.append(made)
        level += LEVELS
        at = made.where(F.col("level") == level)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def manifest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed leaves, nodes) of ``leaves``.

    Placed: lang, doc_id, leaf, claimed, tree, idx, n (leaves of the tree), top_n (trees). Trees are numbered by
    language, null first, then by bytes; a tree's number is its place in the tree above. Rows with equal doc_id are in
    order of their leaf, and rows without one come first; equal rows are leaves of their own. An empty table has no nodes.
    """
    numbered = written(rows.withColumn("_same", F.monotonically_increasing_id()), "merkle-leaves")  # equal rows get an order
    placed = ranked(numbered, "lang", ["doc_id", "leaf", "_same"], "merkle-order").drop("_same")
    langs = ranked(placed.where("idx = 0").select(F.lit(0).alias("one"), "lang"), "one", ["lang"], "merkle-langs")
    langs = written(langs.select(F.col("lang").alias("_lang"), F.col("idx").alias("tree"), F.col("n").alias("top_n")), "merkle-trees")
    placed = placed.join(small(langs), F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
    trees = grown(placed.select("tree", "idx", "n", F.col("leaf").alias("hash")))
    roots = trees.where("n = 1").join(small(langs), "tree").select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("top_n").alias("n"), "hash")
    return placed, trees.unionByName(grown(written(roots, "merkle-roots")))


def missing(known: set[int], n: int) -> Iterator[tuple[int, int]]:
    """(level, idx) of the nodes that proofs of the leaves ``known`` need and that cannot be derived from them."""
    level = 0
    while n > 1:
        yield from ((level, k ^ 1) for k in sorted(known) if k ^ 1 not in known and k ^ 1 < n)
        known = {k >> 1 for k in known}
        level, n = level + 1, (n + 1) // 2


def _needed(placed: DataFrame) -> DataFrame:
    """(of_tree, of_block, tree, level, idx): the coordinates that each block of leaves has to fetch; the root is one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, out = None, set(), []

        def close() -> None:
            tree, block, n, top_n = held
            out.extend((tree, block, tree, level, idx) for level, idx in missing(known, n))
            out.extend((tree, block, TOP, level, idx) for level, idx in missing({tree}, top_n))
            out.append((tree, block, TOP, (top_n - 1).bit_length(), 0))

        def made() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["of_tree", "of_block", "tree", "level", "idx"])

        for batch in batches:
            for tree, idx, n, top_n in zip(*(c.to_pylist() for c in batch.columns)):
                if held != (key := (tree, idx // BLOCK, n, top_n)):
                    if held is not None:
                        close()
                    held, known = key, set()
                known.add(idx)
            if out:
                yield made()
                out.clear()
        if held is not None:
            close()
            yield made()

    return _by_block(placed.select("tree", "idx", "n", "top_n"), "tree", F.shiftright("idx", LEVELS), "idx").mapInArrow(run, "of_tree long, of_block long, tree long, level int, idx long")


def _by_block(df: DataFrame, tree: str, block: Column, *order: str) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, F.col(tree), block).sortWithinPartitions(tree, block, *order)


class _Block:
    """Leaves of a block and what was fetched for them."""

    def __init__(self, tree: int, n: int, top_n: int, fetched: dict[tuple[int, int, int], str], leaves: dict[int, str]):
        self.tree, self.n, self.top_n, self.nodes = tree, n, top_n, dict(fetched)
        self.root = fetched[TOP, (top_n - 1).bit_length(), 0]
        level, here = 0, dict(leaves)
        while True:
            self.nodes |= {(tree, level, k): h for k, h in here.items()}
            if n <= 1:
                break
            # interiors that several proofs share are derived once
            here = {k: digest(*(self.nodes[tree, level, c] for c in (2 * k, 2 * k + 1) if c < n)) for k in sorted({k >> 1 for k in here})}
            level, n = level + 1, (n + 1) // 2
        self.subroot = self.nodes[tree, level, 0]
        self.shared = self.fold(self.subroot, TOP, tree, top_n, [])  # where all untampered proofs end

    def fold(self, h: str, tree: int, idx: int, n: int, siblings: list[str]) -> str:
        """The root above a node, from the digest ``h`` claimed for it and the manifest's siblings."""
        level = 0
        while n > 1:
            if idx ^ 1 < n:
                other = self.nodes[tree, level, idx ^ 1]
                siblings.append(other)
                h = digest(h, other) if idx & 1 == 0 else digest(other, h)
            else:
                h = digest(h)
            idx, level, n = idx >> 1, level + 1, (n + 1) // 2
        return h

    def siblings(self, idx: int) -> list[str]:
        out, tree, n, level = [], self.tree, self.n, 0
        while True:
            while n > 1:
                if idx ^ 1 < n:
                    out.append(self.nodes[tree, level, idx ^ 1])
                idx, level, n = idx >> 1, level + 1, (n + 1) // 2
            if tree == TOP:
                return out
            tree, idx, n, level = TOP, tree, self.top_n, 0

    def prove(self, idx: int, leaf: str, claimed: str | None) -> tuple[str, str, str, str, str]:
        """(leaf, subroot, root, digest of the siblings, root that the claimed leaf leads to)."""
        folded = self.shared
        if claimed is not None and claimed != leaf:
            folded = self.fold(self.fold(claimed, self.tree, idx, self.n, []), TOP, self.tree, self.top_n, [])
        return leaf, self.subroot, self.root, digest(*self.siblings(idx)), folded


def proofs(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``wanted``, any of a manifest's placed leaves.

    ``proof_sha256`` digests the siblings from the leaf to the root. ``folded_root`` comes from the claimed leaf
    (the row's own where it is null) and the manifest's siblings, and is verified where it equals the root.
    """
    needed = written(_needed(wanted), "merkle-needed")
    least = needed.where(F.col("tree") != TOP).agg(F.min("level")).first()[0]  # whole blocks need nothing below their own root
    have = nodes.select("tree", "level", "idx", "hash").where((F.col("tree") == TOP) | (F.col("level") >= F.lit(least)))
    fetched = small(needed).join(have, ["tree", "level", "idx"])
    kind = dict(wanted.dtypes)["doc_id"]
    none = F.lit(None)
    rows = wanted.select(F.col("tree").alias("of_tree"), F.shiftright("idx", LEVELS).alias("of_block"), F.lit(1).alias("kind"), "idx", "n", "top_n", "doc_id", F.col("leaf").alias("hash"), "claimed", none.cast("long").alias("tree"), none.cast("int").alias("level"))
    asked = fetched.select("of_tree", "of_block", F.lit(0).alias("kind"), "idx", none.cast("long").alias("n"), none.cast("long").alias("top_n"), none.cast(kind).alias("doc_id"), "hash", none.cast("string").alias("claimed"), "tree", "level")
    out_names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fetched, rows = None, {}, []

        def close() -> pa.RecordBatch:
            block = _Block(held[0], rows[0][1], rows[0][2], fetched, {r[0]: r[4] for r in rows})
            made = [block.prove(r[0], r[4], r[5]) for r in rows]
            columns = [pa.array([r[3] for r in rows], doc_type), *(pa.array(c, pa.string()) for c in zip(*made))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([m[4] == m[2] for m in made], pa.bool_())], ["doc_id", *out_names, "verified"])

        for batch in sliced(batches, 10_000):
            doc_type = batch.schema.field("doc_id").type
            for of_tree, of_block, kind, idx, n, top_n, doc_id, h, claimed, tree, level in zip(*(c.to_pylist() for c in batch.columns)):
                if held != (of_tree, of_block):
                    if held is not None:
                        yield close()
                    held, fetched, rows = (of_tree, of_block), {}, []
                if kind:
                    rows.append((idx, n, top_n, doc_id, h, claimed))
                else:
                    fetched[tree, level, idx] = h
        if held is not None:
            yield close()

    schema = f"doc_id {kind}, " + ", ".join(f"{n} string" for n in out_names) + ", verified boolean"
    return _by_block(rows.unionByName(asked), "of_tree", F.col("of_block"), "kind", "idx").mapInArrow(run, schema)


def merkle(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` and a proof for every row of it: see ``leaves``, ``manifest`` and ``proofs``.

    Null columns are digested as such, null languages are a tree of their own. Repeated rows each give a leaf and a
    row. An empty table gives no rows. Columns other than FIELDS are not read.
    """
    placed, nodes = manifest(leaves(docs))
    return proofs(placed, nodes)
