"""Reply trees as conversations.

Iterative self-joins double the reach of every node's ancestor link until all reach the root, so a tree of depth d
takes log2(d) joins. The same links give the best-scored branch of each tree and then the nodes on it. A template
marks turns; control strings inside texts are escaped, so the formatted text can be read back exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from athletrack.llm.base import written

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"
_CONTROL = r"(\\|###|</turn>)"
_TURN = re.compile(
    r"### ((?:[^\\#<:]+|\\(?:\\|###|</turn>|:)|\#(?!##)|<(?!/turn>))*+): ((?:[^\\#<]+|\\(?:\\|###|</turn>)|\#(?!##)|<(?!/turn>))*+)</turn>\n"
)
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")


def links(nodes: DataFrame) -> list[DataFrame]:
    """Ancestor links: the k-th table has (node, up), 2**k steps apart.

    A node whose parent is null or missing is a root. Each table is written; parents must not form a circle.
    """
    known = nodes.select(F.col("node").alias("up"))
    step = written(nodes.where("parent is not null").select("node", F.col("parent").alias("up")).join(known, "up", "left_semi").select("node", "up"), "chat-links")
    out = []
    while not step.isEmpty():
        out.append(step)
        step = written(step.alias("a").join(step.alias("b"), F.col("a.up") == F.col("b.node")).select("a.node", "b.up"), "chat-links")
        if len(out) > 62:
            raise ValueError("parents form a circle")
    return out


def paths(leaves: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """(leaf, node, above): for each ``leaf`` the nodes from it to its root and their distance from it.

    The longest links come first: most leaves have none, so rows double in the last joins only.
    """
    out = leaves.select("leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("above"))
    for k, table in reversed(list(enumerate(steps))):
        here, there = F.struct("node", "above"), F.struct(F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        both = F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there))
        out = out.join(table, "node", "left").select("leaf", F.explode(both).alias("n")).select("leaf", "n.node", "n.above")
    return out


def chosen_branches(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, above): nodes of the ``branches`` best root-to-leaf paths of each tree.

    ``nodes`` has tree, node (unique), parent and score. A path's score is the mean of its nodes' scores (null: 0);
    the longer path wins among equals, then the smaller leaf.
    """
    nodes = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    leaves = nodes.join(nodes.select(F.col("parent").alias("node")), "node", "left_anti").select(F.col("node").alias("leaf"), "tree")
    on_path = written(paths(leaves, links(nodes)), "chat-paths")
    ranked = on_path.join(nodes.select("node", "score"), "node").groupBy("leaf").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("length")).join(leaves, "leaf")
    best = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("length"), "leaf")
    ranked = ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches).select("tree", "leaf", "rank")
    return on_path.join(ranked, "leaf")


def escaped(text, control: str = _CONTROL):
    return F.regexp_replace(F.coalesce(text, F.lit("")), control, r"\\$1")


def format_trees(nodes: DataFrame, branches: int = 1, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(tree, rank, formatted, loss_spans): one conversation for each chosen branch.

    ``nodes``: tree, node (unique), parent, role, text, score. ``loss_spans`` are [start, end) code points of the
    texts of ``loss_role`` in ``formatted``. Null texts and roles are empty ones.
    """
    turn = nodes.select("node", F.concat(F.lit(OPEN), escaped(F.col("role"), r"(\\|###|</turn>|:)"), F.lit(COLON)).alias("head"), escaped(F.col("text")).alias("body"), F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("loss"))
    rows = chosen_branches(nodes, branches).join(turn, "node")
    rows = rows.withColumn("all", F.concat("head", "body", F.lit(CLOSE)))
    before = Window.partitionBy("leaf").orderBy(F.desc("above"))
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("all")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head"))
    part = F.struct((-F.col("above")).alias("depth"), "all", "loss", "start", (F.col("start") + F.length("body")).alias("end"))
    talks = rows.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(part)).alias("turns"))  # one conversation: one row of the result
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.array(t["start"], t["end"]))
    return talks.select("tree", "rank", F.array_join("turns.all", "").alias("formatted"), spans.alias("loss_spans"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; ValueError if the text is not in the format."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def read_back(conversations: DataFrame) -> DataFrame:
    """(tree, rank, turns array<struct<role, text>>, loss, n_chars): parsed from the formatted text and its mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            texts = batch.column(2).to_pylist()
            turns = [[dict(zip(("role", "text"), t)) for t in parse(text)] for text in texts]
            loss = [unescape_spans(text, spans) for text, spans in zip(texts, batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(turns, kind), pa.array(loss, pa.string()), pa.array(map(len, texts), pa.int64())], ["tree", "rank", "turns", "loss", "n_chars"])

    kinds = dict(conversations.dtypes)
    return conversations.select("tree", "rank", "formatted", "loss_spans").mapInArrow(run, f"tree {kinds['tree']}, rank int, turns array<struct<role:string,text:string>>, loss string, n_chars long")


def unescape_spans(text: str, spans: list[list[int]]) -> str:
    return "".join(unescape(text[s:e]) for s, e in spans)


def conversation_nodes(rows: DataFrame) -> DataFrame:
    """Turns as nodes: each answers the one before it in its conversation.

    Turns are ordered by (turn, role, text), nulls first, so repeated turns are each kept; a null conv_id is one
    conversation.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = rows.select(F.col("conv_id").alias("tree"), F.col("turn"), F.col("role"), F.col("text")).withColumn("k", F.row_number().over(order))
    name = lambda k: F.concat_ws(":", F.coalesce(F.col("tree").cast("string"), F.lit("null")), k.cast("string"))
    return rows.select("tree", name(F.col("k")).alias("node"), F.when(F.col("k") > 1, name(F.col("k") - 1)).alias("parent"), "role", "text", F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score"))


def control_case(spark: SparkSession) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")


def digests(read: DataFrame) -> DataFrame:
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.col("n_chars").alias("formatted_chars"),
    )
