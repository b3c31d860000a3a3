"""Benchmark decontamination with a distributed positional inverted index.

The index holds the postings (term, document, position) of the test items' terms in all documents. A document is a
doc_id and the hash of its text, so that places in two texts of one doc_id never meet. Items are looked
up from their rarest terms: the lists of the two rarest terms of every window, shifted by their place in the item,
are intersected to alignments (item, document, shift); only these are compared with the lists of all other terms.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from athletrack.llm.base import written

WINDOW = 10
BROADCAST_ROWS = 500_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOC = ["doc_id", "text_id"]
_LENGTH = -1  # the term number under which a document's number of words is stored


def words(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; the first and last entry may be empty. Null for null."""
    return F.split(F.translate(text.cast("string"), _UPPER, _UPPER.lower()), _BETWEEN)


def n_words(split: Column) -> Column:
    empty = (F.get(split, F.lit(0)) == "").cast("int") + ((F.size(split) > 1) & (F.get(split, F.size(split) - 1) == "")).cast("int")
    return F.coalesce(F.size(split) - empty, F.lit(0)).cast("int")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows; it must be a written table."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def numbered(items: DataFrame) -> DataFrame:
    """(item_id long, item string, text): each distinct text of an item_id under a number of its own.

    Places and runs hold within one text, so neither equal rows nor other texts of an item may share its key.
    """
    found = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).distinct()
    return written(found.select(F.monotonically_increasing_id().alias("item_id"), "item", "text"), "phrases-texts")


def item_terms(items: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(item_id, place, term, length) for each word of each item; places from 0."""
    split = items.select("item_id", words(F.col("text")).alias("w"))
    placed = split.select("item_id", n_words(F.col("w")).alias("length"), (F.get("w", F.lit(0)) == "").cast("int").alias("skip"), F.posexplode("w").alias("at", "word")).where("word <> ''")
    return placed.join(vocabulary, "word").select("item_id", (F.col("at") - F.col("skip")).alias("place"), "term", "length")


def vocabulary(items: DataFrame) -> DataFrame:
    """(word, term): the distinct words of the items, numbered."""
    found = items.select(F.explode(words(F.col("text"))).alias("word")).where("word <> ''").distinct()
    return written(found.withColumn("term", F.monotonically_increasing_id()), "phrases-terms")


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, text_id, pos): postings of ``terms`` in every whole text, and each document's number of words."""
    mark = "\x01"  # a separator, so no word
    with_mark = small(written(terms.unionByName(terms.sparkSession.createDataFrame([(mark, _LENGTH)], "word string, term long")), "phrases-terms"))
    split = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_id"), words(F.col("text")).alias("w"))
    tokens = split.select(*DOC, n_words(F.col("w")).alias("n"), F.posexplode(F.concat(F.coalesce("w", F.array().cast("array<string>")), F.array(F.lit(mark)))).alias("pos", "word"))
    return tokens.join(with_mark, "word").select("term", *DOC, F.when(F.col("term") == _LENGTH, F.col("n")).otherwise(F.col("pos")).alias("pos"))


def rare_terms(placed: DataFrame, frequency: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, place, term, length): the rarest and the second rarest term of every window, at a place each.

    A window with one term only has its first and last place for both.
    """
    starts = placed.select("item_id", "place", "term", "length", F.explode(F.sequence(F.greatest(F.lit(0), F.col("place") - (window - 1)), F.greatest(F.lit(0), F.least(F.col("place"), F.col("length") - window)))).alias("start"))
    inside = starts.join(frequency, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by_term = inside.groupBy("item_id", "start", "term", "n", "length").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    order = Window.partitionBy("item_id", "start").orderBy("n", "term")
    ranked = by_term.withColumn("rank", F.row_number().over(order)).withColumn("terms", F.count(F.lit(1)).over(Window.partitionBy("item_id", "start"))).where("rank <= 2")
    places = F.when(F.col("terms") == 1, F.array("first", "last")).otherwise(F.array("first"))
    return ranked.select("item_id", F.explode(places).alias("place"), "term", "length").distinct()


def alignments(postings: DataFrame, rare: DataFrame) -> DataFrame:
    """(item_id, doc_id, text_id, shift) where rare terms of two places of the item meet at the same shift (one, if it has one word)."""
    met = postings.join(small(rare), "term").select("item_id", *DOC, (F.col("pos") - F.col("place")).alias("shift"), "place", "length")
    both = met.groupBy("item_id", *DOC, "shift").agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.min("length").alias("length"))
    return both.where("lo < hi or length = 1").select("item_id", *DOC, "shift")


def phrase_matches(postings: DataFrame, placed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, doc_id, text_id, pos): document words inside an occurrence of a window of the item, exactly.

    Runs of ``window`` or more consecutive item words at one shift are what windows cover; an item of fewer words
    must occur whole.
    """
    frequency = postings.where(F.col("term") >= 0).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rare = written(rare_terms(placed, frequency, window), "phrases-rare")
    aligned = written(alignments(postings, rare), "phrases-aligned")
    there = small(written(aligned.select(*DOC).distinct(), "phrases-docs"))
    lists = postings.where(F.col("term") >= 0).join(there, DOC, "left_semi")
    expected = aligned.join(small(written(placed, "phrases-items")), "item_id").select("item_id", *DOC, "shift", "place", "term", "length", (F.col("shift") + F.col("place")).alias("pos"))
    met = expected.join(lists, [*DOC, "pos", "term"], "left_semi")
    at = Window.partitionBy("item_id", *DOC, "shift").orderBy("place")
    runs = met.withColumn("run", F.col("place") - F.row_number().over(at))
    runs = runs.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("item_id", *DOC, "shift", "run")))
    return runs.where(F.col("size") >= F.least(F.lit(window), F.col("length"))).select("item_id", *DOC, "pos")


def proximity_matches(postings: DataFrame, placed: DataFrame, within: int = 30, terms: int = 3) -> DataFrame:
    """(item_id, doc_id, text_id, pos, span): places where the item's rarest terms all lie within ``within`` words.

    ``pos`` is the last of them and ``span`` the words from the first to the last.
    """
    frequency = postings.where(F.col("term") >= 0).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    distinct = placed.select("item_id", "term").distinct().join(frequency, "term")
    ranked = distinct.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("n", "term"))).where(F.col("rank") <= terms)
    ranked = written(ranked.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("item_id"))), "phrases-near")
    met = postings.join(small(ranked), "term").select("item_id", *DOC, "pos", "rank", "of")
    so_far = Window.partitionBy("item_id", *DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("rank") == k, F.col("pos"))).over(so_far) for k in range(1, terms + 1)]
    met = met.withColumn("seen", F.array_compact(F.array(*last)))
    span = (F.col("pos") - F.array_min("seen") + 1).alias("span")
    return met.where(F.size("seen") == F.col("of")).select("item_id", *DOC, "pos", span).where(F.col("span") <= within)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated), items sorted as strings, for every row.

    Null and empty texts have no words and no hits, and such items no window. Repeated items count once, and several
    texts of an item_id are looked for each by itself. Rows that repeat a doc_id are each judged by their own text; a
    null doc_id and a null item_id match nothing. Other columns are not read.
    """
    items = numbered(items)
    terms = vocabulary(items)
    placed = written(item_terms(items, terms), "phrases-items")
    postings = written(index(docs, terms), "phrases-index")
    hits = phrase_matches(postings.where("doc_id is not null"), placed, window)
    found = hits.join(small(items.select("item_id", "item")), "item_id").groupBy(*DOC, "pos").agg(F.collect_set("item").alias("items"))
    found = found.groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    lengths = postings.where(F.col("term") == _LENGTH).select(*DOC, F.col("pos").cast("long").alias("n_words"))
    out = lengths.join(found, DOC, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
