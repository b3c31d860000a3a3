"""The queries of this subpackage: each applies an operator with its production parameters to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from athletrack.llm import chat, html, imatch, merkle, neardup, phrases, pieces, pii, quality, repeats, rules, runs, toxicity
from athletrack.llm.base import read
from athletrack.llm.sql import ORACLES


def tokenizer_path() -> str:
    """The vocabulary file of the tokenizer query; a parameter of the operator."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), neardup.Shape(words=3, percent=85))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.control_case(spark))
    return chat.digests(chat.read_back(chat.format_trees(chat.conversation_nodes(rows))))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.detect(read(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.remove_repeats(read(spark, sf_dir, "documents")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.digests(phrases.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode(read(spark, sf_dir, "documents"), tokenizer_path(), with_text=True))


def op11_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return imatch.compare_edited(docs, imatch.lexicon(docs))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle(read(spark, sf_dir, "documents"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(read(spark, sf_dir, "documents"), runs.repeated_tail))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_neardup, op2_chat, op3_pii, op4_toxicity, op5_repeats, op6_decontamination, op7_quality, op8_rules, op9_html, op10_pieces, op11_imatch, op12_merkle, op13_runs)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
